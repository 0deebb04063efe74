"""SentencePiece encoding by streaming Viterbi, and decoding.

A model is a list of pieces with scores; a text's ids are the pieces of its
best-scoring segmentation.  Pieces live in a trie of exact (node, character)
keys.  Where no piece of the vocabulary holds two neighbouring characters,
every path has a boundary between them, so all surviving paths converge there
whatever their scores: texts are cut at these places into lanes that are
committed on their own, and the lanes of a block of texts advance together,
one character a step.  A lane longer than LANE characters goes through
``Stream``, which keeps scores for one longest piece only and commits ids as
soon as the paths that are left agree.

Characters without a piece are written as bytes, so decoding gives every text
back exactly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as K

#: Fixed values of the model format: piece kinds, the mark of a blank, the cost of an unknown character.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
MARK = "▁"
UNKNOWN_COST = 10.0
LANE, BLOCK = 64, 1 << 18
#: Stands for a mark that was in the text itself; no piece has it.
OWN_MARK = 0x110000
FREE = np.int64(-1)


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        size = varint() if kind in (0, 2) else 8 if kind == 1 else 4
        if kind == 0:
            yield tag >> 3, size
        else:
            yield tag >> 3, data[at:at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model; bounded by the model file."""

    surface: list[bytes]
    score: np.ndarray
    keys: np.ndarray
    nodes: np.ndarray
    terminal: np.ndarray
    longest: int
    pairs: np.ndarray
    unknown: int
    byte_ids: np.ndarray
    unknown_score: float
    prefix: bool
    squeeze: bool

    @cached_property
    def walk(self) -> dict[int, tuple[int, int]]:
        """The trie as (node, character) to the next node and its piece, for one character at a time."""
        used = self.keys != FREE
        nodes = self.nodes[used]
        return dict(zip(self.keys[used].tolist(), zip(nodes.tolist(), self.terminal[nodes].tolist())))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "walk"}


def hashed(keys: np.ndarray, size: int) -> np.ndarray:
    k = keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return ((k ^ (k >> np.uint64(29))) >> np.uint64(7)).astype("i8") & (size - 1)


def load(path: str) -> Vocabulary:
    """Read a model file.  Models with their own character map are refused."""
    pieces, prefix, squeeze = [], True, True
    with open(path, "rb") as file:
        for number, value in fields(file.read()):
            if number == 1:
                f = dict(fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 3:
                f = dict(fields(value))
                if f.get(2):
                    raise ValueError("models with a character map are not supported")
                prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
    normal = [s for _, s, k in pieces if k == NORMAL]
    low, high = min(normal), max(normal)
    trie: dict[int, int] = {}
    terminal, longest, near = [-1], 1, set()
    surface, byte_ids, unknown = [], np.full(256, -1, "i4"), 0
    score = np.array([s for _, s, _ in pieces])
    for i, (piece, _, kind) in enumerate(pieces):
        surface.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"")
        if kind == BYTE:
            byte_ids[surface[-1][0]] = i
        elif kind == UNKNOWN:
            unknown = i
        if kind not in (NORMAL, USER) or not piece:
            continue
        if kind == USER:
            score[i] = len(piece) * high - 0.1
        node = 0
        for c in map(ord, piece):
            key = node << 21 | c
            node = trie.setdefault(key, len(terminal))
            if node == len(terminal):
                terminal.append(-1)
        terminal[node] = i
        longest = max(longest, len(piece))
        near.update(zip(map(ord, piece), map(ord, piece[1:])))
    if (byte_ids < 0).any():
        byte_ids = np.full(256, unknown, "i4")
    size = 1 << (2 * len(trie)).bit_length()
    keys, nodes = np.full(size, FREE), np.zeros(size, "i4")
    left, value = np.fromiter(trie, "i8", len(trie)), np.fromiter(trie.values(), "i4", len(trie))
    at = hashed(left, size)
    while len(left):  # open addressing: whoever finds a free place first takes it, the others try the next
        free = keys[at] == FREE
        _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        first = first[free[first]]
        keys[at[first]], nodes[at[first]] = left[first], value[first]
        rest = np.ones(len(left), bool)
        rest[first] = False
        left, value, at = left[rest], value[rest], (at[rest] + 1) & (size - 1)
    pairs = np.zeros(1 << 20, bool)
    pairs[hashed(np.array([a << 21 | b for a, b in near] or [0], "i8"), 1 << 20)] = True
    return Vocabulary(surface, score, keys, nodes, np.array(terminal, "i4"), longest, pairs, unknown, byte_ids, low - UNKNOWN_COST, prefix, squeeze)


def step(vocabulary: Vocabulary, node: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Trie nodes reached from nodes by characters; 0 if there is none."""
    key, size = node.astype("i8") << 21 | code, len(vocabulary.keys)
    out, todo, at = np.zeros(len(key), "i4"), np.arange(len(key)), hashed(key, size)
    while len(todo):
        seen = vocabulary.keys[at]
        hit = seen == key[todo]
        out[todo[hit]] = vocabulary.nodes[at[hit]]
        go = ~hit & (seen != FREE)
        todo, at = todo[go], (at[go] + 1) & (size - 1)
    return out


def edges(vocabulary: Vocabulary, codes: np.ndarray, ends: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, start, id) of all pieces that begin at these places; none goes beyond its lane's end."""
    node = np.zeros(len(start), "i4")
    for length in range(1, vocabulary.longest + 1):
        inside = start + length <= ends[start]
        start, node = start[inside], node[inside]
        if not len(start):
            return
        node = step(vocabulary, node, codes[start + length - 1])
        start, node = start[node > 0], node[node > 0]
        piece = vocabulary.terminal[node]
        hit = piece >= 0
        yield length, start[hit], piece[hit]


class Stream:
    """Viterbi over characters that arrive one by one.

    ``window`` holds the scores of the last positions, as many as the longest
    piece is long: no path that is still alive can have left them.  Back
    pointers are kept from the committed boundary on; ``settle`` commits up to
    the last boundary that the paths to all positions still alive share, and
    forgets it.  It is tried when what is open has doubled, so that paths that
    never meet cost no more than those that do.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.walk, self.score = vocabulary, vocabulary.walk, vocabulary.score.tolist()
        self.window: dict[int, float] = {0: 0.0}
        self.back: dict[int, tuple[int, int]] = {}
        self.open: list[tuple[int, int]] = []
        self.at = self.committed = 0
        self.next = LANE

    def push(self, code: int) -> list[tuple[int, int]]:
        """Take a character; returns the (start, id) that are settled by it."""
        v, walk, window, begin, now = self.v, self.walk, self.window, self.at, self.at + 1
        self.open.append((begin, 0))
        still, best, back, single = [], -np.inf, None, False
        for start, node in self.open:
            reached = walk.get(node << 21 | code)
            if reached:
                node, piece = reached
                still.append((start, node))
                if piece >= 0:
                    single |= start == begin
                    value = window[start] + self.score[piece]
                    if value > best:
                        best, back = value, (start, piece)
        if not single and window[begin] + v.unknown_score > best:
            best, back = window[begin] + v.unknown_score, (begin, -1)
        self.open = still
        window[now], self.back[now], self.at = best, back, now
        window.pop(now - v.longest, None)
        return self.settle() if now - self.committed >= self.next else []

    def path(self, end: int) -> list[tuple[int, int]]:
        out = []
        while end > self.committed:
            out.append(self.back[end])
            end = out[-1][0]
        return out[::-1]

    def settle(self) -> list[tuple[int, int]]:
        """Follow the path that reaches furthest back by one piece at a time until one boundary is left."""
        live = {self.at, *(start for start, _ in self.open)}
        heap = [-x for x in live]
        heapify(heap)
        while len(live) > 1:
            end = -heappop(heap)
            live.remove(end)
            before = self.back[end][0]
            if before not in live:
                live.add(before)
                heappush(heap, -before)
        shared = live.pop()
        done = self.path(shared)
        for end in range(self.committed + 1, shared + 1):
            del self.back[end]
        self.committed = shared
        self.next = max(LANE, 2 * (self.at - shared))
        return done

    def finish(self) -> list[tuple[int, int]]:
        return self.path(self.at)


def lanes(vocabulary: Vocabulary, codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the lanes; ``breaks`` are starts of texts."""
    near = vocabulary.pairs[hashed(codes[:-1] << 21 | codes[1:], len(vocabulary.pairs))]
    cut = np.r_[True, ~near]
    cut[breaks] = True
    return np.flatnonzero(cut)


def segment(vocabulary: Vocabulary, codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and id of every piece of a block; id -1 is a character written as bytes."""
    n = len(codes)
    first = lanes(vocabulary, codes, breaks)
    size = np.diff(np.append(first, n))
    ends = np.repeat(first + size, size)
    long = size > LANE
    offset = np.minimum(np.arange(n) - np.repeat(first, size), LANE).astype("u1")
    short = ~np.repeat(long, size)
    by_step: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(LANE)]
    bare = short.copy()

    def sort_in(length: int, start: np.ndarray, piece: np.ndarray) -> None:
        order = np.argsort(offset[start], kind="stable")
        start, piece = start[order], piece[order]
        bounds = np.append(0, np.cumsum(np.bincount(offset[start], minlength=LANE)[:LANE]))
        for o in range(LANE):
            if bounds[o] < bounds[o + 1]:
                by_step[o].append((length, start[bounds[o]:bounds[o + 1]], piece[bounds[o]:bounds[o + 1]]))

    for length, start, piece in edges(vocabulary, codes, ends, np.flatnonzero(short)):
        if length == 1:
            bare[start] = False
        sort_in(length, start, piece)
    sort_in(1, np.flatnonzero(bare), np.full(int(bare.sum()), -1, "i4"))
    score = np.append(vocabulary.score, vocabulary.unknown_score)
    best, back, chosen = np.full(n + 1, -np.inf), np.zeros(n + 1, "i4"), np.full(n + 1, -1, "i4")
    base = np.zeros(n + 1)  # best at a position as a start: lanes begin at 0, though the lane before ends there
    for o in range(LANE):
        for length, start, piece in by_step[o]:
            value = (base[start] if o == 0 else best[start]) + score[piece]
            end = start + length
            win = value > best[end]
            end, piece = end[win], piece[win]
            best[end], back[end], chosen[end] = value[win], length, piece
    mark, ids = np.zeros(n, bool), np.zeros(n, "i4")
    at, floor = (first + size)[~long], first[~long]
    while len(at):
        start = at - back[at]
        mark[start], ids[start] = True, chosen[at]
        at, floor = start[start > floor], floor[start > floor]
    for a, s in zip(first[long], size[long]):
        stream = Stream(vocabulary)
        for code in codes[a:a + s].tolist():
            for start, piece in stream.push(code):
                mark[a + start], ids[a + start] = True, piece
        for start, piece in stream.finish():
            mark[a + start], ids[a + start] = True, piece
    found = np.flatnonzero(mark)
    return found, ids[found]


def prepare(vocabulary: Vocabulary, text: str) -> str:
    """The text as it is segmented: a blank before a text that is not empty."""
    if vocabulary.squeeze:
        text = " ".join(text.split(" ")).strip(" ")
        while "  " in text:
            text = text.replace("  ", " ")
    if text and vocabulary.prefix:
        text = " " + text
    return text


def coded(text: str) -> np.ndarray:
    """Characters of a prepared text, blanks as marks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    codes[codes == ord(MARK)] = OWN_MARK
    codes[codes == 32] = ord(MARK)
    return codes


def spelled(vocabulary: Vocabulary, codes: np.ndarray, found: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters without a piece as bytes, and where each comes from."""
    if not (ids < 0).any():
        return found, ids
    width, out = np.ones(len(ids), "i8"), []
    for k in np.flatnonzero(ids < 0):
        code = codes[found[k]]
        raw = chr(min(code, 0x10FFFF)).encode() if code != OWN_MARK else MARK.encode()
        out.append(vocabulary.byte_ids[list(raw)])
        width[k] = len(raw)
    wide = np.repeat(ids, width)
    wide[np.repeat(ids < 0, width)] = np.concatenate(out)
    return np.repeat(found, width), wide


def long_text(vocabulary: Vocabulary, text: str) -> Iterator[np.ndarray]:
    """Ids of a text longer than a block, block by block: a block ends where a lane does.

    A lane that fills a block goes through one ``Stream`` until it ends.
    """
    none, at, stream = np.array([0]), 0, None
    while at < len(text):
        codes = coded(text[at:at + BLOCK + 1])
        last = at + BLOCK >= len(text)
        first = lanes(vocabulary, codes, none)[1:]  # where lanes begin, behind the first
        if stream is None and (last or len(first)):
            size = len(codes) if last else int(first[-1])
            yield spelled(vocabulary, codes[:size], *segment(vocabulary, codes[:size], none))[1]
        else:
            stream = stream or (Stream(vocabulary), at)
            whole, begin = stream
            size = int(first[0]) if len(first) else len(codes) if last else BLOCK
            done = [x for code in codes[:size].tolist() for x in whole.push(code)]
            if len(first) or last:
                done += whole.finish()
                stream = None
            if done:
                start, ids = (np.array(x) for x in zip(*done, strict=True))
                low = begin + int(start[0])
                yield spelled(vocabulary, coded(text[low:begin + int(start[-1]) + 1]), start - start[0], ids)[1]
        at += size


def encode(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has."""
    ready = [prepare(vocabulary, t) if t else "" for t in texts]
    counts, parts = np.zeros(len(texts), "i8"), []
    at = 0
    while at < len(ready):
        if len(ready[at]) > BLOCK:
            for ids in long_text(vocabulary, ready[at]):
                counts[at] += len(ids)
                parts.append(ids.astype("i4"))
            at += 1
            continue
        stop, size = at, 0
        while stop < len(ready) and size + len(ready[stop]) <= BLOCK:
            size += len(ready[stop])
            stop += 1
        lengths = np.array([len(t) for t in ready[at:stop]])
        codes = coded("".join(ready[at:stop]))
        if len(codes):
            breaks = np.cumsum(lengths) - lengths
            found, ids = spelled(vocabulary, codes, *segment(vocabulary, codes, breaks[lengths > 0]))
            counts += np.bincount(np.repeat(np.arange(at, stop), lengths)[found], minlength=len(texts))
            parts.append(ids.astype("i4"))
        at = stop
    return np.concatenate(parts) if parts else np.array([], "i4"), counts


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    text = b"".join(map(vocabulary.surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


def add_ids(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add ids (array of int) and round_trip (decoding them gives the text back) to all rows.

    NULL texts have NULL ids and round_trip, empty texts no ids.  Repeated
    rows are encoded alike, columns of the added names are replaced.  A worker
    holds the texts and ids of one Arrow batch and the lattice of one block;
    a text longer than a block is cut where a lane ends.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.drop("ids", "round_trip")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            ids, counts = encode(v, texts)
            bounds = np.append(0, np.cumsum(counts))
            same = [None if t is None else decode(v, ids[bounds[i]:bounds[i + 1]].tolist()) == t for i, t in enumerate(texts)]
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), pa.array(ids), mask=null)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(same, pa.bool_())], names=[*batch.schema.names, "ids", "round_trip"])

    return kept.mapInArrow(run, K.StructType([*kept.schema.fields, K.StructField("ids", K.ArrayType(K.IntegerType())), K.StructField("round_trip", K.BooleanType())]))


def add_text(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the decoded text of an array of ids to all rows; NULL ids give NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = rows.drop(text)
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(shared.value, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, K.StructType([*kept.schema.fields, K.StructField(text, K.StringType())]))
