"""Katz backoff language model, trained and scored over blocks of texts.

Counts of order 1 to n are discounted by Good-Turing.  What an order's seen
n-grams leave of a context goes to the next lower order, normalised exactly by
what that order gives to unseen words:

    P_k(w | h) = d_c c(h w) / c(h)              if (h w) is in the table
               = alpha_k(h) P_{k-1}(w | h')     otherwise

A table of all n-grams is larger than the texts, so none is written.  Texts are
kept as blocks of words' hashes.  By order, each block asks once for every
n-gram it holds; questions are grouped by a range of keys (a bucket), where
counts are summed, and the answers are grouped by block again.  Two things
spare most questions:

* an n-gram whose context or suffix is in one block only is in that block only,
  which then counts it alone;
* both sums that alpha needs run over a context's tokens as well as over its
  n-grams (divided by the count), so blocks add them up where they are, and only
  contexts that some token backs off from, or whose n-grams may all be
  undiscounted, are asked for.

Keys are 64-bit hashes.  A key is asked for once a block, so that no key is hot;
the number of buckets grows with the texts.  All of this is for volume; every
n-gram of every document counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.llm.hashing import blocks, word_hashes
from noctule.llm.tables import settled

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a block, and of a bucket as a power of two.
BLOCK_TOKENS = 1 << 20
BUCKET_BITS = 19
END = np.uint64(0x6A09E667F3BCC909)
PAD = np.uint64(0x3C6EF372FE94F82B)
PART = "block long, kind string, bucket int, body binary"


def turn(level: int) -> int:
    """Bits by which a suffix is rotated into the key of an n-gram of this order."""
    return (7 + 16 * (level - 1)) % 64


def joint(context: np.ndarray, suffix: np.ndarray, level: int) -> np.ndarray:
    r = turn(level)
    return context ^ ((suffix << np.uint64(r)) | (suffix >> np.uint64(64 - r)))


def pad(level: int) -> np.uint64:
    """The key of a context of this many starts of text."""
    key = np.array([PAD])
    for k in range(2, level + 1):
        key = joint(key, key, k)
    return key[0]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, an end after each text, and the text it is in."""
    words, owner = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    sizes = np.bincount(owner, minlength=len(texts))
    hashes = np.empty(len(words) + len(texts), "u8")
    hashes[np.arange(len(words)) + owner] = words
    hashes[np.cumsum(sizes) + np.arange(len(texts))] = END
    return hashes, np.repeat(np.arange(len(texts)), sizes + 1)


def pack(x: np.ndarray) -> bytes:
    """64-bit values as compressed planes of bytes, without the planes above the largest."""
    x = np.ascontiguousarray(x).view("u8") if x.dtype.itemsize == 8 else x.astype("u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view("u1").reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], "i8").tobytes() + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width else b"")


def unpack(body: bytes) -> np.ndarray:
    size, width = np.frombuffer(body, "i8", 2)
    out = np.zeros((size, 8), "u1")
    if width:
        out[:, :width] = np.frombuffer(pa.decompress(body[16:], int(size * width), codec="zstd"), "u1").reshape(width, size).T
    return out.view("u8").ravel()


def differences(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def summed(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body), dtype="u8")


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and the sorted keys.

    Places take the lowest bits while sorting; where that mixes up keys that
    agree in all others, they are sorted in full.
    """
    bits = np.uint64(max(len(key), 1).bit_length())
    at = (np.sort((key >> bits << bits) | np.arange(len(key), dtype="u8")) & ((np.uint64(1) << bits) - np.uint64(1))).view("i8")
    if (key[at[1:]] < key[at[:-1]]).any():
        at = np.argsort(key, kind="stable")
    return at, key[at]


def entries(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them."""
    at, sorted_keys = ordered(key)
    new = np.ones(len(key), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    inverse = np.empty(len(key), "i8")
    inverse[at] = np.cumsum(new) - 1
    return sorted_keys[new], inverse


def encoded(texts: DataFrame) -> DataFrame:
    """Rows (row, text, used) as blocks: by block one row for each of rows, used, sizes, words, at; n counts its tokens."""

    def body(block: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows, used, sizes, hashes = (np.concatenate(x) for x in zip(*held))
        words, at = entries(hashes)
        # frequent words get small numbers, which compress; in order of keys where about as frequent, whose differences do
        rank, place = np.empty(len(words), "i8"), np.empty(len(words), "i8")
        rank[np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")] = np.arange(len(words))
        order = np.argsort(np.log2(rank + 1).astype("u1"), kind="stable")
        place[order] = np.arange(len(words))
        parts = {"rows": rows.tobytes(), "used": used.tobytes(), "sizes": pack(sizes), "words": differences(words[order]), "at": pack(place[at])}
        return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), "i8"), pa.array(list(parts)), pa.array([0] * len(parts), "i4"), pa.array(list(parts.values()), "binary"),
                                           pa.array([0] * (len(parts) - 1) + [len(hashes)], "i8")], names=["block", "kind", "bucket", "body", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0
        for batch in batches:
            for rows, some in blocks(batch, "text"):
                hashes, owner = tokens(some)
                block = batch.column("id")[rows.start].as_py() if block is None else block
                held.append((batch.column("row").to_numpy()[rows], batch.column("used").to_numpy(zero_copy_only=False)[rows], np.bincount(owner), hashes))
                size += len(hashes)
                if size >= BLOCK_TOKENS:
                    yield body(block, held)
                    block, held, size = None, [], 0
        if held:
            yield body(block, held)

    return texts.select(F.monotonically_increasing_id().alias("id"), "row", "text", "used").mapInArrow(run, f"{PART}, n long")


def good_turing(n: dict[int, int]) -> list[float]:
    """Katz's discounts of counts 1 to DISCOUNTED from the counts of counts.

    Where they are undefined or leave (0, 1), all are (r - D) / r with
    D = n1 / (n1 + 2 n2), 1/2 for want of those.
    """
    first, top = n.get(1, 0), n.get(DISCOUNTED + 1, 0)
    if first and all(n.get(r, 0) for r in range(1, DISCOUNTED + 2)):
        a = (DISCOUNTED + 1) * top / first
        found = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, DISCOUNTED + 1)] if a < 1 else [2.0]
        if all(0 < d <= 1 for d in found):
            return found
    cut = first / (first + 2 * n.get(2, 0)) if first and n.get(2, 0) else 0.5
    return [(r - cut) / r for r in range(1, DISCOUNTED + 1)]


def backed(mass: np.ndarray, below: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log alpha of contexts, and whether their n-grams would leave nothing; 0 for those without an n-gram."""
    of = np.maximum(of, 1)
    full = mass / of > 1 - 1e-9
    back = np.log10((1 - mass / (of + full)) / np.maximum(1 - below, 1e-12))
    return np.where(mass > 0, back, 0.0), full


@dataclass
class Model:
    """Texts as blocks, with what is known of all of them.

    ``weights`` are by order the discounts of counts 0, 1, ... DISCOUNTED and
    more; those of order 2 and above are found while scoring.
    """

    texts: DataFrame
    key: Column | None
    blocks: DataFrame
    words: DataFrame
    bits: int
    order: int
    least: tuple[int, ...]
    total: int
    distinct: int
    documents: int
    unknown: float
    scale: float
    weights: list[np.ndarray]


class Block:
    """Tokens of a block and what is known so far of the n-grams that end at them, by order."""

    def __init__(self, table: pa.Table, model: Facts):
        parts: dict[str, dict[int, bytes]] = {}
        for kind, bucket, body in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "body"))):
            parts.setdefault(kind, {})[bucket] = body
        self.model, self.id, self.parts = model, table.column("block")[0].as_py(), parts
        self.rows, sizes = np.frombuffer(parts["rows"][0], "i8"), unpack(parts["sizes"][0]).view("i8")
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.r_[True, self.owner[1:] != self.owner[:-1]]
        self.used = np.frombuffer(parts["used"][0], bool)[self.owner]
        words, at = summed(parts.pop("words")[0]), unpack(parts.pop("at")[0]).view("i8")
        self.unique, place = entries(words)
        self.key, self.inverse = words[at], place[at]
        self.level, self.shared = 1, np.ones(len(at), bool)
        self.sent = np.ones(len(self.unique), bool)

    def answer(self, kind: str, dtype: str) -> np.ndarray:
        found = self.parts.pop(kind, None)
        return np.concatenate([np.frombuffer(b, dtype) if dtype == "f8" else unpack(b) for _, b in sorted(found.items())]) if found else np.array([], dtype)

    def own(self) -> np.ndarray:
        """Count times four, and 1 for occurrences outside training, of the block's n-grams."""
        n = np.bincount(self.inverse[self.used], minlength=len(self.unique))
        return n << 2 | (np.bincount(self.inverse[~self.used], minlength=len(self.unique)) > 0)

    def counted(self) -> None:
        """Take the counts of this order from the answers."""
        self.facts = np.zeros(len(self.sent), "i8") if self.sent.all() else self.own()
        self.facts[self.sent] = self.answer(f"c{self.level}", "u8").view("i8")
        facts = self.facts[self.inverse]
        raw, self.shared = facts >> 2, (facts & 2) > 0
        self.c = np.where(raw >= (self.model.least[self.level - 1] if self.level > 1 else 1), raw, 0)
        if self.level == 1:
            self.word_counts = self.c
            self.logp = np.where(self.c > 0, np.log10(np.maximum(self.discounted() * self.model.scale, 1e-300)), self.model.unknown)

    def weight(self) -> np.ndarray:
        return self.model.weights[self.level - 1][np.minimum(self.c, DISCOUNTED + 1)]

    def discounted(self) -> np.ndarray:
        return self.weight() * self.c

    def before(self, x: np.ndarray, start: object) -> np.ndarray:
        """The value at the token before, or at the start of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.start] = start
        return out

    def longer(self) -> None:
        """Go on to n-grams of the next order."""
        self.level += 1
        start = pad(self.level - 1)
        place = np.searchsorted(self.unique, start)
        self.context_keys, self.context_facts = np.insert(self.unique, place, start), np.insert(self.facts, place, self.model.documents << 2 | 3)
        self.context = self.before(self.inverse + (self.inverse >= place), place)
        ask = self.shared & self.before(self.shared, True)
        self.key = joint(self.before(self.key, start), self.key, self.level)
        self.unique, self.inverse = entries(self.key)
        self.sent = np.zeros(len(self.unique), bool)
        self.sent[self.inverse] = ask

    def sums(self) -> tuple[np.ndarray, ...]:
        """By context: discounted mass, what the order below gives to its n-grams, tokens; whether asked for, whether wanted here."""
        size, weight = len(self.context_keys), self.weight()
        context, c = self.context[self.used], self.c[self.used]
        mass = np.bincount(context, weight[self.used], size)
        of, lower = np.bincount(context, minlength=size), self.logp[self.used]
        np.power(10, lower, out=lower)
        lower /= np.maximum(c, 1)
        lower[c == 0] = 0.0
        below = np.bincount(context, lower, size)
        del context, c, lower
        count, shared, outside = self.context_facts >> 2, (self.context_facts & 2) > 0, (self.context_facts & 1) > 0
        weights = self.model.weights[self.level - 1]
        below[~outside & (self.model.least[self.level - 1] == 1)] = 0.0  # nothing backs off from these
        free = 1 + np.flatnonzero(weights[1:] > 1 - 1e-9)[0]  # least count that is not discounted
        wanted = np.bincount(self.context[(self.c == 0) | (weight > 1 - 1e-9)], minlength=size) > 0
        asked = shared & (count > 0) & (outside | (count >= free) | (self.model.least[self.level - 1] > 1)) & ((of > 0) | wanted)
        return mass, below, of, asked, asked & wanted

    def backed_off(self) -> None:
        """Take the contexts' alphas from the answers, and give each token its probability."""
        mass, below, of, asked, wanted = self.sums()
        back, full = backed(mass, below, of)
        got = self.answer(f"b{self.level}", "f8").reshape(-1, 2)
        back[asked], full[asked] = 0.0, False
        back[wanted], full[wanted] = got[:, 0], got[:, 1] > 0
        of = (self.context_facts >> 2) + full
        seen = self.c > 0
        self.logp = np.where(seen, np.log10(np.maximum(self.discounted(), 1e-300) / np.maximum(of, 1)[self.context]), back[self.context] + self.logp)

    def questions(self, kind: str) -> Iterator[dict]:
        """Rows by bucket of n-grams' counts or contexts' sums."""
        if kind == "c":
            own = self.own()
            alone = own[~self.sent] >> 2
            keys, n, extra, low = self.unique[self.sent], (own >> 1 | own & 1)[self.sent], None, counts_of(alone)
        else:
            mass, below, of, asked, wanted = self.sums()
            keys, n, extra, low = self.context_keys[asked], (of << 1 | wanted)[asked], (mass[asked], below[asked]), None
        buckets = 1 << self.model.bits
        bounds = np.r_[0, np.searchsorted(keys, np.arange(1, buckets, dtype="u8") << np.uint64(64 - self.model.bits)) if buckets > 1 else [], len(keys)].astype("i8")
        for bucket in range(buckets):
            i, j = bounds[bucket:bucket + 2]
            if i < j or bucket == 0:
                yield {"bucket": bucket, "block": self.id, "kind": f"{kind}{self.level}", "keys": differences(keys[i:j]), "n": pack(n[i:j]),
                       "sums": pack(np.concatenate([x[i:j] for x in extra])) if extra else None, "low": low if bucket == 0 else None}


def counts_of(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ... DISCOUNTED + 1, how many are positive, and their sum."""
    return [*map(int, np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:DISCOUNTED + 2]), int((c > 0).sum()), int(c.sum())]


@dataclass
class Facts:
    """What workers know of a model."""

    bits: int
    least: tuple[int, ...]
    documents: int = 0
    unknown: float = 0.0
    scale: float = 1.0
    weights: tuple[np.ndarray, ...] = ()


def walk(table: pa.Table, facts: Facts, counted: int, backed_off: int) -> Iterator[tuple[str, Block]]:
    """A block at each of its next questions, having taken the answers of so many orders."""
    block = Block(table, facts)
    while True:
        if block.level > counted:
            yield "c", block
            return
        block.counted()
        if block.level > 1:
            if block.level > backed_off:
                yield "b", block
                break
            block.backed_off()
        if block.level == len(facts.least):
            yield "", block
            return
        block.longer()
    if block.level < len(facts.least):
        block.longer()
        yield "c", block


def asked(parts: DataFrame, facts: Facts, counted: int, backed_off: int) -> DataFrame:
    """Answers to the next questions of all blocks: counts of an order, alphas of the order before."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.string()), ("keys", pa.binary()), ("n", pa.binary()), ("sums", pa.binary()), ("low", pa.list_(pa.int64()))])

    def ask(table: pa.Table) -> pa.Table:
        rows = [row for kind, block in walk(table, facts, counted, backed_off) if kind for row in block.questions(kind)]
        return pa.Table.from_pylist(rows, schema)

    def answer(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        held = {c: [x for x in table.column(c).take(pa.array(order)).to_pylist()] for c in ("block", "kind", "bucket", "keys", "n", "sums", "low")}
        keys = [summed(k) for k in held["keys"]]
        cuts = np.cumsum([len(k) for k in keys])
        every, n = np.concatenate(keys), np.concatenate([unpack(x).view("i8") for x in held["n"]])
        if facts.bits:  # the bits that all keys of a bucket share do not tell them apart
            every = every << np.uint64(facts.bits) | every >> np.uint64(64 - facts.bits)
        unique, inverse = entries(every)
        low = [x for x in held["low"] if x is not None]
        if held["kind"][0][0] == "c":
            c = np.bincount(inverse, n >> 1, len(unique)).astype("i8")
            low.append(counts_of(c))
            value = (c << 2 | (np.bincount(inverse, minlength=len(unique)) > 1) << 1 | (np.bincount(inverse, n & 1, len(unique)) > 0))[inverse]
            bodies = [pack(x) for x in np.split(value, cuts[:-1])]
        else:
            sums = [unpack(x).view("f8").reshape(2, -1) for x in held["sums"]]
            mass, below = (np.bincount(inverse, np.concatenate([s[i] for s in sums]), len(unique)) for i in (0, 1))
            value = np.stack(backed(mass, below, np.bincount(inverse, n >> 1, len(unique))), 1)[inverse]
            bodies = [x[w].tobytes() for x, w in zip(np.split(value, cuts[:-1]), np.split((n & 1) > 0, cuts[:-1]))]
        total = [[int(x) for x in np.sum(low, axis=0)]] if low else [None]
        return pa.table({"block": pa.array(held["block"], "i8"), "kind": held["kind"], "bucket": pa.array(held["bucket"], "i4"), "body": pa.array(bodies, "binary"),
                         "low": pa.array(total + [None] * (len(bodies) - 1), pa.list_(pa.int64()))})

    return parts.groupBy("block").applyInArrow(ask, "bucket int, block long, kind string, keys binary, n binary, sums binary, low array<long>") \
        .groupBy("bucket", "kind").applyInArrow(answer, f"{PART}, low array<long>")


def low_counts(answers: DataFrame, level: int) -> tuple[dict[int, int], int, int]:
    """Counts of counts of an order, its n-grams and their occurrences in training."""
    size = DISCOUNTED + 3
    sums = answers.where((F.col("kind") == f"c{level}") & F.col("low").isNotNull()).agg(*(F.coalesce(F.sum(F.col("low")[i]), F.lit(0)) for i in range(size))).first()
    return {r + 1: int(sums[r]) for r in range(DISCOUNTED + 1)}, int(sums[size - 2]), int(sums[size - 1])


def weights_of(low: dict[int, int]) -> np.ndarray:
    return np.array([0.0, *good_turing(low), 1.0])


def known(parts: DataFrame, *answers: DataFrame) -> DataFrame:
    every = parts.select("block", "kind", "bucket", "body")
    for more in answers:
        every = every.unionByName(more.select("block", "kind", "bucket", "body"))
    return every


def bits_of(parts: DataFrame) -> int:
    size = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(int(size) >> BUCKET_BITS, 0).bit_length()


def row_of(key: Column, text: str) -> Column:
    return F.xxhash64(key.cast("string"), F.col(f"`{text}`"))


def train(texts: DataFrame, order: int = 2, least: tuple[int, ...] = (1, 2), where: Column | None = None, key: Column | None = None) -> Model:
    """Model from column text of all rows, or of those of ``where``; n-grams of order k counted under least[k - 1] are left to backing off.

    Counts of counts include them.  Contexts whose seen n-grams would leave
    nothing are scaled by c(h) / (c(h) + 1), so that no probability is 0.
    With a ``key`` the rows of ``texts`` can be scored without reading them again.
    """
    least = (*least, *[least[-1]] * order)[:order]
    used = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    row = row_of(key, "text") if key is not None else F.lit(0).cast("long")
    parts = settled(encoded(texts.select(row.alias("row"), "text", used.alias("used"))), "lm-texts")
    bits = bits_of(parts)
    words = settled(asked(known(parts), Facts(bits, least), 0, 0), "lm-counts-1")
    low, distinct, total = low_counts(words, 1)
    documents = texts.where(used).count()
    weights = weights_of(low)
    left = sum(n * r * (1 - weights[r]) for r, n in low.items() if r <= DISCOUNTED) / total if total else 1.0
    scale = 1.0
    if left <= 1e-12:
        scale, left = total / (total + 1), 1 / (total + 1)
    return Model(texts, key, parts, words, bits, order, least, total, distinct, documents, math.log10(left), scale / max(total, 1), [weights])


def score(docs: DataFrame, model: Model, key: Column, text: str = "text", head: int | None = None) -> DataFrame:
    """Add n_tokens, n_known, base_score and score to all rows.

    Rows are told apart by a 64-bit hash of ``key`` and text; rows that repeat
    both are added up and divided again.  NULL and empty texts are one end.
    base_score is add-one over single tokens.  Columns of the added names are
    replaced, an empty table gives an empty table, an empty model gives every
    token the unknown probability, 1.

    The texts the model was trained on take part, for they hold its n-grams; if
    ``docs`` is the table it read, each is read once.  ``head`` has no effect:
    no word is hot where a block asks for it once.
    """
    same = model.key is not None and text == "text" and docs.sameSemantics(model.texts)
    kept = docs.drop("n_tokens", "n_known", "base_score", "score").withColumn("_row", row_of(model.key if same else key, text))
    parts, bits, answers = model.blocks, model.bits, [model.words]
    if not same:
        new = settled(encoded(kept.select(F.col("_row").alias("row"), F.col(f"`{text}`").alias("text"), F.lit(False).alias("used"))), "lm-docs")
        parts = parts.withColumn("block", -1 - F.col("block")).unionByName(new)
        bits = bits_of(parts)
        answers = [settled(asked(known(parts), Facts(bits, model.least), 0, 0), "lm-counts-1")]
    weights = list(model.weights)

    def facts() -> Facts:
        return Facts(bits, model.least, model.documents, model.unknown, model.scale, tuple(weights))

    for level in range(2, model.order + 2):
        if model.order > 1:
            answers.append(settled(asked(known(parts, *answers), facts(), level - 1, level - 2), f"lm-counts-{level}"))
        if level <= model.order:
            weights.append(weights_of(low_counts(answers[-1], level)[0]))
    last, unseen = facts(), -math.log10(model.total + model.distinct + 1)

    def run(table: pa.Table) -> pa.Table:
        block = next(block for _, block in walk(table, last, model_order, model_order)) if same or table.column("block")[0].as_py() >= 0 else None
        columns = [np.array([], "i8")] * 5 if block is None else [
            block.rows, *(np.bincount(block.owner, w, len(block.rows)) for w in (block.logp, np.log10(block.word_counts + 1) + unseen, block.word_counts > 0, np.ones(len(block.owner))))]
        return pa.table([pa.array(x.astype(t)) for x, t in zip([*columns, np.ones(len(columns[0]))], ["i8", "f8", "f8", "i8", "i8", "i8"])], names=["row", "score", "base", "known", "n", "copies"])

    model_order = model.order
    every = settled(known(parts, *answers).groupBy("block").applyInArrow(run, "row long, score double, base double, known long, n long, copies long"), "lm-scores")
    whole = every.groupBy("row").agg(*(F.sum(c).alias(f"_{c}") for c in ("score", "base", "known", "n", "copies")))
    share = lambda c: F.col(f"_{c}") / F.col("_copies")
    return kept.join(whole.withColumnRenamed("row", "_row"), "_row").select(
        *(F.col(f"`{c}`") for c in kept.columns if c != "_row"), F.round(share("n")).cast("long").alias("n_tokens"), F.round(share("known")).cast("long").alias("n_known"),
        share("base").alias("base_score"), share("score").alias("score"))
