"""Line de-duplication across documents with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased.  A
key in two documents or more stays in the smallest of them only.

1. Every task puts the hashes of its lines into two filters: seen once, and
   seen again.  Filters are merged block by block: what both sides saw once was
   seen twice.  Only filter blocks are shuffled.
2. Every line is looked up in the second filter.  A line that it does not know
   is in one document; most are, and go no further.
3. Only suspected repeats are shuffled, as SHA-256 digests of their keys: an
   aggregate confirms the repeat and finds the first document, a join says which
   documents lose the line.  Documents with a suspect then meet their decisions;
   the others are not shuffled at all.

Filters have 16 to 32 bits a line up to ``MOST_BITS``, which bounds what is
broadcast and what a task holds; with more lines they fill, more lines are
suspected and more digests are shuffled, but the result is the same, since a
filter never misses.

Documents: a null text is one empty line.  Rows of the same id are one
document; rows without an id are one document too, behind all others.  An empty
table gives no rows; only id and text of the input are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctule.llm.tables import settled

#: Keys of fewer code points never repeat.
SHORTEST = 10
WHITE = b" \t\n\x0b\x0c\r"
#: Bits a line, and bounds of a filter's bits.
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
#: Words of a filter that are shuffled as one row.
PIECE = 1 << 13
#: Hashes that a task gathers before it puts them into its filters.
HELD = 1 << 18


def keys(raw: bytes, shortest: int = SHORTEST) -> list[bytes | None]:
    """Key of every line, None where it is too short to count; UTF-8 code points have up to four bytes."""
    out: list[bytes | None] = []
    for line in raw.split(b"\n"):
        key = line.strip(WHITE).lower()
        out.append(key if len(key) > 4 * (shortest - 1) or len(key.decode("utf-8", "replace")) >= shortest else None)
    return out


def hashes(found: set[bytes | None]) -> list[int]:
    found.discard(None)
    return [xxhash.xxh3_64_intdigest(k) for k in found]


class Filter:
    """Bloom filter of 64-bit words: a hash has four bits, all in one word."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (h >> np.uint64(24)) & np.uint64(len(self.words) - 1)
        bits = np.zeros(len(h), "u8")
        for shift in (0, 6, 12, 18):
            bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
        return at.astype("i8"), bits

    def add(self, h: np.ndarray) -> None:
        np.bitwise_or.at(self.words, *self.place(h))

    def knows(self, h: np.ndarray) -> np.ndarray:
        at, bits = self.place(h)
        return (self.words[at] & bits) == bits


def n_words(lines: int) -> int:
    bits = min(max(BITS * lines, LEAST_BITS), MOST_BITS)
    return 1 << ((bits - 1).bit_length() - 6)


def repeats(docs: DataFrame, text: str, size: int, shortest: int) -> np.ndarray:
    """Filter of what was seen in two documents, from whole texts; its size is bounded by MOST_BITS."""
    fields = "piece long, once binary, twice binary"

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(np.zeros(size, "u8")), Filter(np.zeros(size, "u8"))
        held: list[int] = []

        def put() -> None:
            h, n = np.unique(np.array(held, "u8"), return_counts=True)
            twice.add(h[(n > 1) | once.knows(h)])
            once.add(h)
            held.clear()

        for batch in batches:
            for raw in batch.column(0):
                held.extend(hashes(set(keys(raw.as_py(), shortest))) if raw.is_valid else ())
                if len(held) >= HELD:
                    put()
        put()
        for i in range(0, size, PIECE):
            part = once.words[i:i + PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()]), pa.array([twice.words[i:i + PIECE].tobytes()])], ["piece", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, once, twice = None, None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([twice.tobytes()])], ["piece", "twice"])
        for batch in batches:
            for i, a, b in zip(*batch.columns, strict=True):
                a, b = np.frombuffer(a.as_py(), "u8"), np.frombuffer(b.as_py(), "u8")
                if i.as_py() == piece:
                    twice |= b | (once & a)
                    once |= a
                else:
                    if piece is not None and twice.any():
                        yield give()
                    piece, once, twice = i.as_py(), a.copy(), b.copy()
        if piece is not None and twice.any():
            yield give()

    spark = docs.sparkSession
    # a filter per task: as many tasks as the cluster works on twice over, whatever the number of files
    tasks = 2 * spark.sparkContext.defaultParallelism
    parts = docs.select(F.col(f"`{text}`").cast("binary")).coalesce(tasks).mapInArrow(gathered, fields)
    whole = parts.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(merged, "piece long, twice binary")
    words = np.zeros(size, "u8")
    for row in whole.toLocalIterator():
        part = np.frombuffer(row["twice"], "u8")
        words[row["piece"]:row["piece"] + len(part)] = part
    return words


def count_lines(text: str) -> F.Column:
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return (F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n"), F.lit(""))) + 1).cast("long")


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row: the text without lines that stand in an earlier document."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    lines = slim.agg(F.sum(count_lines("text"))).first()[0] or 0
    known = spark.sparkContext.broadcast(repeats(slim, "text", n_words(lines), shortest))

    @F.arrow_udf("array<binary>")
    def suspects(texts: pa.Array) -> pa.Array:
        seen, out = Filter(known.value), []
        for raw in texts:
            found = list(set(keys(raw.as_py(), shortest)) - {None}) if raw.is_valid else []
            hit = seen.knows(np.array([xxhash.xxh3_64_intdigest(k) for k in found], "u8"))
            out.append([hashlib.sha256(found[i]).digest() for i in np.flatnonzero(hit)])
        return pa.array(out, pa.list_(pa.binary()))

    @F.arrow_udf("text string, n_dropped long")
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, dropped = [], []
        for raw, gone in zip(texts, drops, strict=True):
            raw, gone = raw.as_py(), set(gone.as_py())
            stay = [line for line, key in zip(raw.split(b"\n"), keys(raw, shortest), strict=True) if key is None or hashlib.sha256(key).digest() not in gone]
            kept.append(b"\n".join(stay))
            dropped.append(raw.count(b"\n") + 1 - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(dropped, pa.int64())], ["text", "n_dropped"])

    looked = settled(slim.withColumn("n_lines", count_lines("text")).withColumn("suspects", suspects(F.col("text").cast("binary")))
                     .withColumn("row", F.monotonically_increasing_id()), "line-suspects")
    dirty = looked.where(F.size("suspects") > 0)
    said = dirty.select("row", "id", F.explode("suspects").alias("digest"))
    places = said.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("unnamed"))
    # written, so that the join reads plain shuffles, of which a hot digest's can be split
    repeated = settled(places.where("first <> last OR unnamed AND first IS NOT NULL").select("digest", "first"), "line-repeats")
    drops = said.join(repeated, "digest").where("id IS NULL OR id <> first").groupBy("row").agg(F.collect_list("digest").alias("drops"))
    cut = dirty.join(drops, "row", "left").withColumn("cut", F.when(F.col("drops").isNotNull(), without(F.col("text").cast("binary"), F.coalesce("drops", F.array().cast("array<binary>")))))
    mended = cut.select("id", F.when(F.col("drops").isNotNull(), F.col("cut.text")).otherwise(F.col("text")).alias("text"), "n_lines", F.coalesce("cut.n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    clean = looked.where(F.size("suspects") == 0).select("id", F.coalesce("text", F.lit("")).alias("text"), "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    return clean.unionByName(mended).withColumnRenamed("id", id)
