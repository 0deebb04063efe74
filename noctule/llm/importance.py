"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams.  A bucket's gain is the logarithm of how
much more often the target has it than the raw documents; a document's weight
is the mean of its features' gains.  Documents are drawn without replacement by
the Gumbel top-k trick: weight plus noise that follows from the id, highest
first.

Separators of a text are collapsed to single spaces.  One pattern per n then
scans it with ``overlapped=True``: a match starts behind a space and ends before
one, so every run of n words is a match, whose bytes go to the CRC directly.

Texts are scanned once; their buckets are written (two or four bytes a feature)
and read for the counts and for the weights.  Counts have one row per bucket, a
parameter, so the driver holds ``buckets`` numbers whatever the corpus.  Ranks
come from a sort in ranges and the sums of the ranges before: no task sees all.

Null and empty texts have no features and weight 0.  A null id is the empty
text in the noise and, in ties, behind all others.  Repeated rows are drawn one
by one, in any order.  Empty tables: counts of 0, no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctule.llm.tables import settled

BUCKETS = 10_000
#: Gains, weights and noise are whole thousandths.
SCALE = 1000
SEED = 2024
#: Words are runs of these bytes and of everything beyond ASCII; A-Z is lower-cased.
WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Every byte as it is in a word, or a space.
PLAIN = bytes(c if c in WORD else 32 for c in bytes(range(256)).lower())


def pattern(n: int) -> regex.Pattern:
    """Runs of n words of a text in which each word stands between single spaces."""
    return regex.compile(rb" (" + b" ".join([b"[^ ]+"] * n) + rb")(?= )")


def collapsed(raw: bytes) -> bytes:
    return b" " + b" ".join(raw.translate(PLAIN).split()) + b" "


def crcs(text: bytes, scan: regex.Pattern, buckets: int, unit: np.dtype) -> np.ndarray:
    """Bucket of every match, repeats included."""
    crc = zlib.crc32
    return np.fromiter((crc(m[1]) % buckets for m in scan.finditer(text, overlapped=True)), unit)


def features(docs: DataFrame, text: str, widths: tuple[int, int], buckets: int) -> DataFrame:
    """Rows with their buckets as bytes, n_features and n_words in the place of the text."""
    scans = [pattern(n) for n in range(widths[0], widths[1] + 1)]
    unit = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    @F.arrow_udf("buckets binary, n_features long, n_words long")
    def scanned(texts: pa.Array) -> pa.Array:
        found, n, words = [], [], []
        for raw in texts:
            flat = collapsed(raw.as_py()) if raw.is_valid else b"  "
            got = np.concatenate([crcs(flat, s, buckets, unit) for s in scans])
            found.append(got.tobytes())
            n.append(len(got))
            words.append(0 if flat == b"  " else flat.count(b" ") - 1)
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(n, pa.int64()), pa.array(words, pa.int64())], ["buckets", "n_features", "n_words"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(*rest, scanned(F.col(f"`{text}`").cast("binary")).alias("_f")).select(*rest, "_f.*")


def counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of every bucket over all rows of ``features``."""
    unit = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_py(), unit), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, "i8")
    for bucket, n in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, rounded down."""
    s, t, n = int(raw.sum()), int(target.sum()), len(raw)
    ratio = ((target + 1).astype(float) * (s + n)) / ((raw + 1).astype(float) * (t + n))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], "i8")


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of ``features`` with the mean gain, rounded down, in the place of the buckets."""
    unit = "<u2" if len(gain) <= 1 << 16 else "<u4"

    @F.arrow_udf("long")
    def mean(rows: pa.Array) -> pa.Array:
        return pa.array([int(gain[np.frombuffer(b, unit)].sum()) // (len(b) // np.dtype(unit).itemsize) if b else 0 for b in rows.to_pylist()], pa.int64())

    return found.withColumn("weight", mean("buckets")).drop("buckets")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of a digest of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, draw: int, order: list[Column]) -> DataFrame:
    """Rows with rank 1 to ``draw`` in this order, null for the others.

    The sort is in ranges; a range's ranks start behind those of the ranges
    before it.  Ties beyond the order are split by the row's place in its file.
    """
    spread = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_at"))
    held = settled(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_range").count()
    # one row per range: as many as there are shuffle partitions
    before = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_at"))
    place = (F.col("_before") + F.col("_within")).cast("long")
    whole = held.withColumn("_within", within).join(before, "_range")
    return whole.withColumn("rank", F.when(place <= draw, place)).drop("_at", "_range", "_before", "_within")


def resample(raw: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", widths: tuple[int, int] = (1, 1), buckets: int = BUCKETS,
             percent: int = 10, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank) of every raw document; rank is null where it is not drawn.

    ``percent`` of the documents of at least ``least_words`` words are drawn, rounded down.
    """
    key = F.col(f"`{id}`")
    found = settled(features(raw.select(key.alias("id"), F.col(f"`{text}`").alias("text")), "text", widths, buckets), "features")
    wanted = features(target.select(F.col(f"`{text}`").alias("text")), "text", widths, buckets)
    scored = weights(found, gains(counts(found, buckets), counts(wanted, buckets)))
    scored = settled(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    draw = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    drawn = ranked(scored.where(fit), draw, order)
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).withColumnRenamed("id", id)
