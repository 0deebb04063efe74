"""Language identification by multilingual mixtures.

A language is a distribution over hashed character trigrams within words.  A
text is a mixture: every word comes from one language, and expectation
maximisation estimates how much of the text each language wrote from the
words' trigram likelihoods.  Languages leave the full set one by one, the set
with the best penalised likelihood stays.

Training counts all trigrams of all training rows with partial aggregates.
The model has one row per trigram bucket and language, a size that does not
grow with the corpus; it is the only thing that is gathered and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

BUCKETS = 1 << 15
#: Texts are worked on in blocks of this many characters, a longer text alone.
BLOCK = 1 << 20
MODEL_BYTES = 256 << 20
SMOOTHING = 0.5
ROUNDS = 12
UNDETERMINED = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter, the first letter of every word, the text of every word."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[codes]
    codes = np.where(letter, codes, 32).astype("u4")
    at = np.flatnonzero(letter)
    h = codes[at - 1] * np.uint32(2654435761) + codes[at] * np.uint32(2246822519) + codes[at + 1] * np.uint32(3266489917)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(668265263)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return (h >> np.uint32(17)).astype("i4"), first, np.searchsorted(ends, at[first] - 1, "right")


def blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Positions of texts in runs of about BLOCK characters; NULL and empty texts are left out."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if run and size + len(t) > BLOCK:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(t)
    if run:
        yield run


def learn(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities by bucket, from all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for run in blocks(texts):
                bucket, first, owner = trigrams([texts[i] for i in run])
                names, which = np.unique([langs[i] for i in run], return_inverse=True)
                size = np.diff(np.append(first, len(bucket)))
                both = np.repeat(which[owner], size) * BUCKETS + bucket
                for name, row in zip(names, np.bincount(both, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)):
                    counts[name] = counts[name] + row if name in counts else row
        for name, row in counts.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some), pa.string()), pa.array(some.astype("i4")), pa.array(row[some].astype("i8"))],
                                             names=["lang", "bucket", "n"])

    rows = docs.select(F.col(f"`{text}`"), F.col(f"`{lang}`")).dropna()
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages are more than the model may hold")
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    row = {name: i for i, name in enumerate(languages)}
    np.add.at(table, ([row[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()), found.column("n").to_numpy())
    return languages, np.log(table / table.sum(1, keepdims=True)).astype("f4") if languages else table


def shares(word_ll: np.ndarray, owner: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages and confidence, by text, from word log likelihoods (word, language).

    ``owner`` is the text of each word, 0 to n without gaps.
    """
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    n = np.diff(np.append(start, len(owner)))
    top = word_ll.max(1, keepdims=True)
    w = np.exp(word_ll - top)
    single = np.add.reduceat((word_ll - top).astype("f8"), start)
    lead = single.argmax(1)
    docs, languages = single.shape
    pi = np.eye(languages)[lead]
    best = single[np.arange(docs), lead]
    alone = np.exp(single - best[:, None])
    sure = 1 / alone.sum(1)
    live = np.ones((docs, languages), bool)
    share = np.full((docs, languages), 1 / languages)
    chosen = np.zeros(docs, bool)
    for size in range(languages, 1, -1):
        for _ in range(ROUNDS):
            part = w * share.astype("f4")[owner]
            share = np.add.reduceat(part / np.maximum(part.sum(1, keepdims=True), 1e-30), start) / n[:, None]
        mixed = (w * share.astype("f4")[owner]).sum(1)
        value = np.add.reduceat(np.log(np.maximum(mixed, 1e-30)).astype("f8"), start) - penalty * (live.sum(1) - 1) * np.log(n + 1)
        better = value > best
        best, chosen = np.where(better, value, best), chosen | better
        pi = np.where(better[:, None], share, pi)
        live[np.arange(docs), np.where(live, share, 2).argmin(1)] = False
        share = np.where(live, share, 0)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
    return pi, np.where(chosen, pi.max(1), sure)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 2.0) -> DataFrame:
    """Add lang_pred, score (0 to 1) and lang_shares (language to proportion) to all rows.

    The prediction has the largest proportion; the score is that proportion,
    or the posterior among single languages where one language wrote all.
    NULL texts, texts without a letter and all texts under an empty model are
    ``und`` with score 0.  Repeated rows are predicted alike, columns of the
    added names are replaced.
    """
    spark = docs.sparkSession
    names, table = model
    shared = spark.sparkContext.broadcast((names, table))
    kept = docs.drop("lang_pred", "score", "lang_shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            best, score, parts = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [{} for _ in texts]
            for ids in blocks(texts) if names else ():
                bucket, first, owner = trigrams([texts[i] for i in ids])
                if not len(first):
                    continue
                word_ll = np.stack([np.add.reduceat(row[bucket], first) for row in table], axis=1)
                present, dense = np.unique(owner, return_inverse=True)
                pi, sure = shares(word_ll, dense, penalty)
                for k, row, s in zip(present, pi, sure):
                    i = ids[k]
                    best[i], score[i] = names[row.argmax()], min(1.0, float(s))
                    parts[i] = {names[j]: float(row[j]) for j in np.flatnonzero(row > 0)}
            added = [pa.array(best, pa.string()), pa.array(score), pa.array([list(p.items()) for p in parts], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score", "lang_shares"])

    at = kept.columns.index(text)
    added = [K.StructField("lang_pred", K.StringType()), K.StructField("score", K.DoubleType()), K.StructField("lang_shares", K.MapType(K.StringType(), K.DoubleType()))]
    return kept.mapInArrow(run, K.StructType([*kept.schema.fields, *added]))


def accepted(share: float = 0.4) -> Column:
    """Documents to keep: some language was found and wrote at least this share."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.element_at("lang_shares", F.col("lang_pred")) >= share)
