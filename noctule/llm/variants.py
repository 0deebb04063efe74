"""Spelling variants: words one edit apart, each hung on its most frequent neighbour.

Words of two texts that differ by one inserted, deleted or replaced code point
are found with asymmetric q-chunks.  The shorter word (of equal lengths, the
smaller) gives two disjoint chunks, its halves; the longer gives positional
grams.  One edit leaves a chunk whole, in its place or, behind an insertion,
one further, so a pair meets in a join of chunks with the grams within shift
one, and is then verified.

Halves alone are frequent: on 367,000 words they would compare 85 million
pairs within groups.  So the half that holds the edit gives two chunks in its
turn, and so on until ``HOLE`` code points are left, and the join key is all
that was kept: what lies before the remaining hole, and what lies behind it.
A group then holds words that differ within a hole only.  No pair is lost, and
each is met once per hole that explains it and given out from the first.

Nulls: a text that is null or has no run gives no words; a null id is an empty
text.  Repeated rows count as often as they stand there.  An empty table gives
no rows.  Ties go to the word that is smaller in code-point order.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.llm.tables import settled

#: Words have at least so many code points and occurrences.
LENGTH, OCCURRENCES = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: A run loses a code point when this divides the checksum of id and run.
DAMAGE = 31
#: The part of a word in which an edit is looked for has at most so many code points.
HOLE = 3
#: Different words counted in a task before they are handed on.
HELD = 400_000


def count_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): damaged runs of letters of every text, with their occurrences, before any sum over tasks."""
    # Runs shorter than a word stay short when a code point is deleted.
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{LENGTH},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                seed = zlib.crc32(key.as_py() + b":")
                # bytes.lower() leaves everything beyond A-Z alone
                for word, n in Counter(runs.findall(raw.as_py().lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < LENGTH:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield give()
                    total.clear()
        yield give()

    slim = docs.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(run, "word string, n long")


def vocabulary(counts: DataFrame) -> DataFrame:
    """Words with their sum of occurrences, where large enough."""
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def holes(word: Column, length: Column, shift: int, longer: int = 0) -> Column:
    """What a word keeps beside each hole, as (key, at).

    Keys of chunks for grams ``shift`` further agree with those of grams, whose
    word is ``longer`` than the chunked word's ``length`` by just that.
    """
    parts = F.greatest(F.lit(4), F.pow(F.lit(2.0), F.ceil(F.log2(length / HOLE)))).cast("int")

    def kept(i: Column) -> Column:
        at, until = F.floor(length * i / parts).cast("int"), F.floor(length * (i + 1) / parts).cast("int")
        before, behind = F.substring(word, F.lit(1), at), F.substring(word, until + longer + 1, length)
        return F.struct(F.xxhash64(length, F.lit(shift), i, before, behind).alias("key"), at.alias("at"))

    return F.transform(F.sequence(F.lit(0), parts - 1), kept)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (s, r) of words (word, n) at edit distance one with their n, each pair once."""
    word, length = F.col("word"), F.length("word")
    chunks = words.select("word", "n", F.inline(F.concat(holes(word, length, 0), holes(word, length, 1))))
    # A longer word is met by chunks of words as long as itself or one shorter.
    shorter = F.when(length > LENGTH, holes(word, length - 1, 1, 1)).otherwise(F.array().cast("array<struct<key:bigint,at:int>>"))
    grams = words.select("word", "n", F.inline(F.concat(holes(word, length, 0), shorter)))
    s, r = chunks.select("key", "at", F.col("word").alias("s"), F.col("n").alias("s_n")), grams.select("key", F.col("word").alias("r"), F.col("n").alias("r_n"))
    shift = F.length("r") - F.length("s")
    first = (F.col("at") == 0) | (F.substring(F.col("s"), F.col("at") + 1, F.length("s")) != F.substring(F.col("r"), F.col("at") + shift + 1, F.length("r")))
    found = (s["key"] == r["key"]) & ((shift == 1) | (F.col("s") < F.col("r"))) & first & (F.levenshtein("s", "r", 1) == 1)
    return s.join(r, found).select("s", "s_n", "r", "r_n")


def forms(words: DataFrame) -> DataFrame:
    """Each word with n_near, and the near word of largest n where that is ``RATIO`` times its own."""
    pairs = near_pairs(words)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    ways = pairs.select(F.inline(F.array(side("s", "r"), side("r", "s"))))
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near"))))
    found = ways.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("_b"))
    holds = -F.col("_b.less") >= RATIO * F.col("n")
    return found.select("word", F.when(holds, F.col("_b.near")).alias("form"), "n", "n_near", F.when(holds, -F.col("_b.less")).alias("form_n"))


def roots(found: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words with a form, following forms to the last.

    Every form is ``RATIO`` times as frequent as the word before it, so a chain
    has at most log(most) steps and pointers are doubled a few times.
    """
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = max(1, math.floor(math.log(max(most, OCCURRENCES) / OCCURRENCES, RATIO) + 1e-9))
    for _ in range(math.ceil(math.log2(steps))):
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = settled(links.join(nxt, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "variant-roots")
    return links


def group(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = settled(vocabulary(count_words(docs, id, text)), "variant-words")
    found = settled(forms(words), "variant-forms")
    most = words.agg(F.max("n")).first()[0] or 0
    whole = found.join(roots(found, most), "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
