"""Jaccard self-join of texts' word n-grams by chosen paths.

Texts are sets of 5-word shingles.  Equal texts are one set.  A set is sketched
by MinHash: coordinate i is the least shingle under hash i, so two sets share
a coordinate with probability equal to their similarity.

A run splits the sets on sampled coordinates, each taken with probability
1 / (threshold * coordinates), into buckets that share its token; a bucket
that is too large is split again on coordinates sampled from its own path.
Small buckets are compared by brute force on sketches.  In a large bucket all
sets are compared with a pivot first: those near it are linked and leave, as
the triangle inequality has everything similar to them linked to the pivot
too.  So a large group of near copies goes in one step rather than being split
in vain.  Runs are repeated until a pair at the threshold, at the depth that
was reached, is met with the target recall.

Buckets give candidates only, as stars.  Every connected group of candidates
is then compared exactly, all pairs, on whole shingle sets, in blocks of
bounded size; only counts and spanning links leave a block, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.llm.components import components
from noctule.llm.hashing import blocks, groups, labels, mixed, starts, word_hashes
from noctule.llm.tables import settled

WIDTH = 5
COORDINATES = 64
#: Buckets up to this size are compared by brute force.
SMALL = 4096
#: Groups up to this size are compared pair by pair, larger ones coordinate by coordinate.
PAIRED = 48
#: Shares of equal coordinates: candidates of a small bucket; linked to a pivot; leaving with it.
LIKELY, LINKED, LEAVING = 0.55, 0.35, 0.75
#: Sets in a block of the exact comparison, shingles in a step of it.
BLOCK, STEP = 512, 8192
#: Candidates' keys are broadcast up to this many bytes, else texts are shuffled to them.
BROADCAST = 32 << 20
SEED = 0x5851F42D4C957F2D


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and the text it is in; texts of fewer words are one shingle, those of none have none."""
    h, owner = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    sizes = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    base = np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(max(0, len(h) - width + 1), "u8")
    for k in range(width):
        total = total * base + h[k:len(h) - width + 1 + k]
    inside = owner[:len(total)] == owner[width - 1:] if len(total) else np.array([], bool)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    few = np.array([sum((int(h[first[i] + k]) * int(base) ** (k + 1) for k in range(sizes[i])), int(sizes[i])) & 0xFFFFFFFFFFFFFFFF for i in short], "u8")
    hashes, who = np.r_[mixed(total[inside]), mixed(few)], np.r_[owner[:len(total)][inside], short]
    if len(short):
        order = np.argsort(who, kind="stable")
        hashes, who = hashes[order], who[order]
    return hashes, who


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(fp, id, sketch) of every row of (fp, id, text) with a word."""
    odd = mixed(np.arange(1, COORDINATES + 1, dtype="u8") * np.uint64(SEED))
    factor, shift = (odd >> np.uint64(32)).astype("u4") | np.uint32(1), odd.astype("u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                hashes, who = shingles(texts, width)
                if len(hashes):
                    x, first = (hashes >> np.uint64(32)).astype("u4"), np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                    least = np.stack([np.minimum.reduceat(x * a + b, first) for a, b in zip(factor, shift)], axis=1)
                    some = batch.slice(rows.start, rows.stop - rows.start).take(pa.array(who[first]))
                    flat = pa.array(least.view("i4").ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype="i4") * COORDINATES), flat)
                    yield pa.RecordBatch.from_arrays([some.column("fp"), some.column("id"), lists], names=["fp", "id", "sketch"])

    return docs.select("fp", "id", "text").mapInArrow(run, "fp binary, id long, sketch array<int>")


def brute_force(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the candidates in small buckets (key, fp, sketch), as stars on the least of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key"]):
            first = starts(table, ["key"])
            sizes = np.diff(np.append(first, len(table)))
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            left, right = [], []
            for at, size in zip(first[sizes > PAIRED], sizes[sizes > PAIRED]):
                group, shared = np.ascontiguousarray(sketch[at:at + size].T), np.zeros((size, size), "u1")
                for row in group:
                    shared += row[:, None] == row[None, :]
                x, y = np.nonzero(np.triu(shared >= LIKELY * COORDINATES, 1))
                least = labels(size, x, y)
                left.append(at + least)
                right.append(at + np.arange(size))
            for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRED)]):
                at = first[sizes == size]
                i, j = np.triu_indices(size, 1)
                step = max(1, 65_536 // len(i))
                for low in range(0, len(at), step):
                    base = at[low:low + step, None]
                    a, b = (base + i).ravel(), (base + j).ravel()
                    for k in range(0, len(a), 65_536):
                        x, y = a[k:k + 65_536], b[k:k + 65_536]
                        near = (sketch[x] == sketch[y]).sum(1) >= LIKELY * COORDINATES
                        left.append(x[near])
                        right.append(y[near])
            if left:
                least = labels(len(table), np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(least != np.arange(len(table)))
                fp = table.column("fp").combine_chunks()
                yield pa.RecordBatch.from_arrays([fp.take(pa.array(least[moved])), fp.take(pa.array(moved))], names=["a", "b"])

    return rows.select("key", "fp", "sketch").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a binary, b binary")


def chosen(path: Column, threshold: float) -> Column:
    """Coordinates that a path samples, each with probability 1 / (threshold * coordinates)."""
    grain = 1_000_000
    return F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.pmod(F.xxhash64(path, i), F.lit(grain)) < int(grain / (threshold * COORDINATES)))


def bucketed(rows: DataFrame, threshold: float) -> DataFrame:
    """Buckets (key, fp, n) of the children of all paths (path, fp, sketch) that hold two sets or more."""
    children = F.transform(chosen(F.col("path"), threshold), lambda i: F.xxhash64("path", i, F.get("sketch", i)))
    keys = rows.select("fp", F.explode(children).alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return settled(keys.join(sizes, "key"), "paths")


def candidates(reps: DataFrame, threshold: float, first_run: int, runs: int) -> tuple[list[DataFrame], int]:
    """Candidate links of some runs, and the depth that was reached."""
    roots = F.explode(F.array(*(F.lit(r) for r in range(first_run, first_run + runs))))
    level = bucketed(reps.select("fp", "sketch", roots.alias("run")).select("fp", "sketch", F.xxhash64("run", F.lit(SEED)).alias("path")), threshold)
    found, depth = [], 1
    while True:
        sketched = level.join(reps.select("fp", "sketch"), "fp")
        found.append(settled(brute_force(sketched.where(F.col("n") <= SMALL)).distinct(), "candidates"))
        if level.where(F.col("n") > SMALL).isEmpty():
            return found, depth
        large = sketched.where(F.col("n") > SMALL)
        pivots = large.groupBy("key").agg(F.min(F.struct("fp", "sketch")).alias("pivot"))
        shared = F.size(F.filter(F.arrays_zip(F.col("sketch").alias("x"), F.col("pivot.sketch").alias("y")), lambda z: z["x"] == z["y"])) / COORDINATES
        near = settled(large.join(pivots, "key").select(F.col("key").alias("path"), "fp", F.col("pivot.fp").alias("pivot"), shared.alias("shared")), "pivots")
        found.append(settled(near.where((F.col("shared") >= LINKED) & (F.col("fp") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct(), "candidates"))
        level = bucketed(near.where(F.col("shared") < LEAVING).join(reps.select("fp", "sketch"), "fp").select("path", "fp", "sketch"), threshold)
        depth += 1


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is met with this probability at this depth."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def compare(cells: DataFrame, threshold: float) -> DataFrame:
    """(fp, links, lead, blocks) of the sets in cells (comp, bi, bj, blocks, fp, block, copies, set) that have a link there.

    ``links`` counts rows at or above the threshold in the cell's pairs,
    ``lead`` is the least set linked in the cell, directly or not.
    """

    def linked(sizes: np.ndarray, sets: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(m), sizes)
        _, ids, n = np.unique(sets, return_inverse=True, return_counts=True)
        often = np.cumsum(n > 1) - 1
        keep = n[ids] > 1
        owner, ids = owner[keep], often[ids[keep]]
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        shared = np.zeros((m, m), "f4")
        for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, STEP):
            a, b = np.searchsorted(ids, (low, low + STEP))
            has = np.zeros((m, min(STEP, int(ids[-1]) + 1 - low)), "f4")
            has[owner[a:b], ids[a:b] - low] = 1
            shared += has @ has.T
        i, j = np.nonzero(np.triu(shared, 1))
        both = shared[i, j].astype("f8")
        near = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        return i[near], j[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["comp", "bi", "bj"]):
            first = starts(table, ["comp", "bi", "bj"])
            sets = table.column("set").combine_chunks()
            values, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy()
            offsets = offsets - offsets[0]
            block, copies, cross = (table.column(c).to_numpy() for c in ("block", "copies", "bj"))
            cross = cross != table.column("bi").to_numpy()
            least, count = np.arange(len(table)), np.zeros(len(table), "i8")
            for a, b in zip(first, np.append(first[1:], len(table))):
                i, j = linked(np.diff(offsets[a:b + 1]), values[offsets[a]:offsets[b]], b - a)
                if cross[a]:
                    differ = block[a + i] != block[a + j]
                    i, j = i[differ], j[differ]
                if len(i):
                    least[a:b] = a + labels(b - a, i, j)
                    np.add.at(count, a + i, copies[a + j])
                    np.add.at(count, a + j, copies[a + i])
            some = pa.array(np.flatnonzero(count))
            fp = table.column("fp").combine_chunks()
            yield pa.RecordBatch.from_arrays([fp.take(some), pa.array(count[count > 0]), fp.take(pa.array(least[count > 0])), table.column("blocks").combine_chunks().take(some)],
                                             names=["fp", "links", "lead", "blocks"])

    return cells.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "fp").mapInArrow(run, "fp binary, links long, lead binary, blocks int")


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """Replace text by set, the sorted distinct shingles."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch, "text"):
                hashes, who = shingles(texts, width)
                order = np.lexsort((hashes, who))
                hashes, who = hashes[order], who[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])] if len(who) else np.array([], bool)
                bounds = np.append(0, np.cumsum(np.bincount(who[new], minlength=len(texts)))).astype("i4")
                some = batch.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[new].view("i8")))], names=[*others, "set"])

    kinds = dict(rows.dtypes)
    return rows.select(*others, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", set array<bigint>")


def prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumns({"id": F.col(f"`{key}`").cast("long"), "fp": F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))})


def limited(rows: DataFrame, row_bytes: int) -> DataFrame:
    """Ask for a broadcast of a stored table if its counted rows are few enough; else Spark shuffles."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST else rows


def classes(rows: DataFrame, threshold: float, width: int, recall: float) -> DataFrame:
    """(fp, least, copies, n_links, class_key, class_id, head) of every text with a word in rows (fp, id, text).

    ``least`` is the text's least id, ``class_id`` its class's; ``head`` is the
    fp of the class's text that has it, NULL ids last.
    """
    reps = settled(sketches(rows, width).groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.any_value("sketch").alias("sketch")), "sets")
    found, done, needed = [], 0, runs_needed(recall, 1)
    while done < needed:
        more, depth = candidates(reps, threshold, done, needed - done)
        found += more
        done, needed = needed, max(needed, runs_needed(recall, depth))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    stars = components(links)
    members = stars.select(F.col("node").alias("fp"), F.col("least").alias("comp")).unionByName(stars.select(F.col("least").alias("fp"), F.col("least").alias("comp")).distinct())
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = settled(members.join(sizes, "comp").join(reps.select("fp", "copies", "id"), "fp").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int")), "members")
    texts = rows.select(F.col("id").alias("_id"), "fp", "text").join(limited(members, 80), "fp").where(F.col("_id").eqNullSafe(F.col("id"))).drop("_id", "id").dropDuplicates(["fp"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("bi"), F.greatest(b, "block").alias("bj")))
    cells = shingle_sets(texts, width).withColumn("cell", F.explode(pairs)).select("comp", "cell.*", "blocks", "fp", "block", "copies", "set")
    exact = settled(compare(cells, threshold), "links")
    many = components(exact.where("blocks > 1").select(F.col("lead").alias("a"), F.col("fp").alias("b")))
    leads = exact.groupBy("fp").agg(F.sum("links").alias("links"), F.min("lead").alias("lead")) \
        .join(many.select(F.col("node").alias("fp"), F.col("least").alias("_lead")), "fp", "left").select("fp", "links", F.coalesce("_lead", "lead").alias("lead"))
    sets = settled(reps.select("fp", "copies", "id").join(leads, "fp", "left").select(
        "fp", F.col("id").alias("least"), "copies", F.coalesce("lead", "fp").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    heads = sets.groupBy("class_key").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("head")) \
        .select("class_key", F.col("head.least").alias("class_id"), F.col("head.fp").alias("head"))
    return settled(sets.join(heads, "class_key"), "classes")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = WIDTH, recall: float = 0.9999) -> DataFrame:
    """(key, class_id, n_links, class_key) for every row.

    ``n_links`` is the number of other rows whose similarity reaches the
    threshold, copies included.  ``class_id`` is the least key among the rows
    that links connect; ``class_key`` tells classes apart where keys are NULL.
    Texts without a word (NULL, empty, blank) are linked to nothing and are
    classes of their own, with a NULL class_key.  Texts of fewer words than
    ``width`` are one shingle.  Other columns do not matter; an empty table
    gives an empty table.
    """
    rows = prepared(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")), "_key", "text").drop("_key")
    sets = classes(rows, threshold, width, recall).select("fp", "class_id", "n_links", "class_key")
    out = rows.select("id", "fp").join(sets, "fp", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = WIDTH, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs`` that are their class's first: of the least key, one where rows repeat it.

    Texts without a word are all kept.  Only texts with copies or links are
    looked at again; the others pass a filter.
    """
    marked = prepared(docs.withColumnsRenamed({c: f"_of_{c}" for c in docs.columns}), f"_of_{key}", f"_of_{text}")
    sets = classes(marked.select("id", "fp", F.col(f"`_of_{text}`").alias("text")), threshold, width, recall)
    grouped = sets.where((F.col("n_links") > 0) | (F.col("copies") > 1))
    again = settled(grouped.select("fp"), "grouped")
    heads = settled(grouped.where("fp = head").select("fp", "least"), "heads")
    alone = marked.join(limited(again, 24), "fp", "left_anti")
    first = marked.join(limited(heads, 32), "fp").where(F.col("id").eqNullSafe(F.col("least"))).drop("least").dropDuplicates(["fp"])
    return alone.unionByName(first).select(*(F.col(f"`_of_{c}`").alias(c) for c in docs.columns))
