"""Spelling variants, line de-duplication and importance resampling against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctule.llm import importance, lines, variants

DOCS = "doc_id long, text string"


def alphabet(rng, low, high):
    return "".join(rng.choice("abcdéñß") for _ in range(rng.randrange(low, high)))


# --- spelling variants ---------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    count = Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_docs():
    rng = random.Random(3)
    base = [alphabet(rng, 7, 30) for _ in range(40)]
    docs = []
    for i in range(60):
        words = []
        for w in base:
            for _ in range(rng.randrange(4)):
                at, how = rng.randrange(len(w)), rng.randrange(8)
                words.append({0: w[:at] + w[at + 1:], 1: w[:at] + rng.choice("abé") + w[at:], 2: w[:at] + rng.choice("xyz") + w[at + 1:]}.get(how, w))
        docs.append((i, " ".join(words).title()))
    # a chain of forms, words at the bounds of length and count, ties
    docs += [(100 + i, "chainone " * 2) for i in range(1)] + [(200, "chainonf " * 25 + "chainxnf " * 260 + "abcdef " * 9 + "abcdefg abcdefg " + "solitary")]
    docs += [(300, "tiedwordz " * 2), (301, "tiedworda " * 20 + "tiedwordb " * 20)]
    return docs


def test_variants_equal_brute_force(spark):
    docs = variant_docs() + [(None, "Nullidword " * 3), (None, None), (7000, None), (7001, ""), (7002, "12 3-4 _"), (7003, "a" * 5000 + " " + "a" * 4999 + "b"),
                             (7003, "a" * 5000 + " " + "a" * 4999 + "b"), (7004, "ÀÉÎõüÿ× ÀÉÎõüÿ×÷ ÀÉÎõüÿ×")]
    table = spark.createDataFrame(docs, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = {tuple(r) for r in variants.group(table).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(docs)
    assert got == want
    assert any(w[2] not in (w[0], w[1]) for w in want)  # some root is more than one form away


@pytest.mark.parametrize("length", [7, 8, 9, 12, 13, 24, 25, 40])
def test_every_single_edit_is_met_once(spark, length):
    rng = random.Random(length)
    word = "".join(rng.choice("abcdefgh") for _ in range(length))
    words = {word} | {word[:i] + "z" + word[i + 1:] for i in range(length)} | {word[:i] + c + word[i:] for i in range(length + 1) for c in "zab"}
    words |= {word[:i] + word[i + 1:] for i in range(length)} if length > 7 else set()
    pairs = variants.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).select("s", "r").collect()
    found = Counter(frozenset(p) for p in pairs)
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert set(found) == want and set(found.values()) == {1}


def test_variants_of_an_empty_table(spark):
    assert variants.group(spark.createDataFrame([], DOCS)).count() == 0


# --- lines ---------------------------------------------------------------------

def brute_lines(docs):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    order = lambda d: (d is None, d or 0)
    where = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(d)
    out = []
    for d, text in docs:
        rows = (text or "").split("\n")
        gone = [len(where.get(key(r), ())) >= 2 and min(where[key(r)], key=order) != d for r in rows]
        out.append((str(d), "\n".join(r for r, g in zip(rows, gone) if not g), len(rows), sum(gone)))
    return sorted(out)


def line_docs():
    rng = random.Random(9)
    common = [f"Common line {i} éé" for i in range(12)] + ["ten chars!", "nine char", "éééééééééé", "  padded line here\t"]
    docs = []
    for i in range(150):
        rows = [rng.choice(common).swapcase() if rng.random() < 0.2 else rng.choice(common) for _ in range(rng.randrange(6))]
        rows += [f"own line of {i} number {j}" for j in range(rng.randrange(4))] + [""] * rng.randrange(2)
        rng.shuffle(rows)
        docs.append((i, "\n".join(rows)))
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "Common line 1 éé"), (1003, "common LINE 1 éé\r"), (None, "only without an id, twice"), (None, "only without an id, twice"),
             (None, "Common line 3 éé\nsome other line here"), (1004, "y" * 200_000 + "\n" + "Common line 2 éé"), (1005, "common line 1\x00 éé"), (1006, "common line 1\x00 éé\x1f")]
    return docs


@pytest.mark.parametrize("most", [1 << 29, 64])
def test_lines_equal_brute_force(spark, monkeypatch, most):
    """A filter of one word suspects every line; the result stays."""
    if most == 64:
        monkeypatch.setattr(lines, "n_words", lambda _: 1)
    monkeypatch.setattr(lines, "HELD", 50)
    docs = line_docs()
    table = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(7)
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in lines.dedup(table).collect())
    assert got == brute_lines(docs)


def test_filters_miss_nothing_and_suspect_little(spark):
    docs = [(i, "\n".join(f"line {i} {j} of its own" for j in range(50))) for i in range(400)] + [(5000 + i, f"line {i} 3 of its own") for i in range(0, 400, 5)]
    table = spark.createDataFrame(docs, DOCS).repartition(11)
    known = lines.Filter(lines.repeats(table, "text", lines.n_words(20_080), lines.SHORTEST))
    hashed = lambda i, j: lines.hashes({f"line {i} {j} of its own".encode()})[0]
    assert known.knows(np.array([hashed(i, 3) for i in range(0, 400, 5)], "u8")).all()
    alone = known.knows(np.array([hashed(i, j) for i in range(400) for j in range(50) if j != 3], "u8"))
    assert alone.mean() < 0.02


def test_lines_of_an_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_the_clean_are_not_shuffled(spark):
    """Documents without a suspect come straight from the table that was looked through."""
    docs = spark.createDataFrame([(i, f"a line that only {i} has") for i in range(20)] + [(99, "a line that only 3 has")], DOCS)
    out = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup(docs).collect()}
    assert out[99] == ("", 1) and all(out[i] == (f"a line that only {i} has", 0) for i in range(20))


# --- importance ------------------------------------------------------------------

def brute_importance(docs, bench, widths=(1, 1), buckets=10_000, percent=10, least=20):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda t: [" ".join(w[i:i + n]) for w in [words(t)] for n in range(widths[0], widths[1] + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    raw, target = Counter(bucket(g) for _, t in docs for g in grams(t)), Counter(bucket(g) for t in bench for g in grams(t))
    s, t = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    rows = []
    for d, text in docs:
        g = [gain(bucket(x)) for x in grams(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    draw = percent * len(fit) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(fit) if i < draw}
    return sorted(tuple(str(x) for x in (*r, ranks.get(id(r)))) for r in rows)


def importance_docs():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["Alpha", "béta", "GAMMA-delta", "x1", "ÉPSILON", "_", "·", "zz top"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    return docs + [(900, None), (901, ""), (902, "..!\n"), (903, "word " * 50_000), (904, "one two\tthree\x7ffour\x00five"), (905, " ".join("abcdefghijklmnopqrs"))]


@pytest.mark.parametrize("widths", [(1, 1), (1, 3), (2, 2)])
def test_importance_equals_brute_force(spark, widths):
    docs, bench = importance_docs(), ["alpha béta x1 " * 9, None, "", "unheard of words", "Épsilon alpha"]
    raw = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash")).withColumn("buckets", F.lit(1)).repartition(5)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    out = importance.resample(raw, target, widths=widths)
    got = sorted(tuple(str(r[c]) for c in ("doc_id", "n_features", "n_words", "weight", "score", "rank")) for r in out.collect())
    assert got == brute_importance(docs, bench, widths)


def test_repeated_and_nameless_rows_are_drawn_one_by_one(spark):
    docs = [(1, "a b c " * 10)] * 60 + [(None, "d e f " * 10)] * 60 + [(2, "g h i " * 10)] * 80
    target = spark.createDataFrame([(0, "a b")], "item_id long, text string")
    out = importance.resample(spark.createDataFrame(docs, DOCS).repartition(6), target, percent=55).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 111))
    ordered = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in ordered] == sorted((r.score for r in ordered), reverse=True)


def test_importance_of_empty_tables(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, target).count() == 0
    out = importance.resample(spark.createDataFrame([(1, "a " * 30)], DOCS), target, percent=100).collect()
    assert [(r.n_features, r["rank"]) for r in out] == [(30, 1)]


@pytest.mark.parametrize("text, n, want", [("A b--C", 1, ["a", "b", "c"]), ("A b--C", 2, ["a b", "b c"]), ("A b--C", 3, ["a b c"]), ("A b", 3, []), ("", 1, []), ("a a a a", 2, ["a a"] * 3)])
def test_overlapped_scanning(text, n, want):
    flat = importance.collapsed(text.encode())
    assert [m[1].decode() for m in importance.pattern(n).finditer(flat, overlapped=True)] == want
