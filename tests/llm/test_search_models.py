"""Jaccard join, backoff model, nearest neighbours and pieces against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctule import session
from noctule.llm import backoff, components, jaccard, pieces, polytope
from noctule.llm.queries import PIECES, QUERIES

ROOT = "/root/testdata/sf0.001"


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    classes = {}
    for i, r in enumerate(root):
        classes.setdefault(r, []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in classes.items()}
    return sorted((str(rows[i][0]), str(least[root[i]]), len(links[i])) for i in range(len(rows))), len(classes)


def near_copies(n, words=60, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    return docs + [(1000 + i, t) for i, t in enumerate(near_copies(80))] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "a  b"), (2005, "b a"), (None, "a b"), (None, "q"), (2006, "q")]


@pytest.mark.parametrize("small, block", [(256, 512), (8, 16)])
def test_jaccard_join_finds_every_link(spark, texts, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = spark.createDataFrame([(i, t, 3, "x") for i, t in texts], "doc_id long, text string, n_links int, fp string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard.join(rows).collect())
    assert got == brute_links(texts)[0]


def test_one_of_each(spark, texts):
    rows = texts + texts[:3]  # repeated rows
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, least int")).collect()
    assert len(kept) == brute_links(rows)[1] and kept[0].__fields__ == ["doc_id", "text", "least"]
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} <= {i for i, _ in texts}


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(empty).collect() == [] and jaccard.one_of_each(empty).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a int, b int")).collect()))
    root = {x: x for p in pairs for x in p}
    for _ in range(500):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + ["</s>"]


def brute_model(texts, order, least):
    """The textbook recursion over dictionaries."""
    counts = [Counter() for _ in range(order)]
    for t in texts:
        w = ["<s>"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(w)):
            for k in range(order):
                counts[k][tuple(w[i - k:i + 1])] += 1
    total = sum(counts[0].values())
    discounts = [backoff.good_turing(Counter(c.values())) for c in counts]
    cut = lambda k, c: c * (discounts[k][c - 1] if c <= 5 else 1)
    first = {g: cut(0, c) / total for g, c in counts[0].items()}
    unknown = 1 - sum(first.values())

    def prob(h, w):
        if not h:
            return first.get((w,), unknown)
        k = len(h)
        seen = {g[-1]: c for g, c in counts[k].items() if g[:-1] == h and c >= least[k]}
        if not seen:
            return prob(h[1:], w)
        of = sum(c for g, c in counts[k].items() if g[:-1] == h)
        mass = sum(cut(k, c) for c in seen.values())
        of += mass / of > 1 - 1e-9
        if w in seen:
            return cut(k, seen[w]) / of
        return (1 - mass / of) / (1 - sum(prob(h[1:], x) for x in seen)) * prob(h[1:], w)

    return prob, counts, total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_against_the_recursion(spark, order):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("the The a of x y z w v u T".split()) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randrange(40))) for _ in range(40)] + [None, "", " \n"]
    held = ["the new of x", "a a a unseen", None, "the the"]
    least = (1, 2, 2)[:order]
    prob, counts, total = brute_model(texts, order, least)
    model = backoff.train(spark.createDataFrame([(t,) for t in texts], "text string"), order, least)
    assert model.total == total and model.distinct == len(counts[0])
    rows = [(i, t, 0) for i, t in enumerate(texts + held)] + [(0, texts[0], 0)]
    got = backoff.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model, F.col("doc_id"), head=5).collect()
    assert len(got) == len(rows)
    for r in got:
        w = tokens(r["text"])
        padded = ["<s>"] * (order - 1) + w
        want = sum(math.log10(prob(tuple(padded[i:i + order - 1]), x)) for i, x in enumerate(w))
        assert r["score"] == pytest.approx(want, rel=1e-9) and r["n_tokens"] == len(w)
        assert r["n_known"] == sum((x,) in counts[0] for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[0][(x,)] + 1) / (total + len(counts[0]) + 1)) for x in w), rel=1e-9)
    for h in [("<s>",) * (order - 1), *list(counts[order - 1])[:5]]:  # probabilities of a context sum to 1
        h = tuple(h)[:order - 1]
        assert sum(prob(h, w) for (w,) in counts[0]) + prob(h, "never seen") == pytest.approx(1)


def test_the_registered_model_counts_all_trigrams(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the of x y z w v u".split()) + rng.choice(["", "", str(rng.randrange(20))]) for _ in range(rng.randrange(30)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prob, counts, _ = brute_model([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3, (1, 1, 1))
    assert 1 in counts[1].values() and 1 in counts[2].values()
    got = {r["doc_id"]: r["score"] for r in QUERIES["op7_katz_backoff"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        w = tokens(t)
        padded = ["<s>", "<s>", *w]
        assert got[i] == pytest.approx(sum(math.log10(prob(tuple(padded[k:k + 2]), x)) for k, x in enumerate(w)), rel=1e-9)


def test_no_table_of_ngrams_is_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backoff, "BUCKET_BITS", 12, raising=False)  # several buckets
    monkeypatch.setattr(session, "scratch_root", lambda spark: f"{tmp_path}/scratch")
    rng = random.Random(4)
    rows = [(i, " ".join(str(int(2_000 * rng.random() ** 3)) for _ in range(150))) for i in range(300)] + [(1000 + i, "a very common line of words") for i in range(50)] + [(None, None), (None, "a very")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_tokens"], r["score"]) for r in QUERIES["op7_katz_backoff"](spark, str(tmp_path)).collect()]
    prob, _, total = brute_model([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], 3, (1, 1, 1))
    want = []
    for i, t in rows[::50] + rows[-2:]:
        w = ["<s>", "<s>", *tokens(t)]
        want.append((i, len(w) - 2, sum(math.log10(prob(tuple(w[k - 2:k]), w[k])) for k in range(2, len(w)))))
    close = lambda a, b: a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
    assert len(got) == len(rows) and all(any(close(g, x) for g in got) for x in want)
    data = [f for f in (tmp_path / "scratch").rglob("*.parquet") if f.stat().st_size > 5_000]  # leaves out what is mostly footer
    assert data and sum(f.stat().st_size for f in data) < 24 * total


def test_texts_read_with_the_model_score_as_any_others(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BUCKET_BITS", 5)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of x y z".split()) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randrange(60))), i % 3 > 0) for i in range(60)] + [(1, None, True), (1, None, True), (None, "the x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mine boolean").repartition(5)
    for least in [(1, 1, 1), (1, 2, 2)]:
        together = backoff.score(docs, backoff.train(docs, 3, least, F.col("mine"), F.col("doc_id")), F.col("doc_id")).collect()
        apart = backoff.score(docs, backoff.train(docs.where("mine"), 3, least), F.col("doc_id")).collect()
        a, b = (sorted(((str(r["doc_id"]), str(r["text"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in x)) for x in (together, apart))
        assert len(a) == len(b) == len(rows)
        for x, y in zip(a, b):
            assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)


def test_sorting_where_keys_agree_in_high_bits():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 50, 5_000).astype("u8")
    unique, inverse = backoff.entries(key)
    assert (unique == np.unique(key)).all() and (unique[inverse] == key).all()
    for x in (key, np.array([], "u8"), np.array([0, 2 ** 64 - 1], "u8")):
        assert (backoff.unpack(backoff.pack(x)) == x).all()


def test_backoff_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = backoff.train(empty)
    assert backoff.score(empty, model, F.col("doc_id")).collect() == []
    assert backoff.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, F.col("doc_id")).first()["score"] == 0


def nearest(ids, v, q, k=5):
    n = np.sqrt((v * v).sum(1))
    score = (v * v[q]).sum(1) / (n * n[q])
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_recall_and_scores_of_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in polytope.search(rows, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    table = rows.toPandas()
    ids, v = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype("f8")
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = dict(nearest(ids, v, q, len(ids)))
        mine = got[ids[q]]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(want[i] - s) < 1e-14 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for i, _ in nearest(ids, v, q)})
    assert hits >= 0.9 * 5 * len(got)


def test_few_bad_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(polytope, "BLOCK_VECTORS", 4)
    monkeypatch.setattr(polytope, "BLOCK_QUERIES", 1)
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]), (3, None), (4, [0.0] * 3), (5, [float("nan"), 1.0, 1.0]), (6, [None, 1.0, 2.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (8, [])]
    rows += [(100 + i, [3.0, 0.0, 0.0]) for i in range(1, 40)] + [(1, [2.0, 0.0, 0.0])]
    data = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = polytope.search(data, data.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 101), (0, 3, 102), (0, 4, 103), (0, 5, 104), (50, 1, 0), (50, 2, 1), (50, 3, 101), (50, 4, 102), (50, 5, 103)]
    some = data.where("vec_id in (0, 1, 7)")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in polytope.search(some, some.where("vec_id = 0")).collect()] == [(0, 1, 1.0)]
    assert polytope.search(data.limit(0), data.limit(0)).collect() == []


def test_more_hashes_on_clustered_vectors(spark):
    """A second hash leaves fewer candidates; twice the tables and probes hold the recall."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    data = centres[rng.integers(0, 60, 4000)] + 0.45 * rng.normal(size=(4000, 32))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 50 = 0")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    seen = {}
    for hashes in (1, 2):
        got = {}
        for r in polytope.search(table, queries, hashes=hashes).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in range(0, 4000, 50):
            near = unit @ unit[q]
            near[q] = -2
            hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
        more = 2 ** (hashes - 1)
        base, asked = (polytope.usable(t, "vec_id", "embedding") for t in (table, queries))
        a, b = polytope.hashed(asked, 12 * more, 8 * more, 7, hashes), polytope.hashed(base, 12 * more, 1, 7, hashes)
        met = a.select("t", "axis", F.col("id").alias("q")).join(b.select("t", "axis", "id"), ["t", "axis"]).select("q", "id").distinct().count()
        seen[hashes] = (hits / 400, met / 80 / 4000)
    assert seen[1][0] >= 0.9 and seen[2][0] >= 0.9 and seen[2][1] < 0.5 * seen[1][1], seen


def test_hashes_follow_from_the_number_of_vectors(spark, monkeypatch):
    base = polytope.usable(spark.range(300).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("v")), "k", "v")
    assert polytope.needed_hashes(base) == 1 and polytope.needed_hashes(base.limit(0)) == 1
    monkeypatch.setattr(polytope, "BUCKET", 30)
    assert polytope.needed_hashes(base) == 2


def test_probes_are_the_nearest_buckets():
    rng = np.random.default_rng(1)
    near = [np.stack([x, -x], 2).reshape(5, 16) for x in rng.normal(size=(2, 5, 8))]
    got = polytope.buckets(near, 6)
    for row in range(5):
        loss = {a + 16 * b: (near[0][row].max() - near[0][row][a]) ** 2 + (near[1][row].max() - near[1][row][b]) ** 2 for a in range(16) for b in range(16)}
        assert got[row].tolist() == sorted(loss, key=lambda c: (loss[c], c))[:6] or [loss[c] for c in got[row]] == pytest.approx(sorted(loss.values())[:6])
    assert polytope.buckets(near, 1)[:, 0].tolist() == [int(a.argmax() + 16 * b.argmax()) for a, b in zip(*near)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def brute_encode(v, table, text):
    """Viterbi over the whole text."""
    s = "▁" + text.replace("▁", "\0own").replace(" ", "▁") if text else ""
    assert "▁" not in text
    best, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for n in range(1, min(v.longest, len(s) - i) + 1):
            piece = table.get(s[i:i + n])
            if piece is not None or n == 1:
                value = best[i] + (v.score[piece] if piece is not None else v.unknown_score)
                if value > best[i + n]:
                    best[i + n], back[i + n] = value, (i, piece)
    out, at = [], len(s)
    while at:
        i, piece = back[at]
        out.append([piece] if piece is not None else list(v.byte_ids[list(s[i:at].encode())]))
        at = i
    return [x for p in out[::-1] for x in p]


@pytest.mark.parametrize("lane", [64, 3])
def test_pieces_are_the_best_segmentation(vocabulary, monkeypatch, lane):
    import sentencepiece
    monkeypatch.setattr(pieces, "LANE", lane)
    v, model = vocabulary, sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    rng = random.Random(3)
    texts = ["", "a", " ", "  a  b ", "日本語テキスト", "a" * 300, "ab" * 99, "\n\n\t x", "😀 hé\0llo", "=-" * 70 + "the" * 50] + ["".join(rng.choice("aeth =-_n\n1é日 ") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    ids, counts = pieces.encode(v, texts)
    bounds = np.append(0, np.cumsum(counts))
    for i, t in enumerate(texts):
        mine = ids[bounds[i]:bounds[i + 1]].tolist()
        assert mine == brute_encode(v, table, t) and pieces.decode(v, mine) == t


def test_exact_round_trip(spark, vocabulary):
    rows = [(r["text"],) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()] + [(None,), ("",), ("▁own ▁marks▁",), ("\U0010ffff",), ("word " * 60_000,)] * 2
    coded = pieces.add_ids(spark.createDataFrame([(t, 0) for (t,) in rows], "text string, ids int"), vocabulary)
    out = pieces.add_text(coded.withColumnRenamed("text", "was"), vocabulary).collect()
    assert all(r["text"] == r["was"] and (r["round_trip"] is None) == (r["was"] is None) and r["round_trip"] is not False for r in out)
    assert len(out) == len(rows) and pieces.add_ids(spark.createDataFrame([], "text string"), vocabulary).collect() == []


@pytest.mark.parametrize("block, lane", [(64, 8), (17, 64), (200, 16), (1, 4)])
def test_long_texts_are_cut_into_blocks(vocabulary, monkeypatch, block, lane):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab =-é▁\n x中") for _ in range(rng.randrange(900))) for _ in range(25)] + ["=" * 700 + "a b" * 200, "", None, "-" * 1000, "e" * 64, "▁" * 70]
    want = pieces.encode(vocabulary, texts)
    monkeypatch.setattr(pieces, "BLOCK", block)
    monkeypatch.setattr(pieces, "LANE", lane)
    got = pieces.encode(vocabulary, texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


@pytest.mark.parametrize("char", ["-", "=", "a", " ", "é"])
def test_a_run_of_one_character_takes_time_in_proportion(vocabulary, char):
    took = {}
    for n in (20_000, 200_000):
        begin = time.process_time()
        ids, _ = pieces.encode(vocabulary, ["x" + char * n + "x"])
        took[n] = time.process_time() - begin
        assert pieces.decode(vocabulary, ids.tolist()).count(char) == n or char == " "
    assert took[200_000] < 30 * took[20_000] + 1 and took[200_000] < 10


def test_a_stream_keeps_a_window_and_what_is_open(vocabulary):
    stream = pieces.Stream(vocabulary)
    rng = random.Random(2)
    for k in range(20_000):
        stream.push(ord(rng.choice("thean")))
        assert len(stream.window) <= vocabulary.longest + 1 and len(stream.back) <= 4 * pieces.LANE
