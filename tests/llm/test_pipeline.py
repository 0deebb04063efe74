"""The pipeline's stages against what their operators say, and brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from noctule.llm import langid, quality
from noctule.session import stored

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, ROOT))
        assert number == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        kept.append((docs, out))
        docs = out
    language, rules, near, mixture, encoded = kept
    found = {r["doc_id"]: r for r in langid.predict(language[0], langid.learn(language[0], "text", "lang")).collect()}
    assert {r["doc_id"] for r in language[1].collect()} == {i for i, r in found.items() if r["lang_pred"] != "und" and r["lang_shares"][r["lang_pred"]] >= 0.4}
    assert {r["doc_id"] for r in rules[1].collect()} == {r["doc_id"] for r in quality.judge(rules[0]).collect() if r["kept"]}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    rows = sorted((r["doc_id"], shingles(r["text"])) for r in near[0].collect())
    root = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    assert sorted(r["doc_id"] for r in near[1].collect()) == sorted(set(root.values()))
    sizes = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mixture[0].collect()}
    taken, total = {}, {}
    for s, n in sizes.values():
        total[s] = total.get(s, 0) + n
    for r in mixture[1].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + sizes[r["doc_id"]][1]
    assert all(taken.get(s, 0) <= 3 * n for s, n in total.items())
    most = max(n for _, n in sizes.values())
    assert abs(sum(taken.values()) - sum(total.values())) <= most * len(total)
    assert encoded[1].count() == encoded[0].count() and encoded[1].where("round_trip IS NOT TRUE").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{ROOT}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_take_what_comes(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that stages add."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(120)
    schema = docs.schema
    text = docs.where("lang = 'en'").first()["text"]
    odd = [(None, text, None, None, None), (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, " \n ", None, "s", 3), (9004, "123 456 " * 20, "en", None, 1),
           (9005, text, "en", "s", 1), (9005, text, "en", "s", 1), (9006, (text + " ") * 400, "en", "s", 1)]
    names = ["score", "lang_pred", "kept", "n_words", "size", "target", "taken", "_key", "_source", "_of", "fp", "id", "ids", "a.b", "row"]
    mixed = docs.unionByName(spark.createDataFrame(odd, schema))
    for i, name in enumerate(names):
        mixed = mixed.withColumn(name, F.concat(F.lit(f"{i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, mixed, ROOT))
        rows = out.collect()
        assert rows
        if number == len(corpus_pipeline.STAGES) - 1:
            assert len(rows) == mixed.count()
            break
        assert out.columns == mixed.columns and out.schema.fieldNames() == mixed.schema.fieldNames()
        assert all(r[name] == f"{i} {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for i, name in enumerate(names))
        if number == 0:
            assert not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in rows} and {9005, 9006} <= {r["doc_id"] for r in rows}
        if number == 2:
            assert sum(r["doc_id"] == 9005 for r in rows) <= 1
        mixed = out
