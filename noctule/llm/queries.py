"""Registered queries of the package and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctule.llm import backoff, extract, importance, jaccard, langid, licenses, lines, mixing, pieces, polytope, quality, quotes, variants
from noctule.llm import text as T
from noctule.llm.tables import bounded_batches
from noctule.session import stored

#: A public SentencePiece model; the path is a parameter of every use.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, root: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
SYMBOLS_SQL = "len(regexp_extract_all(text, '[#*$%&|<>]'))"

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS_SQL}), 0)::BIGINT AS size, coalesce({SYMBOLS_SQL}, 0) AS marks,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (SELECT *, CASE WHEN size > 0 THEN exp(ln(u) / (size / (size + marks)::DOUBLE)) ELSE u END AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3e0 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, bool_and(cap <= level * weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_ FROM l),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM f WHERE NOT full_) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT source, k, sum(size) AS same, sum(sum(size)) OVER (PARTITION BY source ORDER BY k DESC) AS upto FROM keyed GROUP BY source, k)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * upto - same < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed JOIN g ON keyed.source IS NOT DISTINCT FROM g.source
JOIN p ON keyed.source IS NOT DISTINCT FROM p.source AND keyed.k = p.k
"""


@query("op1_language_id")
def op1(spark: SparkSession, root: str) -> DataFrame:
    docs = T.only(table(spark, root, "documents"), "doc_id", "text", "lang").withColumn("held_out", T.in_fold(F.col("doc_id"), 5, 0))
    trained = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    return langid.predict(T.only(docs, "doc_id", "held_out", "text"), langid.learn(trained, "text", "lang")).drop("text")


@query("op2_mix_sources", MIX_SQL)
def op2(spark: SparkSession, root: str) -> DataFrame:
    docs = T.only(table(spark, root, "documents"), "doc_id", "text", "source")
    slim = stored(docs.select("doc_id", "source", T.n_words(F.col("text")).alias("n"), mixing.identity(F.col("doc_id"), F.col("text")).alias("digest"),
                              mixing.word_share(F.col("text")).alias("quality")), "mix-rows")
    mixed = mixing.mix(slim, "source", F.col("n"), F.col("digest"), F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, text, coalesce({WORDS_SQL}, []) AS w,
                  list_filter(coalesce(string_split(text, chr(10)), []), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
                  coalesce({SYMBOLS_SQL}, 0)::BIGINT AS n_symbols FROM documents),
n AS (SELECT *, row_number() OVER () AS id FROM d),
e AS (SELECT id, unnest(range(1, len(w) - 3)) AS i, w FROM n WHERE len(w) > 4),
x AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM e),
c AS (SELECT id, least(5, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 5)) AS own FROM x WHERE c > 1),
r AS (SELECT id, sum(own)::BIGINT AS n_repeat_words FROM c GROUP BY id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in quality.STOP_WORDS)}], x))) AS n_stop
      FROM n LEFT JOIN r USING (id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2 AND 15 AND n_symbols / n_words::DOUBLE <= 0.3
       AND n_dup_lines / n_lines::DOUBLE <= 0.5 AND (n_words < 100 OR n_stop / n_words::DOUBLE >= 0.02) AS kept
FROM b
"""


@query("op3_quality_rules", QUALITY_SQL)
def op3(spark: SparkSession, root: str) -> DataFrame:
    docs = T.only(table(spark, root, "documents"), "doc_id", "text")
    return T.only(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_extract_article")
def op4(spark: SparkSession, root: str) -> DataFrame:
    pages = T.only(table(spark, root, "pages"), "page_id", "url", "html")
    return T.only(extract.extract(pages), "page_id", "url", "text", "n_chars")


def license_sql() -> str:
    """The scan in SQL: sentences by a map, rules by replacing what they consume."""
    known = ", ".join(f"'{s}': '{name}'" for name, s in licenses.SENTENCES.items())
    plain = r"trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g'))"
    for pattern, put in (licenses.GRANT, licenses.WAIVER):
        plain = f"regexp_replace({plain}, '{pattern}', '{put}')"
    # copyright lines, of which those with all rights reserved are not reduced further
    plain = f"regexp_replace(regexp_replace({plain}, '^copyright .*all rights reserved$', 'COPYRIGHT'), '^copyright .*$', 'copyright')"
    plain = f"replace({plain}, 'COPYRIGHT', 'copyright all rights reserved')"
    cut = rf"list_filter(string_split(regexp_replace(regexp_replace({{}}, '{licenses.TAG}', '\1', 'g'), '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(lower(s), '{{}}'))"
    joined = r"replace(replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(10), ' '), chr(1), chr(10))"
    ids = lambda text: f"list_filter(list_transform({cut.format(text, licenses.ANCHOR)}, lambda s: known[{plain}]), lambda x: x IS NOT NULL)"
    claims = lambda c: f"(len(list_filter({c}, lambda x: x NOT IN ('Notice', 'Reserved', 'AllRights'))), len({c}))"
    left = "'|' || array_to_string(ids, '||') || '|'"
    rules = "[" + ", ".join(f"{{'own': '|{'||'.join(rule)}|', 'name': '{name}'}}" for name, rule in licenses.RULES) + "]"
    return f"""
WITH RECURSIVE k AS (SELECT MAP {{{known}}} AS known, {rules} AS rules),
p AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{licenses.ANCHOR}') THEN {ids('text')} END AS a,
             CASE WHEN regexp_matches(lower(text), '{licenses.ANCHOR}') THEN {ids(joined)} END AS b FROM documents, k),
i AS (SELECT row_number() OVER () AS row, doc_id, coalesce(CASE WHEN {claims('b')} > {claims('a')} THEN b ELSE a END, []) AS ids FROM p),
e AS (SELECT row, doc_id, ids, 0 AS step, {left} AS rest, CAST([] AS VARCHAR[]) AS names FROM i WHERE len(ids) > 0
      UNION ALL
      SELECT row, doc_id, ids, step + 1, replace(rest, rules[step + 1].own, '|.|'), CASE WHEN contains(rest, rules[step + 1].own) THEN list_append(names, rules[step + 1].name) ELSE names END
      FROM e, k WHERE step < len(rules)),
d AS (SELECT row, names, len(list_filter(string_split(rest, '|'), lambda x: x NOT IN ('', '.', 'Notice'))) AS n_unmatched FROM e WHERE step = {len(licenses.RULES)})
SELECT doc_id, coalesce(array_to_string(list_filter(names, lambda x, n: n = 1 OR NOT list_contains(names[:n - 1], x)), '|'), '') AS licenses, len(ids) AS n_known, coalesce(n_unmatched, 0) AS n_unmatched
FROM i LEFT JOIN d USING (row)
"""


@query("op5_license_scan", license_sql())
def op5(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(T.only(table(spark, root, "documents"), "doc_id", "text")).drop("text")


@query("op6_chosen_path_join")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return T.only(jaccard.join(T.only(table(spark, root, "documents"), "doc_id", "text")), "doc_id", "class_id", "n_links")


@query("op8_link_quotations")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return quotes.link(T.only(table(spark, root, "conversations"), "conv_id", "turn", "role", "text"))


@query("op9_cross_polytope")
def op9(spark: SparkSession, root: str) -> DataFrame:
    vectors = T.only(table(spark, root, "embeddings"), "vec_id", "embedding")
    return polytope.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op10_sentencepiece")
def op10(spark: SparkSession, root: str, model: str = PIECES) -> DataFrame:
    docs = T.only(table(spark, root, "documents"), "doc_id", "text")
    vocabulary = pieces.load(model)
    low, high = (int(f(vocabulary.byte_ids)) for f in (min, max))
    coded = pieces.add_ids(docs, vocabulary)
    return coded.select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_ids"),
                        F.coalesce(F.size(F.filter("ids", lambda i: (i >= low) & (i <= high))), F.lit(0)).cast("long").alias("n_byte_ids"),
                        F.when(F.col("ids").isNotNull(), F.xxhash64("ids")).alias("ids_hash"), "round_trip")


@query("op7_katz_backoff")
def op7(spark: SparkSession, root: str) -> DataFrame:
    docs = T.only(table(spark, root, "documents"), "doc_id", "text").withColumn("held_out", T.in_fold(F.col("doc_id"), 7, 2))
    model = backoff.train(docs, order=3, least=(1, 1, 1), where=~F.col("held_out"), key=F.col("doc_id"))
    scored = backoff.score(docs, model, F.col("doc_id")).withColumn("train_tokens", F.lit(model.total).cast("long"))
    return T.only(scored, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: CRC-32 of the bytes of x in SQL; ``crc.tab`` is the table of its 256 remainders.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab)"""


def crc_sql(x: str) -> str:
    byte = f"list_transform(range(octet_length(encode({x}))::BIGINT), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VARIANTS_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWER_SQL.format('text')}, '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc_sql("id || ':' || run")} AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM x),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word
      UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n,
             CASE WHEN top >= 10 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND p.near_n = b.top) END AS form
      FROM v LEFT JOIN b ON b.word = v.word),
c AS (SELECT word, word AS last, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(last, k) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)
"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return variants.group(T.only(table(spark, root, "documents"), "doc_id", "text"))


LINES_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT *, {LOWER_SQL.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM t),
d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN d USING (key) GROUP BY r, doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def op12(spark: SparkSession, root: str) -> DataFrame:
    kept = lines.dedup(T.only(table(spark, root, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


IMPORTANCE_SQL = rf"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT r, unnest(w) AS w FROM d),
e AS (SELECT unnest(regexp_extract_all({LOWER_SQL.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
k AS (SELECT w, {crc_sql('w')} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM e), crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM e JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM e) AS t_all),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER () // 100 AS draw FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= draw THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""


@query("op13_importance_resampling", IMPORTANCE_SQL)
def op13(spark: SparkSession, root: str) -> DataFrame:
    docs = T.only(table(spark, root, "documents"), "doc_id", "text")
    drawn = importance.resample(docs, T.only(table(spark, root, "benchmark"), "item_id", "text"))
    return T.only(drawn, "doc_id", "n_features", "weight", "score", "rank")
