"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.adaptive_rules import quality_rules
from skyloom.llm import chunk_dedup, collocations, decontaminate, fill_middle, language_id, onebin_minhash, packing, quality, secret_scan, toxicity
from skyloom.llm.ngram_join import jaccard_components
from skyloom.llm.scratch import Scratch
from skyloom.llm.url_filter import filter_urls, with_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH cut AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, url, regexp_extract(rest, '^[^/?#]*', 0) AS h0, substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1) AS tail FROM cut),
named AS (
    SELECT page_id, url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*', 0) AS path,
        list_sort(list_filter(string_split(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS q
    FROM parts),
canon AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
        || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS c FROM named),
listed AS (SELECT c FROM canon WHERE c IS NOT NULL GROUP BY c HAVING count(*) > 1),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
    (SELECT rh || rp FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
    coalesce((SELECT verdict FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1),
        CASE WHEN c IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon
"""
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op8_url_filter", OP8_SQL)
def op8(spark, sf_dir):
    """Listed here: pages that the crawl holds more than once under one canonical URL."""
    pages = table(spark, sf_dir, "pages")
    listed = with_parts(pages.select("url")).filter("canonical IS NOT NULL").groupBy("canonical").agg(
        F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).filter("n > 1").select("url")
    return filter_urls(pages, listed, URL_RULES)


def _op10_sql() -> str:
    value = "CASE {m} WHEN 'word_length' THEN CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END WHEN 'symbols' THEN CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END WHEN 'lines' THEN CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END ELSE CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END END"
    return r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
win AS (SELECT r, i, hash(ws[i:i + 7]) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) AS s(k) GROUP BY r),
counts AS (
    SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
measures(m, least, has_low) AS (VALUES ('word_length', 40, true), ('symbols', 25, false), ('lines', 150, false), ('repeats', 150, false)),
vals AS (SELECT r, lang, source, base_failed, m, least, has_low, """ + value.format(m="m") + r""" AS x FROM judged, measures),
cells AS (SELECT lang, source, m, least, has_low, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS b, count(*) AS n
    FROM vals WHERE NOT base_failed GROUP BY ALL),
levels AS (
    SELECT 0 AS lv, lang, source, m, least, has_low, b, n FROM cells
    UNION ALL SELECT 1, lang, NULL, m, least, has_low, b, sum(n) FROM cells GROUP BY ALL
    UNION ALL SELECT 2, NULL, NULL, m, least, has_low, b, sum(n) FROM cells GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, m ORDER BY b) AS s, sum(n) OVER (PARTITION BY lv, lang, source, m) AS a FROM levels),
quart AS (SELECT lv, lang, source, m, least, has_low, max(a) AS a, min(CASE WHEN 4 * s >= a THEN b END) AS q1, min(CASE WHEN 4 * s >= 3 * a THEN b END) AS q3
    FROM ranked GROUP BY ALL),
lim AS (SELECT lv, lang, source, m, a, CASE WHEN has_low THEN q1 - greatest(6 * (q3 - q1), least) END AS low, q3 + greatest(6 * (q3 - q1), least) AS high FROM quart),
picked AS (
    SELECT v.r, v.x, CASE WHEN s.a >= 100 THEN s.low WHEN l.a >= 100 THEN l.low ELSE c.low END AS low, CASE WHEN s.a >= 100 THEN s.high WHEN l.a >= 100 THEN l.high ELSE c.high END AS high
    FROM vals v LEFT JOIN lim s ON s.lv = 0 AND s.m = v.m AND s.lang IS NOT DISTINCT FROM v.lang AND s.source IS NOT DISTINCT FROM v.source
    LEFT JOIN lim l ON l.lv = 1 AND l.m = v.m AND l.lang IS NOT DISTINCT FROM v.lang LEFT JOIN lim c ON c.lv = 2 AND c.m = v.m),
verdicts AS (SELECT r, bool_and(coalesce(x <= high AND (low IS NULL OR x >= low), false)) AS ok FROM picked GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM judged JOIN verdicts USING (r)
"""


@query("op10_adaptive_rules", _op10_sql())
def op10(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def fold(divisor: int, rest: int):
    """True for rows whose crc32(doc_id as text) leaves ``rest``; a NULL id belongs to no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest, F.lit(False))


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(3, 1))
    model = language_id.train(docs.filter("NOT held_out AND doc_id IS NOT NULL").select("text", "lang"))
    found = language_id.identify(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def _joined(spans):
    """``kind:start:end`` of spans, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


@query("op4_secret_scan")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs), ["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query("op7_packing")
def op7(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(5, 0))
    learn = table(spark, sf_dir, "labels").filter(~fold(5, 0) & F.col("doc_id").isNotNull())
    found = toxicity.score(docs, toxicity.train(docs, learn), ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op2_quality")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(4, 2))
    stats = Scratch(spark).put(quality.statistics(docs, ["doc_id", "held_out"]))  # the texts are read once
    learn = table(spark, sf_dir, "labels").filter(~fold(4, 2) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = quality.train(stats.join(learn, "doc_id", "left"))
    return quality.score(stats, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op6_chunk_dedup")
def op6(spark, sf_dir):
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


@query("op5_decontaminate")
def op5(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_onebin_minhash")
def op11(spark, sf_dir):
    found = onebin_minhash.compare_with_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP12_SQL = r"""
WITH base AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM base),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM worded
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 10),
parts AS (
    SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS p, array_to_string(w[cut + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (c.a::HUGEINT * c.a * 1000000) // (x.f::HUGEINT * y.f) AS score
    FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, phrase, max(a) AS m FROM (
        SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3)
    GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.m IS NULL OR 100 * g.m < 50 * b.a)
SELECT * FROM (
    SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score::BIGINT AS score
    FROM kept k JOIN total t ON t.lang = k.lang)
WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
tokens AS (
    SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM base),
cut AS (
    SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS x, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS y,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM tokens),
parts AS (
    SELECT *, coalesce(array_to_string(u[1:x], ''), '') AS p, coalesce(array_to_string(u[x + 1:y], ''), '') AS m, coalesce(array_to_string(u[y + 1:], ''), '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(p || m || s) AS restored_sha256
FROM parts
"""


@query("op13_fill_middle", OP13_SQL)
def op13(spark, sf_dir):
    return fill_middle.transform(table(spark, sf_dir, "documents"))
