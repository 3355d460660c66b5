"""Registered queries of the training-data operators, with their SQL checks where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import decode_documents, encode_documents
from .common import shared_folder, store, table
from .html_extract import extract_pages
from .jaccard_join import jaccard_components
from . import language_id
from .line_dedup import remove_repeats
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .pivot_topk import exact_topk
from .source_divergence import source_divergence
from .token_rollup import TokenRollup, counted
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .vector_dedup import vector_duplicates

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function
    return register


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

URL_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""


@query("op7_url_filter", URL_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL under the fixed rule list."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


VECTOR_DEDUP_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0 AND NOT isnan(list_dot_product(e, e)) AND NOT isinf(list_dot_product(e, e))),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98),
reach(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT node, b FROM reach JOIN links ON other = a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON vec_id = node LEFT JOIN deg ON vec_id = a
"""


@query("op1_vector_duplicates", VECTOR_DEDUP_SQL)
def op1_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors among all embeddings."""
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_exact_topk", TOPK_SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector against all others."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


JACCARD_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM t, range(1, greatest(len(w) - 4, 1) + 1) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach(node, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT node, b FROM reach JOIN links ON other = a)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n ON doc_id = node GROUP BY node
"""


@query("op8_jaccard_components", JACCARD_SQL)
def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a similarity of their five-word shingles of 0.75 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the public byte-level vocabulary, and the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op3_nnls_packing")
def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_crf_toxicity")
def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(documents, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


@query("op10_html_main_text")
def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")


ROLLUP_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) = 1 AS gone, min(quality) = 0 AS redo FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, coalesce(redo, false) AS redo, coalesce(text, '') AS t FROM documents LEFT JOIN l USING (doc_id) WHERE NOT coalesce(gone, false)),
c AS (SELECT source, lang, CASE WHEN redo THEN 'pieces@2' ELSE 'words@1' END AS tokenizer,
  CASE WHEN redo THEN len(regexp_extract_all(t, '[0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[^\x20\x09-\x0D0-9A-Za-zÀ-ÖØ-öø-ÿ]')) ELSE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) END AS n FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY source, lang, tokenizer
"""


@query("op5_token_rollup", ROLLUP_SQL)
def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserting all documents, deleting those labelled toxic and recounting those of low quality.

    The second batch is committed twice and the first one again after compaction; neither replay changes the totals.
    """
    counts = store(counted(table(spark, sf_dir, "documents"), "words@1", "pieces@2"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("gone"), (F.min("quality") == 0).alias("redo"))

    def image(version: str):
        return F.struct("source", "lang", F.lit(version).alias("tokenizer"), F.col("tokens")[version].alias("n_tokens"))

    inserts = counts.select(F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>").alias("before"), image("words@1").alias("after"))
    labelled = counts.join(labels, "doc_id")
    gone = F.coalesce("gone", F.lit(False))
    changed = labelled.where(gone | F.col("redo")).select(image("words@1").alias("before"), F.when(~gone, image("pieces@2")).alias("after"))
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit(0, inserts)
    rollup.commit(1, changed)
    rollup.commit(1, changed)
    rollup.compact()
    rollup.commit(0, inserts)
    return rollup.totals()


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n_row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT n_row, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT n_row) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0) + v.v) AS p,
  1 + (1000000000 * (kept.n + 1)) // (v.total + v.v) AS all_p
  FROM g JOIN kept ON g.lang = kept.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - all_p) * (p - all_p)) // all_p)::BIGINT AS value FROM p WHERE n > 0 AND p > all_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source of a language differs from the others, and the terms it has more often than its language."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(documents.select("doc_id", "text"), language_id.train(documents))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def _with_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text, every tenth text (by the CRC of its id) made periodic from some word on."""
    crc = "crc32(cast(cast(doc_id as string) as binary))"
    a, p = "(_g % size(ws))", "(1 + (size(ws) - _g % size(ws)) div (3 + _g % 8))"
    # the array is bound to a lambda's variable, so that the words are found once
    moved = F.expr(rf"""transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), ws ->
      array_join(transform(ws, (w, i) -> if(i < {a}, w, ws[cast({a} + (i - {a}) % {p} as int)])), ' '))[0]""")
    placed = documents.select("doc_id", "text", F.expr(f"{crc} % 10").alias("_h"), F.expr(f"{crc} div 10").alias("_g"))
    return placed.select("doc_id", F.when(F.col("_h") == 0, moved).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after every tenth was made periodic."""
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents")))
    strongest = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
      (best, r) -> case when best is null or r.length * best.period > best.length * r.period then r else best end)""")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    out = found.withColumn("_best", strongest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
