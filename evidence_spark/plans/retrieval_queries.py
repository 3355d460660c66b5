"""Queries over questions, retrieval, re-ranking and the graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import entity_ids, str_array, tokens
from ..operators import graph as G, questions as QN, rerank as RR, search as SE
from .asking import sparse_hits
from .registry import SHARED, in_list, ln, query, sql_list

joined = lambda c: F.array_join(c, "|")
sorted_join = lambda c: F.array_join(F.array_sort(c), "|")

TOK = "regexp_extract_all(lower({e}), '[a-z0-9_]+')"
RET = "list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z0-9_]+'), lambda t: length(t) > 2 AND NOT list_contains(" + sql_list(K.STOPWORDS) + ", t)))"
IDS = "list_distinct(list_transform(regexp_extract_all({e}, '(?i)\\b(?:acct|cust|gh|msg|pol|prod|res|risk|svc|tkt)_[a-z0-9_]+\\b'), lambda x: lower(x)))"


def ret(e):
    return RET.format(e=e)


def ids(e):
    return IDS.format(e=e)


# -- tokens, ids, intents ---------------------------------------------------------------

@query("token_counts", f"""
SELECT item_id, len({ret('text')}) AS retrieval, len(list_filter({TOK.format(e='text')}, lambda t: length(t) > 1)) AS graph,
  len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'))) AS eval,
  len(list_distinct(list_filter({TOK.format(e='text')}, lambda t: length(t) > 2))) AS sufficiency,
  len(list_distinct({TOK.format(e='text')})) AS intent,
  len(regexp_extract_all(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), '[A-Za-zÀ-ỹ0-9_+-]+')) AS analyser
FROM (SELECT doc_id AS item_id, text FROM documents)""")
def _(r):
    profiles = ["retrieval", "graph", "eval", "sufficiency", "intent", "analyser"]
    return r["documents"].select(F.col("doc_id").alias("item_id"), *[
        F.size(tokens("text", p)).cast("long").alias(p) for p in profiles])


@query("entity_ids", f"SELECT query_id, array_to_string(list_sort({ids('query')}), '|') AS ids FROM questions")
def _(r):
    return r["questions"].select("query_id", sorted_join(entity_ids("query")).alias("ids"))


_IT = f"list_distinct({TOK.format(e='query')})"
INTENT_SQL = "CASE " + " ".join(
    f"WHEN list_has_any({_IT}, {sql_list(ws)})" + (" OR contains(lower(query), 'service owner')" if n == "service_owner" else "") + f" THEN '{n}'"
    for n, ws in K.INTENT_RULES) + " ELSE 'general' END"


@query("query_intent", f"SELECT query_id, {INTENT_SQL} AS intent FROM questions")
def _(r):
    return r["questions"].select("query_id", QN.query_intent("query").alias("intent"))


_SRC = "CASE intent " + " ".join(f"WHEN '{n}' THEN '{'|'.join(v)}'" for n, v in K.INTENT_SOURCES.items()) + " END"


@query("plan_retrieval", f"""
SELECT query_id, intent, {_SRC} AS source_types, coalesce(list_filter(i, lambda x: starts_with(x, 'cust_'))[1], '') AS customer_id,
  coalesce(list_filter(i, lambda x: starts_with(x, 'tkt_'))[1], '') AS ticket_id, coalesce(list_filter(i, lambda x: starts_with(x, 'svc_'))[1], '') AS service_id
FROM (SELECT query_id, {INTENT_SQL} AS intent, list_transform(regexp_extract_all(query, '(?i)\\b(?:acct|cust|gh|msg|pol|prod|res|risk|svc|tkt)_[a-z0-9_]+\\b'), lambda x: lower(x)) AS i FROM questions)""")
def _(r):
    p = QN.plan_retrieval(r["questions"])
    return p.select("query_id", "intent", joined("source_types").alias("source_types"), *[
        F.coalesce(c, F.lit("")).alias(c) for c in ["customer_id", "ticket_id", "service_id"]])


def var(t):
    """SQL list of the variants of a term."""
    n = f"length({t})"
    return (f"list_distinct(list_filter([{t}, CASE WHEN suffix({t}, 'e') AND {n} > 3 THEN left({t}, {n} - 1) || 'ing' END, "
            f"CASE WHEN suffix({t}, 'ing') AND {n} > 5 THEN left({t}, {n} - 3) END, "
            f"CASE WHEN suffix({t}, 'ing') AND {n} > 5 AND NOT suffix(left({t}, {n} - 3), 'e') THEN left({t}, {n} - 3) || 'e' END, "
            f"CASE WHEN NOT suffix({t}, 's') AND {n} > 3 THEN {t} || 's' END, "
            f"CASE WHEN suffix({t}, 's') AND {n} > 4 THEN left({t}, {n} - 1) END], lambda z: z IS NOT NULL))")


def _phr(q, phrases):
    return "(" + " OR ".join(f"contains({q}, '{p}')" for p in phrases) + ")"


_ADDED = " || ".join(
    [f"CASE WHEN contains(q, '{k}') OR contains(replace(q, ' ', ''), '{k}') THEN {sql_list(ws)} ELSE []::VARCHAR[] END" for k, ws in K.KEYWORD_EXPANSIONS]
    + [f"CASE WHEN {_phr('q', rule[1])} THEN {sql_list(rule[3])} ELSE []::VARCHAR[] END" for rule in K.ANALYSER_INTENTS])
SHARED["an0"] = "SELECT query_id, query, regexp_replace(trim(lower(query), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g') AS q FROM questions"
SHARED["an1"] = f"""
SELECT *, list_distinct(flatten(list_transform(list_filter(regexp_extract_all(q, '[A-Za-zÀ-ỹ0-9_+-]+'), lambda t: NOT list_contains({sql_list(K.ANALYSER_STOPWORDS)}, t)
  AND (length(t) >= 4 OR list_contains({sql_list(K.SHORT_KEYWORDS)}, t))) || {_ADDED}, lambda w: {var('w')}))) AS kws FROM an0"""
SHARED["an2"] = f"""
SELECT *, list_filter(kws, lambda k: list_contains({sql_list(K.PLATFORMS)}, k)) AS platform,
  list_filter(kws, lambda k: NOT list_contains({sql_list(K.PLATFORMS)}, k)) AS plain FROM an1"""


def _gather(ix):
    return "list_distinct(" + " || ".join(
        f"CASE WHEN {_phr('q', rule[1])}" + (f" OR list_has_any(kws, {sql_list(rule[2])})" if rule[2] else "")
        + f" THEN {sql_list([rule[0]] if ix == 0 else rule[ix])}::VARCHAR[] ELSE []::VARCHAR[] END" for rule in K.ANALYSER_INTENTS) + ")"


SHARED["analyzed"] = f"""
SELECT query_id, query, kws, platform, CASE WHEN len(st) > 0 THEN st ELSE plain END AS strong,
  list_filter(plain, lambda k: list_contains({sql_list(K.GENERIC_KEYWORDS)}, k)) AS weak, {_gather(0)} AS intents, {_gather(4)} AS preferred,
  {_gather(5)} AS penalized, {_gather(6)} AS phrases FROM (
  SELECT *, list_filter(plain, lambda k: NOT list_contains({sql_list(K.GENERIC_KEYWORDS)}, k)) AS st FROM an2)"""


def _sj(c):
    return f"array_to_string(list_sort({c}), '|')"


@query("analyze_queries", f"""
SELECT query_id, {_sj('kws')} AS all_keywords, {_sj('platform')} AS platform_keywords, {_sj('strong')} AS strong_keywords, {_sj('weak')} AS weak_keywords,
  {_sj('intents')} AS intent_labels, {_sj('preferred')} AS preferred_sources, {_sj('penalized')} AS penalized_sources, {_sj('phrases')} AS phrase_keywords FROM analyzed""")
def _(r):
    a = QN.analyze_queries(r["questions"])
    return a.select("query_id", *[sorted_join(c).alias(c) for c in ["all_keywords", *RR.ANALYSIS]])


_WC = "[^\\p{L}\\p{N}_]"


def _hit(text, term):
    body = "\\s+".join(term.lower().split(" "))
    return f"regexp_matches({text}, '(^|{_WC}){body}({_WC}|$)')"


_SIGNALS = "[" + ", ".join(f"CASE WHEN {_hit('lower(query)', t)} THEN '{t}' END" for t in K.SOURCE_LISTING_SIGNALS) + "]"


@query("route_questions", f"""
SELECT query_id, CASE WHEN short THEN 'clarify' WHEN len(s) > 0 THEN 'retrieve_only' ELSE 'answer_from_kb' END AS route,
  CASE WHEN short THEN 0 ELSE len(s) END AS score, CASE WHEN short THEN '' ELSE array_to_string(list_sort(s), '|') END AS matched_signals FROM (
  SELECT query_id, length(regexp_replace(query, '\\s+', '', 'g')) < 8 AS short, list_filter({_SIGNALS}, lambda x: x IS NOT NULL) AS s
  FROM (SELECT item_id AS query_id, CASE WHEN item_id % 10 = 9 THEN 'ok  ?' ELSE query END AS query FROM benchmark JOIN questions ON item_id = query_id))""")
def _(r):
    q = r["questions"].withColumn("query", F.when(F.col("query_id") % 10 == 9, "ok  ?").otherwise(F.col("query")))
    out = QN.route_questions(q)
    return out.select("query_id", "route", F.col("score").cast("long").alias("score"), sorted_join("matched_signals").alias("matched_signals"))


_DOM = " UNION ALL ".join(
    f"SELECT query_id, '{n}' AS name, {p} AS prio, " + " + ".join(f"CASE WHEN {_hit('lower(query)', t)} THEN 1 ELSE 0 END" for t in ws) + " AS score FROM questions"
    for n, p, ws in K.DOMAIN_KEYWORDS)


@query("assign_domains", f"""
SELECT q.query_id, coalesce(d.domains, 'github_docs') AS domains, coalesce(d.scores, '') AS scores FROM questions q LEFT JOIN (
  SELECT query_id, string_agg(name, '|' ORDER BY score DESC, prio, name) AS domains, string_agg(CAST(score AS STRING), '|' ORDER BY score DESC, prio, name) AS scores
  FROM ({_DOM}) WHERE score > 0 GROUP BY 1) d ON q.query_id = d.query_id""")
def _(r):
    out = QN.assign_domains(r["questions"])
    return out.select("query_id", joined("domains").alias("domains"), joined(F.col("domain_scores").cast("array<string>")).alias("scores"))


# -- filters ----------------------------------------------------------------------------

@query("metadata_filter", "SELECT doc_key FROM corpus WHERE source_type IN ('ticket', 'knowledge_base') AND service_id IN ('svc_1', 'svc_2', 'svc_3')")
def _(r):
    return SE.filter_metadata(r["corpus"], {"source_type": ["ticket", "knowledge_base", " "], "service_id": ["svc_1", " svc_2", "svc_3"]}).select("doc_key")


@query("source_filter", "SELECT doc_key FROM corpus WHERE source IN ('github_issues') OR source_type IN ('ticket', 'issue', 'github_issue', 'github_issues')")
def _(r):
    return SE.filter_sources(r["corpus"], ["github_issues"], ["ticket", "issue", "github_issue", "github_issues"], fallback=True).select("doc_key")


# -- first-stage retrieval -----------------------------------------------------------------

VALS = ["entity_id", "source_type", "title", "customer_id", "account_id", "ticket_id", "product_id", "service_id", "policy_id"]
EVALS = ["entity_id", "customer_id", "account_id", "ticket_id", "product_id", "service_id", "policy_id", "title"]
SEARCHED = ["doc_id", "source", "source_type", "entity_id", "title", "customer_id", "account_id", "ticket_id", "product_id", "service_id", "policy_id", "path", "url"]


def _vals(cols):
    return f"list_filter([{', '.join(f'trim({c})' for c in cols)}], lambda v: v <> '')"


SHARED["lex_q"] = f"SELECT query_id, lower(query) AS ql, {ret('query')} AS qt, list_distinct(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+')) AS qe FROM questions"
SHARED["lex_d"] = f"SELECT doc_key, lower(title) AS tl, list_transform({_vals(VALS)}, lambda v: lower(v)) AS vs, {ret('concat_ws(chr(32), text, ' + ', '.join(VALS) + ')')} AS dt FROM corpus"
SHARED["lex_all"] = """
SELECT query_id, doc_key, len(list_intersect(qt, dt)) + CASE WHEN len(list_filter(qt, lambda t: contains(tl, t))) > 0 THEN 2.0 ELSE 0.0 END
  + 4.0 * len(list_filter(vs, lambda v: contains(ql, v))) AS score FROM lex_q JOIN lex_d ON true"""
SHARED["lex"] = """
SELECT query_id, doc_key, CAST(rank AS INT) AS rank, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key DESC) AS rank
  FROM lex_all WHERE score > 0) WHERE rank <= 18"""


def _corpus(r):
    def build():
        r.spread(documents="doc_id", orders="o_orderkey")
        return r["corpus"]
    return r.shared("corpus", build)


def _lex(r, k=18):
    return F.broadcast(r.shared(f"lex{k}", lambda: SE.lexical_search(r["questions"], _corpus(r), k)))


@query("lexical_topk", "SELECT query_id, doc_key, 'lexical' AS channel, rank, score FROM lex WHERE rank <= 5")
def _(r):
    return _lex(r, 5)


@query("lexical_eval_topk", f"""
SELECT query_id, doc_key, CAST(rank AS INT) AS rank, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_type DESC, doc_id DESC) AS rank FROM (
  SELECT query_id, doc_key, doc_id, source_type, len(list_intersect(qe, de)) + 4.0 * len(list_filter(vs, lambda v: contains(ql, v))) AS score FROM lex_q JOIN (
    SELECT doc_key, doc_id, source_type, list_transform({_vals(EVALS)}, lambda v: lower(v)) AS vs, list_distinct(regexp_extract_all(lower(concat_ws(' ', text, {', '.join(SEARCHED)})), '[a-zA-Z0-9_]+')) AS de FROM corpus) d ON true)
  WHERE score > 0) WHERE rank <= 5""")
def _(r):
    return SE.lexical_search(r["questions"], _corpus(r), 5, profile="eval").drop("channel")


SHARED["bm_d"] = "SELECT doc_key, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 2) AS ts FROM corpus"
SHARED["bm_t"] = "SELECT doc_key, len(ts) AS dl, unnest(ts) AS term FROM bm_d"
SHARED["bm_q"] = "SELECT query_id, unnest(qt) AS term FROM lex_q"
SHARED["bm_tf"] = "SELECT doc_key, dl, term, count(*) AS tf FROM bm_t WHERE term IN (SELECT term FROM bm_q) GROUP BY 1, 2, 3"
SHARED["bm_df"] = "SELECT term, count(*) AS df FROM bm_tf GROUP BY 1"
SHARED["bm_all"] = """
SELECT query_id, doc_key, sum(ln(1 + ((SELECT count(*) FROM bm_d) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(ts)) FROM bm_d)))) AS score
FROM bm_q JOIN bm_tf USING (term) JOIN bm_df USING (term) GROUP BY 1, 2"""
SHARED["bm"] = """
SELECT query_id, doc_key, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_key) AS rank FROM bm_all) WHERE rank <= 20"""


@query("bm25_topk", "SELECT query_id, doc_key, rank, round(score, 6) AS score FROM bm WHERE rank <= 10")
def _(r):
    return SE.sparse_search(r["questions"], _corpus(r), 10).select("query_id", "doc_key", "rank", F.round("score", 6).alias("score"))


SHARED["dn"] = """
SELECT query_id, doc_key, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM (
  SELECT query_id, doc_key, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM question_vectors q JOIN doc_vectors d ON true)) WHERE rank <= 20"""


@query("dense_topk", "SELECT query_id, doc_key, rank, round(score, 6) AS score FROM dn WHERE rank <= 10")
def _(r):
    return SE.dense_search(r["question_vectors"], r["doc_vectors"], 10).select("query_id", "doc_key", "rank", F.round("score", 6).alias("score"))


@query("rrf_fusion", """
SELECT query_id, doc_key, CAST(rank AS INT) AS rank, dense_rank, sparse_rank, round(f, 9) AS fused_score, channels FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 12) DESC, side, r) AS rank FROM (
    SELECT query_id, doc_key, coalesce(max(rank) FILTER (side = 0), 0) AS dense_rank, coalesce(max(rank) FILTER (side = 1), 0) AS sparse_rank,
      coalesce(sum(1.0 / (60 + rank)), 0) AS f, min(side) AS side, arg_min(rank, side) AS r, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
    FROM (SELECT query_id, doc_key, rank, 0 AS side, 'dense' AS channel FROM dn UNION ALL SELECT query_id, doc_key, rank, 1, 'sparse' FROM bm) GROUP BY 1, 2)) WHERE rank <= 10""")
def _(r):
    dense = SE.dense_search(r["question_vectors"], r["doc_vectors"], 20)
    out = SE.rrf_fuse(dense, sparse_hits(r["questions"], _corpus(r), 20), 10)
    return out.select("query_id", "doc_key", "rank", F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"),
                      F.coalesce("sparse_rank", F.lit(0)).alias("sparse_rank"), F.round("fused_score", 9).alias("fused_score"), "channels")


# -- re-ranking ---------------------------------------------------------------------------

def _cands(r, k=18):
    hits = _lex(r, k).withColumnRenamed("rank", "cand_rank").select("query_id", "doc_key", "cand_rank")
    return hits.join(_corpus(r).select("doc_key", "doc_id", "title", "source", "source_type", "path", "url", "text"), "doc_key")


def _sq(c):
    return f"regexp_replace(trim(lower({c}), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')"


def _kw(lst, a, b, c):
    v = var("k")
    return (f"list_transform({lst}, lambda k: CASE WHEN len(list_filter({v}, lambda v: contains(tb, v))) > 0 THEN {a} WHEN len(list_filter({v}, lambda v: contains(di, v))) > 0 THEN {b} "
            f"WHEN len(list_filter({v}, lambda v: contains(hd, v))) > 0 THEN {c} ELSE 0.0 END)")


SHARED["rr0"] = f"""
SELECT lex.query_id, lex.doc_key, lex.rank AS cand_rank, c.doc_id, c.title, c.source, c.source_type, c.path, c.text, a.platform, a.strong, a.weak, a.intents, a.preferred, a.penalized, a.phrases,
  {_sq('c.title')} AS tt, {_sq('c.doc_id')} AS di, {_sq('c.path')} AS pa, {_sq('substr(c.text, 1, 1800)')} AS hd,
  concat_ws(' ', {_sq('c.title')}, {_sq('c.source')}, {_sq('c.path')}, {_sq('c.url')}) AS tb,
  concat_ws(' ', {_sq('c.title')}, {_sq('c.doc_id')}, {_sq('c.source')}, {_sq('c.path')}, {_sq('c.url')}, substr({_sq('substr(c.text, 1, 1800)')}, 1, 500)) AS ob
FROM lex JOIN corpus c USING (doc_key) JOIN analyzed a ON lex.query_id = a.query_id"""
SHARED["rr1"] = f"""
SELECT *, {_kw('platform', 7.0, 5.0, 2.5)} AS pp, {_kw('strong', 8.0, 5.0, 2.5)} AS sp, {_kw('weak', 2.0, 1.5, 0.8)} AS wp,
  len(platform) > 0 AND ((NOT list_contains(platform, 'github') AND contains(ob, 'github')) OR (NOT list_contains(platform, 'gitlab') AND contains(ob, 'gitlab'))) AS opp,
  list_transform(phrases, lambda p: CASE WHEN contains(tt, p) THEN 6.0 WHEN contains(di, p) OR contains(pa, p) THEN 4.0 WHEN contains(hd, p) THEN 2.0 ELSE 0.0 END) AS fp FROM rr0"""
SHARED["rr2"] = """
SELECT *, len(list_filter(pp, lambda x: x > 0)) AS ph, len(list_filter(sp, lambda x: x > 0)) AS sh, list_contains(intents, 'github_authentication') AS auth FROM rr1"""
SHARED["rr"] = """
SELECT *, coalesce(list_sum(pp), 0) + CASE WHEN len(platform) > 0 AND ph = 0 THEN -4 ELSE 0 END + CASE WHEN opp THEN -4 ELSE 0 END + coalesce(list_sum(sp), 0) + coalesce(list_sum(wp), 0)
  + CASE WHEN list_contains(preferred, lower(source)) THEN 4 ELSE 0 END + CASE WHEN list_contains(penalized, lower(source)) THEN -4.5 ELSE 0 END + coalesce(list_sum(fp), 0)
  + CASE WHEN auth AND source = 'github_docs' THEN 3 ELSE 0 END + CASE WHEN auth AND source = 'gitlab_handbook' THEN -5 ELSE 0 END
  + CASE WHEN auth AND (contains(tt, 'passkey') OR contains(tt, 'authentication') OR contains(tt, 'sign in') OR contains(tt, 'login')) THEN 4 ELSE 0 END
  + CASE WHEN source IN ('github_docs', 'gitlab_handbook') THEN 0.5 ELSE 0 END + CASE WHEN source_type IN ('issue', 'ticket') OR source = 'github_issues' THEN -0.5 ELSE 0 END
  + CASE WHEN len(strong) > 0 AND sh = 0 THEN -3 ELSE 0 END
  + CASE WHEN sh = 0 AND (contains(tt, 'about') OR contains(tt, 'overview') OR contains(tt, 'getting started')) THEN -1 ELSE 0 END AS rs FROM rr2"""
SHARED["rrs"] = """
SELECT *, row_number() OVER w AS pos, first_value(rs) OVER w AS best, first_value(ph) OVER w AS bp, first_value(opp) OVER w AS bo FROM rr
WINDOW w AS (PARTITION BY query_id ORDER BY rs DESC, ph DESC, sh DESC, length(text) DESC, cand_rank)"""
SHARED["reranked"] = """
SELECT query_id, doc_key, doc_id, title, source, path, round(rs, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT) AS rank FROM (
  SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS anyk FROM (
    SELECT *, rs >= greatest(best * 0.45, 0.8) AND NOT (opp AND rs < 2.5) AS keep FROM rrs
    WHERE NOT ((len(platform) > 0 AND bp = 0 AND best < 1.5) OR (bo AND best < 2.0) OR best < 0.8))) WHERE keep OR NOT anyk"""


@query("heuristic_rerank", "SELECT query_id, doc_key, rank, rerank_score FROM reranked WHERE rank <= 8")
def _(r):
    out = RR.analyse_and_rerank(r["questions"], _cands(r), 8)
    return out.select("query_id", "doc_key", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("intent_prefilter", """
SELECT query_id, doc_key FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY query_id) AS n FROM (
  SELECT *, source = 'github_docs' AND (contains(lower(title), 'passkey') OR contains(lower(path), 'passkey') OR contains(lower(title), 'authentication') OR contains(lower(path), 'authentication')
    OR contains(lower(title), 'sign in') OR contains(lower(title), 'login') OR contains(lower(substr(text, 1, 1200)), 'passkey') OR contains(lower(substr(text, 1, 1200)), 'authentication')) AS hit FROM rr2))
WHERE NOT auth OR hit OR n < 4""")
def _(r):
    return RR.intent_prefilter(_cands(r), QN.analyze_queries(r["questions"]), 4).select("query_id", "doc_key")


SHARED["mp_known"] = """
SELECT h.query_id, h.rank, h.doc_id, h.text, h.node_type, p.parent_id AS pid, p.parent_index AS px, p.text AS ptext, h.origin_doc_id AS origin FROM leaf_hits h JOIN parent_nodes p ON h.parent_id = p.parent_id"""
SHARED["mp_par"] = "SELECT query_id, pid, px, ptext, origin, count(*) AS n, min(rank) AS rank FROM mp_known GROUP BY 1, 2, 3, 4, 5"
SHARED["mp_packs"] = """
SELECT query_id, origin, list(pid ORDER BY rank) AS pids, list({'px': px, 'pid': pid, 't': trim(ptext)} ORDER BY rank)[:3] AS c, min(rank) AS rank
FROM mp_par WHERE n < 2 AND origin <> '' GROUP BY 1, 2 HAVING count(*) >= 2"""
SHARED["mp_gone"] = "SELECT query_id, pid FROM mp_par WHERE n >= 2 UNION ALL SELECT query_id, unnest(pids) FROM mp_packs"


@query("merge_parents", """
SELECT query_id, rank, 'parent' AS node_type, concat('ticket::', pid) AS doc_id, ptext AS text FROM mp_par WHERE n >= 2
UNION ALL SELECT query_id, rank, 'parent_pack', concat(origin, '::pack'), array_to_string(list_transform(list_sort(c), lambda x: x.t), chr(10) || chr(10) || '---' || chr(10) || chr(10)) FROM mp_packs
UNION ALL SELECT k.query_id, k.rank, k.node_type, k.doc_id, k.text FROM mp_known k WHERE (k.query_id, k.pid) NOT IN (SELECT (query_id, pid) FROM mp_gone)""")
def _(r):
    return RR.merge_parents(r["leaf_hits"], r["parent_nodes"]).select("query_id", "rank", "node_type", "doc_id", "text")


@query("dedupe_by_origin", """
SELECT query_id, doc_id, node_type, CAST(fr AS INT) AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS fr FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY CASE node_type WHEN 'parent' THEN 2 ELSE 1 END DESC, rank) AS n FROM leaf_hits) WHERE n = 1) WHERE fr <= 4""")
def _(r):
    hits = r["leaf_hits"].withColumn("origin_doc_id", F.col("parent_id"))
    return RR.dedupe_by_origin(hits, 4).select("query_id", "doc_id", "node_type", "final_rank")


@query("merge_sources", """
SELECT query_id, doc_id, source, round(rerank_score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, src, rank) AS INT) AS index FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_key ORDER BY rerank_score DESC, src, rank) AS n FROM (
    SELECT query_id, doc_key, rank, score AS rerank_score, 0 AS src FROM lex WHERE rank <= 10 UNION ALL SELECT query_id, doc_key, rank, round(score, 9), 1 FROM bm WHERE rank <= 10)
  JOIN corpus USING (doc_key)) WHERE n = 1""")
def _(r):
    docs = _corpus(r).select("doc_key", "doc_id", "title", "source", "source_type", "path", "url", "text")
    a = _lex(r, 10).withColumnRenamed("score", "rerank_score").join(docs, "doc_key")
    b = SE.sparse_search(r["questions"], _corpus(r), 10).withColumn("rerank_score", F.round("score", 9)).join(docs, "doc_key")
    return RR.merge_sources([a, b]).select("query_id", "doc_id", "source", F.round("rerank_score", 6).alias("rerank_score"), "index")


@query("guardrails", """
SELECT query_id, n AS retrieved_docs, coalesce(t1, -1) AS top1_score, coalesce(t2, -1) AS top2_score,
  CASE WHEN n = 0 THEN 'fallback_to_clarify' WHEN n = 1 AND t1 < 4 THEN 'fallback_to_clarify' WHEN n = 1 AND t1 < 7 THEN 'fallback_to_search' WHEN t1 < 2.5 THEN 'fallback_to_clarify'
    WHEN n < 2 THEN 'fallback_to_search' WHEN t1 < 5 AND t2 < 4 THEN 'fallback_to_search' WHEN t1 - t2 < 0.35 AND t1 < 6 THEN 'fallback_to_search' ELSE 'allow_answer' END AS action
FROM (SELECT q.query_id, count(r.rank) AS n, max(rerank_score) FILTER (rank = 1) AS t1, max(rerank_score) FILTER (rank = 2) AS t2
  FROM questions q LEFT JOIN (SELECT query_id, rank, rerank_score FROM reranked WHERE rank <= 5) r ON q.query_id = r.query_id GROUP BY 1)""")
def _(r):
    hits = RR.analyse_and_rerank(r["questions"], _cands(r), 5).withColumn("rerank_score", F.round("rerank_score", 6))
    g = RR.guardrail_decisions(r["questions"], hits, 5)
    return g.select("query_id", "retrieved_docs", F.coalesce("top1_score", F.lit(-1.0)).alias("top1_score"),
                    F.coalesce("top2_score", F.lit(-1.0)).alias("top2_score"), "action")


def overlap_score(question: pd.Series, text: pd.Series) -> pd.Series:
    """Stand-in for an external relevance model: share of question words in the text."""
    return pd.Series([len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split())))
                      for q, t in zip(question, text)])


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


@query("model_rerank", f"""
SELECT query_id, doc_key, CAST(rank AS INT) AS rank, round(share, 6) AS ce_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, pos) AS rank FROM (
    SELECT lex.query_id, lex.doc_key, lex.rank AS pos, len(list_intersect({_WORDS.format('q.query')}, {_WORDS.format('c.text')})) / greatest(1, len({_WORDS.format('q.query')})) AS share
    FROM lex JOIN corpus c USING (doc_key) JOIN questions q ON q.query_id = lex.query_id WHERE lex.rank <= 10)) WHERE rank <= 5""")
def _(r):
    hits = _cands(r, 10).withColumnRenamed("cand_rank", "rank")
    return RR.model_rerank(hits, r["questions"], 5, overlap_score).select("query_id", "doc_key", "rank", F.round("ce_score", 6).alias("ce_score"))


# -- graph ------------------------------------------------------------------------------

_GT = ["accounts", "customers", "products", "service_catalog", "knowledge_base_docs", "tickets", "ticket_messages", "github_issues", "risk_events"]


def _node_sql(table, kind, key, label, pairs):
    cols = []
    for lab, c in pairs:
        e = f"substr(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), 1, 1000)" if (lab, c) == ("Content", "content") else f"replace({c}, '|', ', ')" if c == "labels" else f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
        cols.append(ln(lab, e))
    lab_e = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in label) + ")"
    return f"""SELECT concat('{kind}:', {key}) AS node_id, '{kind}' AS node_type, {lab_e} AS label, trim(concat_ws(chr(10), {', '.join(cols)}), ' ' || chr(9) || chr(10) || chr(13)) AS text,
  concat_ws(' ', *COLUMNS(* EXCLUDE (_ord, rn_))) AS props FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY _ord DESC, {pairs[0][1]} DESC, {pairs[1][1]} DESC, {pairs[2][1]} DESC) AS rn_ FROM {table}) WHERE rn_ = 1"""


SHARED["team_rows"] = " UNION ALL ".join(
    f"SELECT {i} AS step, _ord, trim({o}) AS team FROM {t} WHERE trim({o}) <> ''" for i, (t, _, o, _, _) in enumerate(G.TEAM_COLUMNS))
SHARED["g_nodes"] = " UNION ALL ".join(_node_sql(*e) for e in G.SUPPORT_NODES) + """
UNION ALL SELECT id, 'Team', arg_max(team, (step, _ord)), concat('Team ', arg_max(team, (step, _ord))), arg_max(team, (step, _ord)) FROM (
  SELECT concat('Team:', trim(regexp_replace(team, '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS id, * FROM team_rows) GROUP BY id"""


def _nodes(r):
    r.hold("tickets")
    return G.build_nodes(r.support())  # read again where needed: stored, their texts and properties are many times the input


@query("graph_nodes", "SELECT node_id, node_type, label, text FROM g_nodes")
def _(r):
    r.hold("tickets")
    return G.build_nodes(r.support(), columns=("node_type", "label", "text"))


_ES = []
for _i, (_t, _st, _sc, _dt, _dc, _k) in enumerate(G.SUPPORT_EDGES):
    _ES.append(f"SELECT concat('{_st}:', {_sc}) AS src, concat('{_dt}:', {_dc}) AS dst, '{_k}' AS edge_type, {_i} AS step, _ord, '' AS note FROM {_t} WHERE {_sc} <> '' AND {_dc} <> ''")
for _i, (_t, _key, _o, _role, _kind) in enumerate(G.TEAM_COLUMNS):
    _ES.append(f"SELECT concat('{_kind}:', {_key}), concat('Team:', trim(regexp_replace(trim({_o}), '[^a-zA-Z0-9_]+', '_', 'g'), '_')), 'OWNED_BY_TEAM', {30 + _i}, _ord, '{_role}' FROM {_t} WHERE trim({_o}) <> ''")
_ES += ["SELECT concat('Ticket:', tk), concat('GitHubIssue:', issue_id), 'RELATED_TO_ISSUE', 60, _ord, '' FROM issue_links",
        "SELECT concat('Ticket:', ticket_id), concat('Policy:', policy_id), 'REFERENCES_POLICY', 90, _ord, 'rule_based_ticket_context' FROM rule_hits",
        "SELECT concat('Ticket:', ticket_id), concat('Policy:', linked_policy_id), 'HAS_RESOLUTION', 91, _ord, resolution_id FROM ticket_resolutions",
        "SELECT concat('Ticket:', ticket_id), concat('Policy:', linked_policy_id), 'REFERENCES_POLICY', 92, _ord, resolution_id FROM ticket_resolutions",
        "SELECT concat('Ticket:', ticket_id), concat('GitHubIssue:', linked_issue_id), 'RELATED_TO_ISSUE', 93, _ord, resolution_id FROM ticket_resolutions"]
SHARED["g_edges0"] = " UNION ALL ".join(_ES)
SHARED["g_edges"] = """
SELECT src, dst, edge_type, arg_min(note, (step, _ord)) AS note FROM g_edges0 WHERE src IN (SELECT node_id FROM g_nodes) AND dst IN (SELECT node_id FROM g_nodes) GROUP BY 1, 2, 3"""


def _edges(r):
    r.hold("tickets")
    return G.build_edges(r.support())


@query("graph_edges", "SELECT src, dst, edge_type, note FROM g_edges")
def _(r):
    edges = _edges(r)
    note = F.coalesce(F.col("properties")["role"], F.col("properties")["reason"], F.col("properties")["resolution_id"], F.lit(""))
    return edges.select("src", "dst", "edge_type", note.alias("note"))


@query("banking_graph", """
SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (
  SELECT 'HAS_ACCOUNT' AS type, customer_id AS src, account_id AS dst FROM banking_accounts UNION ALL SELECT 'MADE_TRANSACTION', account_id, transaction_id FROM banking_transactions
  UNION ALL SELECT 'INITIATED_TRANSACTION', customer_id, transaction_id FROM banking_transactions UNION ALL SELECT 'PAID_MERCHANT', transaction_id, merchant_id FROM banking_transactions
  UNION ALL SELECT 'TRIGGERED_ALERT', transaction_id, alert_id FROM banking_alerts UNION ALL SELECT 'HAS_ALERT', customer_id, alert_id FROM banking_alerts
  UNION ALL SELECT 'HAS_AML_CASE', customer_id, case_id FROM banking_cases
  UNION ALL SELECT 'LINKED_TO_CASE', unnest(string_split(linked_alert_ids, '|')), case_id FROM banking_cases) GROUP BY 1""")
def _(r):
    _, edges = G.banking_graph(r.banking())
    return edges.groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"),
                                                              F.countDistinct("dst").alias("targets"))


SHARED["g_adj"] = "SELECT DISTINCT a, z FROM (SELECT src AS a, dst AS z FROM g_edges UNION ALL SELECT dst, src FROM g_edges)"
SHARED["g_h0"] = "SELECT item_id AS query_id, concat('Customer:cust_', CAST(item_id AS STRING)) AS node_id FROM benchmark"
SHARED["g_h1"] = "SELECT DISTINCT query_id, z AS node_id FROM g_h0 JOIN g_adj ON node_id = a"
SHARED["g_h2"] = "SELECT DISTINCT query_id, z AS node_id FROM g_h1 JOIN g_adj ON node_id = a"


@query("graph_bfs", """
SELECT query_id, node_id, min(hop) AS hop FROM (SELECT query_id, node_id, 1 AS hop FROM g_h1 UNION ALL SELECT query_id, node_id, 2 FROM g_h2)
WHERE (query_id, node_id) NOT IN (SELECT (query_id, node_id) FROM g_h0) GROUP BY 1, 2""")
def _(r):
    seeds = r["benchmark"].select(F.col("item_id").alias("query_id"), F.concat(F.lit("Customer:cust_"), F.col("item_id").cast("string")).alias("node_id"))
    return G.table_neighbors(r.support(), seeds, 2).select("query_id", "node_id", "hop")


SHARED["gs_q"] = f"SELECT query_id, trim(lower(query), ' ' || chr(9) || chr(10) || chr(13)) AS q, list_filter({TOK.format(e='query')}, lambda t: length(t) > 1) AS ts FROM questions"
SHARED["gs_n"] = "SELECT node_id, node_type, label, lower(concat_ws(' ', node_id, node_type, label, text, props)) AS hay FROM g_nodes"
SHARED["gs"] = """
SELECT query_id, node_id, node_type, label, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_type, label, node_id) AS rank FROM (
  SELECT query_id, node_id, node_type, label, len(list_filter(ts, lambda t: contains(hay, t))) + CASE WHEN contains(hay, q) THEN 5 ELSE 0 END + CASE WHEN lower(label) = q THEN 4 ELSE 0 END AS score
  FROM gs_q JOIN gs_n ON true) WHERE score > 0) WHERE rank <= 5"""


@query("graph_search", "SELECT query_id, node_id, rank, score FROM gs")
def _(r):
    return G.search_nodes(_nodes(r), r["questions"], 5).select("query_id", "node_id", "rank", "score")


SHARED["gc_ids"] = "SELECT query_id, node_id FROM gs UNION SELECT query_id, z FROM gs JOIN g_adj ON node_id = a"


@query("graph_context", """
SELECT s.query_id, e.src, e.dst, e.edge_type FROM g_edges e JOIN gc_ids s ON e.src = s.node_id JOIN gc_ids d ON e.dst = d.node_id AND s.query_id = d.query_id""")
def _(r):
    edges, nodes = _edges(r), _nodes(r)
    return G.graph_context(nodes, edges, r["questions"], 5, 1)["edges"]


SHARED["gct_n"] = """
SELECT query_id, string_agg(concat('- ', node_type, ' ', node_id, ': ', label, '. ', CASE WHEN length(s) > 240 THEN substr(s, 1, 237) || '...' ELSE s END), chr(10) ORDER BY node_type, label, node_id) AS t
FROM (SELECT i.query_id, n.*, replace(n.text, chr(10), ' ') AS s FROM gc_ids i JOIN g_nodes n USING (node_id)) GROUP BY query_id"""
SHARED["gct_m"] = "SELECT query_id, string_agg(concat('- ', node_type, ' ', node_id, ': ', label), chr(10) ORDER BY rank) AS t FROM gs GROUP BY query_id"
SHARED["gct_e"] = """
SELECT query_id, string_agg(concat('- ', src, ' -[', edge_type, ']-> ', dst), chr(10) ORDER BY src, dst, edge_type) AS t FROM (
  SELECT s.query_id, e.src, e.dst, e.edge_type FROM g_edges e JOIN gc_ids s ON e.src = s.node_id JOIN gc_ids d ON e.dst = d.node_id AND s.query_id = d.query_id) GROUP BY query_id"""


@query("graph_context_text", """
SELECT q.query_id, concat_ws(chr(10), 'Graph Context' || chr(10) || chr(10) || 'Matched nodes:', coalesce(m.t, '- No matching nodes found.'), chr(10) || 'Context nodes:', c.t, chr(10) || 'Context edges:', e.t) AS context_text
FROM questions q LEFT JOIN gct_m m ON m.query_id = q.query_id LEFT JOIN gct_n c ON c.query_id = q.query_id LEFT JOIN gct_e e ON e.query_id = q.query_id""")
def _(r):
    edges, nodes = _edges(r), _nodes(r)
    ctx = G.graph_context(nodes, edges, r["questions"], 5, 1)
    return G.render_graph_context(ctx, nodes, r["questions"])
