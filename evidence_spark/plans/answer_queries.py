"""Queries over evidence, citations, answers and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import chunking as C, corpus as CP, evidence as EV, graph as G, metrics as M, questions as QN, search as SE
from ..session import materialise
from .asking import ask, sparse_hits, staged_retrieval
from .registry import SHARED, in_list, query, sql_list
from .retrieval_queries import _corpus, _lex, ids, overlap_score, ret

AS_OF = "2024-02-15 00:00:00"
joined = lambda c: F.array_join(c, "|")
W = "' ' || chr(9) || chr(10) || chr(13)"

HIT_FIELDS = ["source_type", "entity_id", "title", "customer_id", "ticket_id", "product_id", "service_id", "status", "priority", "created_at"]


def _evidence(r, fields=EV.READ_FIELDS, text=True, numbered=True):
    """Evidence of one question per customer: its tickets as hits, its neighbourhood as nodes.

    Only what a query reads travels: the node properties in ``fields`` (None is all), texts and numbers where they are asked for.
    """
    def build():
        r.hold("tickets")
        hits = r["customer_hits"].withColumn("metadata", EV.metadata_map(HIT_FIELDS))
        nodes = G.build_nodes(r.support("customers", "accounts", "tickets", "risk_events"), teams=[])
        if fields is not None:
            nodes = nodes.withColumn("properties", F.map_filter("properties", lambda k, v: k.isin(*fields)))
        if not text:
            hits, nodes = hits.withColumn("text", F.lit("")), nodes.withColumn("text", F.lit(""))
        return EV.merge_evidence(EV.evidence_from_hits(hits), EV.evidence_from_nodes(r["customer_nodes"], nodes), numbered=numbered)
    return r.shared(f"evidence:{fields is None}:{text}:{numbered}", build)


_IDC = ["customer_id", "account_id", "ticket_id", "product_id", "service_id", "risk_event_id"]
SHARED["ev_n"] = """
SELECT 'Customer:' || customer_id AS id, 'customer' AS st, customer_id, account_id, '' AS ticket_id, '' AS product_id, '' AS service_id, '' AS risk_event_id, status, '' AS priority, '' AS sla_status, created_at, '' AS updated_at, '' AS detected_at FROM customers
UNION ALL SELECT 'Account:' || account_id, 'account', '', account_id, '', '', '', '', '', '', '', created_at, '', '' FROM accounts
UNION ALL SELECT 'Ticket:' || ticket_id, 'ticket', customer_id, account_id, ticket_id, product_id, service_id, '', status, priority, sla_status, created_at, updated_at, '' FROM tickets
UNION ALL SELECT 'RiskEvent:' || risk_event_id, 'risk_event', customer_id, account_id, ticket_id, product_id, service_id, risk_event_id, status, '', '', '', '', detected_at FROM risk_events"""
SHARED["ev_g"] = """
SELECT c.query_id, n.*, g.node_type, g.label, g.text FROM customer_nodes c JOIN ev_n n ON c.node_id = n.id JOIN g_nodes g ON n.id = g.node_id"""
SHARED["ev"] = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vr, nt, gl, id) AS pos FROM (
  SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(g.id, 'Ticket:' || v.entity_id) AS id, CASE WHEN v.query_id IS NOT NULL AND g.query_id IS NOT NULL THEN 'both' WHEN v.query_id IS NOT NULL THEN 'vector' ELSE 'graph' END AS context_source,
    CASE WHEN v.query_id IS NOT NULL AND g.query_id IS NOT NULL THEN concat('Vector evidence:', chr(10), trim(v.text), chr(10), chr(10), 'Graph evidence:', chr(10), trim(g.text)) ELSE coalesce(v.text, g.text) END AS text,
    coalesce(v.source_type, g.st) AS source_type, coalesce(v.title, g.label) AS title, coalesce(v.rank, 2147483647) AS vr, coalesce(g.node_type, '') AS nt, coalesce(g.label, '') AS gl,
    coalesce(v.entity_id, split_part(g.id, ':', 2)) AS entity_id, {', '.join(f"coalesce(nullif(v.{c}, ''), g.{c}, '') AS {c}" for c in ['customer_id', 'ticket_id', 'product_id', 'service_id'])},
    coalesce(g.account_id, '') AS account_id, coalesce(g.risk_event_id, '') AS risk_event_id, coalesce(nullif(v.status, ''), g.status, '') AS status, coalesce(nullif(v.priority, ''), g.priority, '') AS priority,
    coalesce(g.sla_status, '') AS sla_status, coalesce(nullif(v.created_at, ''), g.created_at, '') AS created_at, coalesce(g.updated_at, '') AS updated_at, coalesce(g.detected_at, '') AS detected_at
  FROM customer_hits v FULL OUTER JOIN ev_g g ON v.query_id = g.query_id AND g.id = 'Ticket:' || v.entity_id)"""


@query("merge_evidence", "SELECT query_id, pos, id, context_source, source_type, title, text FROM ev")
def _(r):
    return _evidence(r).select("query_id", "pos", "id", "context_source", "source_type", "title", "text")


_CL = " UNION ALL ".join(
    f"SELECT query_id, entity_id, '{f}' AS field, lower({f}) AS value FROM ev UNION ALL SELECT query_id, entity_id, '{f}', lower(trim(unnest(regexp_extract_all(text, '(?im)^\\s*{f.replace('_', '[_ ]')}\\s*:\\s*([^\\n]+)', 1)), {W})) FROM ev"
    for f in ["status", "priority", "sla_status"])
SHARED["clash"] = f"""
SELECT query_id, field, entity_id, string_agg(value, ', ' ORDER BY value) AS vals FROM (SELECT DISTINCT * FROM ({_CL}) WHERE value <> '') GROUP BY 1, 2, 3 HAVING count(*) > 1"""


@query("contradictions", "SELECT query_id, field, entity_id, vals FROM clash")
def _(r):
    return EV.contradictions(_evidence(r, numbered=False)).select("query_id", "field", "entity_id", F.array_join("values", ", ").alias("vals"))


def _vocab(kind, prefix, words):
    return f"CASE WHEN list_has_any(ts, {sql_list(words)}) OR len(list_filter(qi, lambda x: starts_with(x, '{prefix}'))) > 0 THEN '{kind}' END"


_REQ = "list_distinct(list_filter([" + ", ".join(_vocab(*v) for v in K.SUFFICIENCY_VOCAB) + \
    ", CASE WHEN list_contains(ts, 'sla') THEN 'ticket' END, CASE WHEN list_contains(ts, 'sla') THEN 'knowledge_base' END], lambda x: x IS NOT NULL))"
SHARED["sq0"] = f"SELECT query_id, query, {ids('query')} AS qi, list_filter(regexp_extract_all(lower(query), '[a-z0-9_]+'), lambda t: length(t) > 2) AS ts FROM customer_questions"
SHARED["sq"] = f"""
SELECT query_id, query, qi, CASE WHEN len(r0) = 0 AND list_has_any(ts, {sql_list(K.CONTEXT_WORDS)}) THEN ['ticket', 'customer'] ELSE r0 END AS req FROM (SELECT *, {_REQ} AS r0 FROM sq0)"""
_TS = "CAST(replace(replace(nullif({}, ''), 'T', ' '), 'Z', '') AS TIMESTAMP)"
_ITEM_IDS = "list_filter([" + ", ".join(f"lower({c})" for c in ["entity_id", *_IDC]) + ", lower(split_part(id, ':', 2))], lambda x: x <> '') || " + ids("text")
SHARED["suff"] = f"""
SELECT q.query_id, q.req, q.qi, coalesce(n, 0) AS n, coalesce(sts, []::VARCHAR[]) AS sts, coalesce(m, 0) AS m, coalesce(anyid, false) AS anyid, newest, coalesce(c.k, 0) AS k FROM sq q
LEFT JOIN (SELECT e.query_id, count(*) AS n, list_distinct(list(source_type)) AS sts, bool_or(len({_ITEM_IDS}) > 0) AS anyid,
    len(list_distinct(flatten(list(list_intersect({_ITEM_IDS}, s.qi))))) AS m, max(coalesce({_TS.format('created_at')}, {_TS.format('updated_at')}, {_TS.format('detected_at')})) AS newest
  FROM ev e JOIN sq s ON e.query_id = s.query_id GROUP BY 1) a ON q.query_id = a.query_id
LEFT JOIN (SELECT query_id, count(*) AS k FROM clash GROUP BY 1) c ON q.query_id = c.query_id"""
SHARED["suff2"] = f"""
SELECT *, greatest(0.0, least(1.0, least(n / 4.0, 1.0) * 0.22 + least(len(sts) / 3.0, 1.0) * 0.18
  + (CASE WHEN len(qi) = 0 THEN (CASE WHEN anyid THEN 0.35 ELSE 0.0 END) ELSE m / len(qi) END) * 0.18
  + (CASE WHEN len(req) = 0 THEN least(len(sts) / 2.0, 1.0) ELSE len(list_intersect(req, sts)) / len(req) END) * 0.25
  + (CASE WHEN newest IS NULL THEN 0.4 WHEN age <= 180 THEN 1.0 WHEN age <= 365 THEN 0.6 ELSE 0.1 END) * 0.07 - CASE WHEN k > 0 THEN 0.15 ELSE 0.0 END)) AS score,
  list_sort(list_filter(req, lambda x: NOT list_contains(sts, x))) AS miss
FROM (SELECT *, floor(date_diff('second', newest, TIMESTAMP '{AS_OF}') / 86400.0) AS age FROM suff)"""
SHARED["suff3"] = "SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM suff2"


def _suff(r, numbered=True):
    return r.shared("sufficiency", lambda: EV.evidence_sufficiency(r["customer_questions"], _evidence(r, numbered=numbered), AS_OF))


@query("evidence_sufficiency", """
SELECT query_id, round(score, 6) AS score, level, n AS evidence_count, array_to_string(list_sort(sts), '|') AS source_types, array_to_string(list_sort(req), '|') AS required_types,
  array_to_string(miss, '|') AS missing_source_types, k AS conflicts FROM suff3""")
def _(r):
    return _suff(r, numbered=False).select("query_id", F.round("raw_score", 6).alias("score"), "level", "evidence_count", joined("source_types").alias("source_types"),
                           joined("required_types").alias("required_types"), joined("missing_source_types").alias("missing_source_types"),
                           F.size("conflicts").alias("conflicts"))


_RISKY = f"list_has_any(qt, {sql_list(K.RISK_QUERY_WORDS)})"
SHARED["cq"] = f"SELECT query_id, query, {ret('query')} AS qt, {ids('query')} AS qi FROM customer_questions"
SHARED["cand"] = f"""
SELECT query_id, pos, id, entity_id, title, source_type, context_source, qt, qi, list_filter(list_transform(flatten(list_transform(
    list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(x, ' -' || chr(9))), lambda x: x <> '' AND NOT (suffix(x, ':') AND length(x) <= 40)),
    lambda x: string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x, {W})), lambda x: x <> '') AS cs
FROM ev JOIN cq USING (query_id)"""
SHARED["cites0"] = f"""
SELECT query_id, pos, id, entity_id, title, source_type, context_source, coalesce(list_sort(list_transform(cs, lambda s, i: {{
   'a': len(list_intersect(qt, {ret('s')})) + CASE WHEN {_RISKY} THEN len(list_intersect({ret('s')}, {sql_list(K.RISK_SIGNAL_WORDS)})) ELSE 0 END,
   'b': len(list_intersect(qi, {ids('s')})), 'c': -length(s), 'd': -i, 's': s}}), 'DESC')[1].s, '') AS sn FROM cand"""
SHARED["cites"] = f"""
SELECT *, CASE WHEN sn = '' THEN NULL ELSE count(*) FILTER (sn <> '') OVER (PARTITION BY query_id ORDER BY pos) END AS claim FROM (
  SELECT query_id, pos, id, entity_id, title, source_type, context_source, CASE WHEN length(f) <= 320 THEN f ELSE rtrim(substr(f, 1, 317)) || '...' END AS sn
  FROM (SELECT *, regexp_replace(trim(sn, {W}), '\\s+', ' ', 'g') AS f FROM cites0))"""


def _cites(r):
    return r.shared("citations", lambda: EV.citations(r["customer_questions"], _evidence(r)))


@query("best_snippets", "SELECT query_id, pos AS index, id, entity_id, source_type, sn AS snippet, coalesce(CASE WHEN claim <= 4 THEN claim END, 0) AS claim_index FROM cites")
def _(r):
    return _cites(r).select("query_id", "index", "id", "entity_id", "source_type", "snippet", F.coalesce("claim_index", F.lit(0)).alias("claim_index"))


_CID = "list_transform([entity_id, split_part(id, ':', 2)], lambda x: lower(x))"
_SENS = "[" + ", ".join(f"CASE WHEN contains(lower(query), '{p}') THEN '{lab}' END" for p, lab in K.SENSITIVE_DETAILS) + "]"
SHARED["ans"] = f"""
SELECT q.query_id, q.query, q.qt, q.qi, coalesce(u.n, 0) AS n, coalesce(u.types, 0) AS types, coalesce(u.cids, []::VARCHAR[]) AS cids, {ret("coalesce(u.snips, '')")} AS et, s.level, s.miss,
  list_sort(list_distinct(list_filter({_SENS}, lambda x: x IS NOT NULL))) AS priv FROM cq q JOIN suff3 s ON q.query_id = s.query_id
LEFT JOIN (SELECT query_id, count(*) AS n, count(DISTINCT source_type) AS types, list_distinct(flatten(list({_CID}))) AS cids, string_agg(sn, ' ' ORDER BY pos) AS snips FROM cites WHERE claim <= 4 GROUP BY 1) u ON q.query_id = u.query_id"""
SHARED["ans2"] = """
SELECT *, list_filter([CASE WHEN n = 0 THEN 'relevant retrieved enterprise support evidence' END,
  CASE WHEN n > 0 AND len(gone) > 0 THEN concat('retrieved evidence for entity ID(s): ', array_to_string(gone, ', ')) END,
  CASE WHEN n > 0 AND len(priv) > 0 THEN concat('retrieved evidence containing requested sensitive detail(s): ', array_to_string(priv, ', ')) END,
  CASE WHEN n > 0 AND len(qt) > 0 AND NOT list_has_any(qt, et || cids) THEN 'specific evidence matching the requested detail' END,
  CASE WHEN level = 'low' AND len(miss) > 0 THEN concat('critical source type(s): ', array_to_string(miss, ', ')) END,
  CASE WHEN level = 'low' AND len(miss) = 0 THEN 'additional corroborating enterprise support evidence' END], lambda x: x IS NOT NULL) AS mi,
  list_has_any(qi, cids) AS exact, len(list_intersect(qt, et)) AS ov FROM (SELECT *, list_sort(list_filter(qi, lambda x: NOT list_contains(cids, x))) AS gone FROM ans)"""


@query("missing_information", "SELECT query_id, array_to_string(mi, '|') AS missing_information FROM ans2")
def _(r):
    return EV.missing_information(r["customer_questions"], _cites(r), _suff(r)).withColumn("missing_information", joined("missing_information"))


@query("answer_confidence", """
SELECT query_id, CASE least(own, CASE level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT *, CASE WHEN n = 0 THEN 0 WHEN len(mi) > 0 THEN (CASE WHEN n >= 3 AND types >= 2 AND exact THEN 1 ELSE 0 END) WHEN n >= 4 AND types >= 2 AND (exact OR ov >= 3) THEN 2
    WHEN n >= 2 AND (types >= 2 OR exact OR ov >= 2) THEN 1 ELSE 0 END AS own FROM ans2)""")
def _(r):
    return EV.confidence(r["customer_questions"], _cites(r), _suff(r))


SHARED["conf"] = """
SELECT query_id, mi, n, CASE least(own, CASE level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT *, CASE WHEN n = 0 THEN 0 WHEN len(mi) > 0 THEN (CASE WHEN n >= 3 AND types >= 2 AND exact THEN 1 ELSE 0 END) WHEN n >= 4 AND types >= 2 AND (exact OR ov >= 3) THEN 2
    WHEN n >= 2 AND (types >= 2 OR exact OR ov >= 2) THEN 1 ELSE 0 END AS own FROM ans2)"""
SHARED["bullets"] = """
SELECT query_id, string_agg(concat('- [', claim, '] ', CASE WHEN t <> '' AND e <> '' THEN concat(k, ' ', e, ' (', t, ')') WHEN e <> '' THEN concat(k, ' ', e) WHEN t <> '' THEN concat(k, ' (', t, ')') ELSE k END, ': ', trim(sn)), chr(10) ORDER BY claim) AS body
FROM (SELECT *, replace(CASE WHEN source_type = '' THEN 'source' ELSE source_type END, '_', ' ') AS k, trim(coalesce(title, '')) AS t,
  coalesce(nullif(trim(entity_id), ''), trim(coalesce(id, ''))) AS e FROM cites WHERE claim <= 4) GROUP BY query_id"""


@query("grounded_answers", """
SELECT query_id, CASE WHEN body IS NULL THEN concat('I do not have enough retrieved enterprise support evidence to answer this question. Missing information: ', coalesce(nullif(array_to_string(mi, '; '), ''), 'relevant retrieved enterprise support evidence'), '.')
  ELSE concat_ws(chr(10), CASE WHEN len(mi) > 0 THEN 'Based only on the retrieved enterprise support evidence, I can answer the supported parts but some requested details are missing.' ELSE 'Based only on the retrieved enterprise support evidence:' END,
    body, CASE WHEN len(mi) > 0 THEN concat('Missing information: ', array_to_string(mi, '; '), '.') END) END AS answer,
  confidence, array_to_string(mi, '|') AS missing_information, n AS used_citations FROM conf LEFT JOIN bullets USING (query_id)""")
def _(r):
    return EV.grounded_answers(r["customer_questions"], _cites(r), _suff(r)).withColumn("missing_information", joined("missing_information"))


@query("context_blocks")
def _(r):
    return EV.context_blocks(_evidence(r, fields=None))


@query("evidence_breakdown", """
SELECT query_id, CAST(sum(n) AS BIGINT) AS evidence_count, string_agg(concat(source_type, '=', n), ',' ORDER BY concat(source_type, '=', n)) AS source_type_counts, any_value(top5) AS top_evidence_ids
FROM (SELECT query_id, source_type, count(*) AS n FROM ev GROUP BY 1, 2) JOIN (SELECT query_id, string_agg(id, ',' ORDER BY pos) AS top5 FROM ev WHERE pos <= 5 GROUP BY 1) USING (query_id) GROUP BY 1""")
def _(r):
    return EV.evidence_breakdown(_evidence(r, text=False))


def _leaf_corpus(r):
    """Sections of the corpus as parents and their leaves as what is searched.

    They are cut again where they are read: stored, they would be the corpus twice more.
    """
    r.hold("tickets")
    parents = CP.split_sections(r["corpus"])
    about = [c for c in ["path", "url", *SE.VALUE_FIELDS] if c in r["corpus"].columns]
    leaves = C.build_leaves(parents, about)
    return parents, leaves.select(F.col("leaf_id").alias("doc_key"), "doc_id", "text", "node_type", "leaf_id", "chunk_id", "parent_id", "origin_doc_id", "source", *about)


@query("staged_retrieval")
def _(r):
    parents, leaves = _leaf_corpus(r)
    vectors = leaves.select("doc_key", F.concat(F.lit("document:doc_"), F.substring_index("origin_doc_id", "::", -1)).alias("_of")) \
        .join(r["doc_vectors"].withColumnRenamed("doc_key", "_of"), "_of")  # a leaf has its document's vector
    dense = SE.dense_search(r["question_vectors"], vectors, 24)
    hits = materialise(SE.rrf_fuse(dense, sparse_hits(r["questions"], leaves, 24), 24))
    out = staged_retrieval(r["questions"], hits, leaves, 4, parents, overlap_score)
    return out.select("query_id", "doc_id", "node_type", "final_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("ask_two_pass")
def _(r):
    r.spread(orders="o_orderkey")
    r.hold("tickets")
    nodes = r.shared("ask_nodes", lambda: G.build_nodes(r.support()))
    edges = G.build_edges(r.support())
    out = ask(r["questions"], _corpus(r), nodes, edges, as_of=AS_OF, k=5, depth=1, vectors=(r["question_vectors"], r["doc_vectors"]))
    return out.select("query_id", "intent", "attempts", "level", F.round("score", 6).alias("score"), "confidence", "answer")


# -- metrics ------------------------------------------------------------------------------

_SP = "list_filter(string_split({}, '|'), lambda x: x <> '')"


def _cases(r):
    sp = lambda c: F.filter(F.split(c, "\\|"), lambda x: x != "")
    return r["eval_cases"].select("query_id", "query", sp("sources").alias("expected_sources"), sp("documents").alias("expected_documents"),
                                  sp("categories").alias("expected_categories"), sp("intents").alias("expected_answer_intents"),
                                  sp("entity_ids").alias("expected_entity_ids"), sp("source_types").alias("expected_source_types"))


@query("eval_cases", f"""
SELECT concat('case-', lpad(CAST(rn AS STRING), CAST(greatest(3, length(CAST(rn AS STRING))) AS INTEGER), '0'), '-', left(trim(regexp_replace(regexp_replace(trim(lower(query), {W}), '\\s+', ' ', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-'), 64)) AS case_id, sources, documents
FROM (SELECT *, row_number() OVER (ORDER BY query_id) AS rn FROM eval_cases)""")
def _(r):
    from ..sources.cases import load_eval_cases
    raw = r["eval_cases"].select(F.col("query_id").alias("_ord"), "query", F.split("sources", "\\|").alias("expected_sources"),
                                 F.lit(None).cast("array<string>").alias("expected_documents"), F.col("documents").alias("expected_document"))
    out = load_eval_cases(raw)
    return out.select("case_id", joined("expected_sources").alias("sources"), joined("expected_documents").alias("documents"))


def _annotated(r):
    def build():
        docs = _corpus(r).select("doc_key", "doc_id", "source", "source_type", "title", "path", "url")
        return M.annotate_relevance(_lex(r, 10).join(docs, "doc_key"), _cases(r))
    return r.shared("annotated", build)


def _tw(lst, cands):
    return f"len(list_filter({_SP.format(lst)}, lambda e: len(list_filter({cands}, lambda c: c <> '' AND (contains(c, lower(e)) OR contains(lower(e), c)))) > 0)) > 0"


SHARED["annot"] = f"""
SELECT *, 3 * md::INT + 2 * mc::INT + ms::INT AS relevance FROM (SELECT l.query_id, l.rank, c.doc_id, c.title, c.source,
  list_has_any(list_transform({_SP.format('sources')}, lambda x: lower(x)), [lower(c.source), lower(c.source_type)]) AS ms, {_tw('documents', '[lower(c.doc_id), lower(c.title), lower(c.path), lower(c.url)]')} AS md,
  {_tw('categories', '[lower(c.source_type), lower(c.title), lower(c.path)]')} AS mc FROM lex l JOIN corpus c USING (doc_key) JOIN eval_cases e ON l.query_id = e.query_id WHERE l.rank <= 10)"""


@query("relevance", "SELECT query_id, rank, ms AS match_source, md AS match_document, mc AS match_category, relevance FROM annot")
def _(r):
    return _annotated(r).select("query_id", "rank", "match_source", "match_document", "match_category", "relevance")


SHARED["ndcg_"] = """
SELECT query_id, CASE WHEN sum(g / log2(b + 1)) > 0 THEN sum(g / log2(rank + 1)) / sum(g / log2(b + 1)) ELSE 0.0 END AS ndcg FROM (
  SELECT *, pow(2, relevance) - 1 AS g, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS b FROM annot) GROUP BY 1"""


@query("ndcg", "SELECT query_id, round(ndcg, 6) AS ndcg FROM ndcg_")
def _(r):
    return M.ndcg(_annotated(r), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


SHARED["cranks"] = """
SELECT e.query_id, e.query, sources <> '' AS es, documents <> '' AS ed, categories <> '' AS ec, (sources <> '' OR documents <> '' OR categories <> '') AS eo, rs, rd, rc, ro, coalesce(n, 0) AS n, ndcg
FROM eval_cases e LEFT JOIN (SELECT query_id, min(rank) FILTER (ms) AS rs, min(rank) FILTER (md) AS rd, min(rank) FILTER (mc) AS rc, min(rank) FILTER (relevance > 0) AS ro, count(*) AS n FROM annot GROUP BY 1) a
  ON e.query_id = a.query_id LEFT JOIN ndcg_ d ON e.query_id = d.query_id"""


@query("rank_metrics", " UNION ALL ".join(f"""
SELECT '{a}' AS aspect, count(*) FILTER ({e}) AS queries_evaluated, count(*) FILTER ({e} AND {rk} IS NOT NULL) AS hits, round(avg(CASE WHEN {e} THEN ({rk} IS NOT NULL)::INT END), 6) AS hit_at_k,
  round(avg(CASE WHEN {e} THEN coalesce(1.0 / {rk}, 0) END), 6) AS mrr, coalesce(round(avg(CASE WHEN {e} AND '{a}' = 'overall' THEN coalesce(ndcg, 0) END), 6), -1) AS ndcg_at_k FROM cranks"""
    for a, e, rk in [("overall", "eo", "ro"), ("source", "es", "rs"), ("document", "ed", "rd"), ("category", "ec", "rc")]))
def _(r):
    m = M.rank_metrics(_annotated(r), _cases(r), 10)
    return m.select("aspect", "queries_evaluated", "hits", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"),
                    F.coalesce(F.round("ndcg_at_k", 6), F.lit(-1.0)).alias("ndcg_at_k"))


@query("intent_accuracy", f"""
SELECT count(*) AS queries_evaluated, count(*) FILTER (ok) AS hits, round(avg(ok::INT), 6) AS accuracy FROM (
  SELECT list_has_all(a.intents, {_SP.format('e.intents')}) AS ok FROM eval_cases e JOIN analyzed a ON e.query_id = a.query_id WHERE e.intents <> '')""")
def _(r):
    out = M.intent_accuracy(_cases(r), QN.analyze_queries(r["questions"]))
    return out.select("queries_evaluated", "hits", F.round("accuracy", 6).alias("accuracy"))


@query("benchmark_summary", """
SELECT 'totals' AS section, unnest(['query_count', 'total_results', 'average_results_per_query', 'overall_labeled_queries', 'source_labeled_queries', 'document_labeled_queries', 'category_labeled_queries']) AS name,
  unnest([count(*)::DOUBLE, sum(n)::DOUBLE, round(avg(n), 6), count(*) FILTER (eo)::DOUBLE, count(*) FILTER (es)::DOUBLE, count(*) FILTER (ed)::DOUBLE, count(*) FILTER (ec)::DOUBLE]) AS value FROM cranks
UNION ALL SELECT 'source_counts', source, count(*)::DOUBLE FROM annot WHERE source <> '' GROUP BY 2""")
def _(r):
    return M.benchmark_summary(_annotated(r), _cases(r), 10).withColumn("value", F.round("value", 6))


@query("labelled_misses", """
SELECT c.query_id, c.query, coalesce(a.title, '') AS top_result_title, coalesce(a.source, '') AS top_result_source FROM cranks c LEFT JOIN annot a ON c.query_id = a.query_id AND a.rank = 1
WHERE eo AND ro IS NULL ORDER BY c.query_id LIMIT 10""")
def _(r):
    return M.labelled_misses(_annotated(r), _cases(r), 10)


_EF = ["entity_id", "customer_id", "account_id", "ticket_id", "product_id", "service_id", "policy_id"]


def _ranked_evidence(r):
    docs = _corpus(r).select("doc_key", F.col("doc_id").alias("id"), "text", "title", "source_type", EV.metadata_map([*_EF, "source_type", "title"]).alias("metadata"))
    return _lex(r, 5).withColumnRenamed("rank", "pos").join(docs, "doc_key")


SHARED["evr"] = f"""
SELECT e.query_id, e.query, {_SP.format('entity_ids')} AS want, {_SP.format('source_types')} AS wt, coalesce(al, []::VARCHAR[]) AS al, coalesce(ty, []::VARCHAR[]) AS ty, coalesce(t.n, 0) AS n FROM eval_cases e LEFT JOIN (
  SELECT query_id, count(*) AS n, list_distinct(flatten(list(list_transform([doc_id, regexp_extract(doc_id, '([^:]*)$', 1), {', '.join(_EF)}], lambda x: lower(x))))) AS al, list_distinct(list(source_type)) AS ty
  FROM lex JOIN corpus USING (doc_key) WHERE rank <= 5 GROUP BY 1) t ON e.query_id = t.query_id"""
SHARED["evr2"] = """
SELECT query_id, query, n, CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, al)) / len(want), 6) END AS recall, CASE WHEN len(wt) > 0 THEN list_has_any(wt, ty) END AS sth,
  CASE WHEN len(wt) > 0 THEN list_has_all(ty, wt) END AS sta, CASE WHEN n = 0 THEN false WHEN len(want) > 0 THEN list_has_any(want, al) WHEN len(wt) > 0 THEN list_has_any(wt, ty) ELSE n > 0 END AS grounded,
  len(list_intersect(want, al)) > 0 AS eh, list_has_any(wt, ty) AS sh FROM evr"""


def _recall(r):
    cases = _cases(r).withColumn("missing_info", F.col("query_id") % 2 == 1)
    return r.shared("recall", lambda: M.evidence_recall(cases, _ranked_evidence(r)))


@query("evidence_recall", "SELECT query_id, coalesce(recall, -1) AS recall, coalesce(sth::INT, -1) AS source_type_hit, coalesce(sta::INT, -1) AS source_type_all_hit, grounded AS groundedness FROM evr2")
def _(r):
    tri = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    return _recall(r).select("query_id", F.coalesce(F.round("recall", 6), F.lit(-1.0)).alias("recall"), tri("source_type_hit"), tri("source_type_all_hit"), "groundedness")


@query("grounding_proxies", """
SELECT e.query_id, grounded AS groundedness, CASE WHEN e.query_id % 2 = 1 THEN ((eh OR sh OR n = 0) AND NOT (contains(lower(query), 'phone') AND coalesce(ph, false))
   AND NOT ((contains(lower(query), 'discount') OR contains(lower(query), 'approval chain')) AND coalesce(dp, false)))::INT ELSE -1 END AS missing_info_handled FROM evr2 e LEFT JOIN (
  SELECT query_id, bool_or(contains(t, 'private phone') OR contains(t, 'phone number') OR contains(t, 'mobile number')) AS ph, bool_or(contains(t, 'discount approval') OR contains(t, 'approval chain') OR contains(t, 'discount percentage')) AS dp
  FROM (SELECT query_id, lower(concat(text, ' ', title)) AS t FROM lex JOIN corpus USING (doc_key) WHERE rank <= 5) GROUP BY 1) p ON e.query_id = p.query_id""")
def _(r):
    p = M.grounding_proxies(_recall(r), _ranked_evidence(r))
    return p.select("query_id", "groundedness", F.coalesce(F.col("missing_info_handled").cast("int"), F.lit(-1)).alias("missing_info_handled"))


@query("quality_gate", """
SELECT 'recall_at_5' AS metric, round(avg(round(recall, 4)), 6) AS actual, 0.65::DOUBLE AS minimum, coalesce(avg(round(recall, 4)) >= 0.65, false) AS passed FROM evr2
UNION ALL SELECT 'source_type_hit_rate', round(avg(sth::INT), 6), 0.9::DOUBLE, coalesce(avg(sth::INT) >= 0.9, false) FROM evr2""")
def _(r):
    return M.quality_gate(M.evidence_summary(_recall(r))).withColumn("actual", F.round("actual", 6))


def _cov(lst):
    return f"CASE WHEN len({lst}) > 0 THEN len(list_filter({lst}, lambda p: contains(an, regexp_replace(lower(p), '\\s+', ' ', 'g')))) / len({lst}) END"


SHARED["aq0"] = f"""
SELECT g.*, c.es, c.ed, c.ec, c.rs, c.rd, c.rc, regexp_replace(trim(lower(answer), {W}), '\\s+', ' ', 'g') AS an, {_SP.format('must_include')} AS mi, {_SP.format('must_not_include')} AS mn, {_SP.format('completeness_points')} AS cp,
  list_distinct(list_filter(regexp_extract_all(lower(reference_answer), '[A-Za-zÀ-ỹ0-9_+-]+'), lambda t: length(t) >= 4 AND NOT list_contains({sql_list(K.QUALITY_STOPWORDS)}, t))) AS rf FROM graded_answers g JOIN cranks c ON g.query_id = c.query_id"""
SHARED["aq1"] = f"""
SELECT *, {_cov('mi')} AS must, coalesce({_cov('mn')} > 0, false) AS bad, {_cov('cp')} AS completeness, CASE WHEN len(rf) > 0 THEN len(list_intersect(rf, regexp_extract_all(an, '[A-Za-zÀ-ỹ0-9_+-]+'))) / len(rf) END AS rec,
  list_avg(list_filter([CASE WHEN es THEN coalesce(1.0 / rs, 0) END, CASE WHEN ed THEN coalesce(1.0 / rd, 0) END, CASE WHEN ec THEN coalesce(1.0 / rc, 0) END], lambda x: x IS NOT NULL)) AS cr,
  stage = 'ok' AND NOT used_fallback AS sok, source_count >= greatest(1, minimum_source_count) AS enough FROM aq0"""
SHARED["aq2"] = """
SELECT *, CASE WHEN len(mi) + len(mn) > 0 OR reference_answer <> '' THEN (CASE WHEN bad THEN 0.0 ELSE coalesce(list_avg(list_filter([must, rec], lambda x: x IS NOT NULL)), 1.0) END) END AS correctness,
  NOT bad AND coalesce(must, 1) = 1 AND coalesce(rec, 1) >= 0.5 AS cpass, coalesce(round(cr, 4), enough::INT) AS support FROM aq1"""
SHARED["aq"] = """
SELECT query_id, correctness, CASE WHEN correctness IS NOT NULL THEN cpass END AS correctness_pass, (sok::INT + enough::INT + support) / 3.0 AS groundedness, sok AND enough AND support >= 0.5 AS groundedness_pass,
  cr AS citation_relevance, cr >= 0.5 AS citation_relevance_pass, completeness, completeness = 1 AS completeness_pass FROM aq2"""
_DIM = ["correctness", "groundedness", "citation_relevance", "completeness"]
SHARED["aqo"] = f"""
SELECT *, list_avg(list_filter([{', '.join(f'round({d}, 4)' for d in _DIM)}], lambda x: x IS NOT NULL)) AS overall, {' AND '.join(f'coalesce({d}_pass, true)' for d in _DIM)} AS overall_pass FROM aq"""


def _graded(r):
    def build():
        sp = lambda c: F.filter(F.split(c, "\\|"), lambda x: x != "").alias(c)
        g = r["graded_answers"]
        rubric = g.select("query_id", sp("must_include"), sp("must_not_include"), sp("completeness_points"), "reference_answer", F.col("minimum_source_count").cast("int").alias("minimum_source_count"))
        cases = _cases(r).join(rubric, "query_id")
        return M.answer_quality(g.select("query_id", "answer", "source_count", "stage", "used_fallback"), cases, _annotated(r))
    return r.shared("graded", build)


@query("answer_quality", "SELECT query_id, " + ", ".join(f"coalesce(round({d}, 6), -1) AS {d}, coalesce({d}_pass::INT, -1) AS {d}_pass" for d in [*_DIM, "overall"]) + " FROM aqo")
def _(r):
    return _graded(r).select("query_id", *[x for d in [*_DIM, "overall"] for x in (
        F.coalesce(F.round(d, 6), F.lit(-1.0)).alias(d), F.coalesce(F.col(f"{d}_pass").cast("int"), F.lit(-1)).alias(f"{d}_pass"))])


@query("answer_quality_summary", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, count({d}) AS cases_evaluated, count(*) FILTER ({d}_pass) AS passes, round(avg(coalesce({d}_pass, false)::INT) FILTER ({d} IS NOT NULL), 6) AS pass_rate, round(avg({d}), 6) AS average_score FROM aqo"
    for d in [*_DIM, "overall"]))
def _(r):
    s = M.answer_quality_summary(_graded(r))
    return s.select("dimension", "cases_evaluated", "passes", F.round("pass_rate", 6).alias("pass_rate"), F.round("average_score", 6).alias("average_score"))
