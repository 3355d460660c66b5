"""Composed jobs: staged document retrieval and two-pass question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import sval
from ..operators import evidence as EV, graph as G, questions as QN, rerank as RR, search as SE
from ..operators.relational import top_k
from ..session import materialise, small_side


def staged_retrieval(queries: DataFrame, hits: DataFrame, docs: DataFrame, k: int = 4,
                     parents: DataFrame | None = None, model=None) -> DataFrame:
    """Candidates, intent filter, re-rank, parent merge, re-rank, optional model, one per origin.

    ``hits`` hold at least ``max(6k, 18)`` ranked candidates (query_id, doc_key, rank).
    """
    wide, deep = max(6 * k, 18), max(3 * k, 8)
    analyzed = materialise(QN.analyze_queries(queries))
    cands = hits.where(F.col("rank") <= wide).select("query_id", "doc_key", F.col("rank").alias("cand_rank")).join(docs, "doc_key")
    cands = materialise(RR.with_doc_fields(RR.intent_prefilter(cands, analyzed, k)))
    first = _or_first(RR.heuristic_rerank(cands, analyzed, deep), cands, deep)
    if parents is not None:
        # the parents of the few candidates are looked up where they are read; the merge then shuffles no other
        near = small_side(first.select(sval("parent_id").alias("_pid")).distinct())
        parents = materialise(parents.withColumn("_pid", sval("parent_id")).join(near, "_pid", "left_semi").drop("_pid"))
        merged = materialise(RR.merge_parents(first, parents, max_results=deep).withColumnRenamed("rank", "cand_rank"))
        first = _or_first(RR.heuristic_rerank(merged, analyzed, max(6, k)), merged, max(6, k))
    if model is not None:
        first = RR.model_rerank(first, queries, 2 * k, model)
    elif parents is None:
        first = RR.heuristic_rerank(first.drop("cand_rank").withColumnRenamed("rank", "cand_rank").select(
            "query_id", "cand_rank", *RR.DOC_FIELDS), analyzed, k)
    return RR.dedupe_by_origin(first, k)


def _or_first(ranked: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """The re-ranked rows, or the first k candidates of queries that lost all rows."""
    cols = ["query_id", "rank", *RR.DOC_FIELDS, "rerank_score"]
    ranked = materialise(ranked.select(*cols))  # read twice here
    left = cands.join(ranked.select("query_id").distinct(), "query_id", "left_anti").withColumn("rerank_score", F.lit(None).cast("double"))
    spare = top_k(left, ["query_id"], [F.col("cand_rank")], k, "rank")
    return materialise(ranked.unionByName(spare.select(*cols)))


def sparse_hits(texts: DataFrame, docs: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 rows, and lexical rows of the questions that BM25 leaves without any; no lexical job where there is none."""
    sparse = materialise(SE.sparse_search(texts, docs, k, allowed=allowed))
    bare = materialise(texts.select("query_id", "query").join(sparse.select("query_id").distinct(), "query_id", "left_anti"))
    if not bare.limit(1).count():
        return sparse
    return sparse.unionByName(SE.lexical_search(bare, docs, k, allowed=allowed))


def hybrid_hits(plan: DataFrame, docs: DataFrame, k: int, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fused top-k documents per planned question, inside each question's own filters.

    The sparse list is that of BM25; a question that finds nothing there takes its lexical list. ``vectors`` are the questions'
    (query_id, embedding) and the documents' (doc_key, embedding); without them the dense list is empty, as it is for a
    question or a document without a vector.
    """
    wide = max(4 * k, 12)
    texts = plan.select("query_id", F.col("search_text").alias("query"))
    hits = sparse_hits(texts, docs, wide, plan)
    if vectors is None:
        return SE.rrf_fuse(hits.where("false"), hits, k)
    held = vectors[1].join(docs.select("doc_key", *SE.FILTER_FIELDS), "doc_key")
    return SE.rrf_fuse(SE.dense_search(vectors[0], held, wide, allowed=plan), hits, k)


def ask_once(plan: DataFrame, queries: DataFrame, docs: DataFrame, context: DataFrame, nodes: DataFrame, as_of, k: int,
             vectors: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    hits = materialise(hybrid_hits(plan, docs, k, vectors))
    fields = [c for c in SE.VALUE_FIELDS if c in docs.columns] + ["doc_id", "path"]
    texts = docs.select("doc_key", "text", EV.metadata_map(fields).alias("metadata"))
    vector = EV.evidence_from_hits(hits.select("query_id", "doc_key", "rank").join(texts, "doc_key"))
    evidence = materialise(EV.merge_evidence(vector, EV.evidence_from_nodes(context, nodes)))
    return {"evidence": evidence, "sufficiency": materialise(EV.evidence_sufficiency(queries, evidence, as_of))}


def ask(queries: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame, as_of, k: int = 5, depth: int = 2,
        base_source_types: list[str] | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Answers for a whole question table; only low-evidence questions get a second pass.

    A second pass replaces the first when its score is at least as high. ``vectors`` (see ``hybrid_hits``) add the dense
    channel; a rewritten question keeps its vector.
    """
    plan = materialise(QN.plan_retrieval(queries, base_source_types))
    matched = materialise(G.search_nodes(nodes, queries, k))
    context = materialise(G.graph_context(nodes, edges, queries, k, depth, matched)["nodes"])
    one = ask_once(plan, queries, docs, context, nodes, as_of, k, vectors)
    weak = one["sufficiency"].where("level = 'low'").select("query_id", "missing_source_types")
    again = materialise(QN.expand_plan(plan.join(weak, "query_id"), protected=()))
    suff = one["sufficiency"].withColumn("attempt", F.lit(1))
    evidence = one["evidence"].withColumn("attempt", F.lit(1))
    attempts = plan.select("query_id", "intent")
    if again.limit(1).count():
        retried = queries.join(again.select("query_id"), "query_id", "left_semi")
        # the second search uses the rewritten text for the graph as well
        reworded = again.select("query_id", F.col("search_text").alias("query"))
        seeds = materialise(G.search_nodes(nodes, reworded, k))
        near = materialise(G.graph_context(nodes, edges, reworded, k, depth, seeds)["nodes"])
        two = ask_once(again, retried, docs, near, nodes, as_of, k, vectors)
        suff = suff.unionByName(two["sufficiency"].withColumn("attempt", F.lit(2)))
        evidence = evidence.unionByName(two["evidence"].withColumn("attempt", F.lit(2)))
    tries = suff.groupBy("query_id").agg(F.max("attempt").alias("attempts"))
    best = top_k(suff, ["query_id"], [F.col("raw_score").desc(), F.col("attempt").desc()], 1, "_n").drop("_n")
    kept = evidence.join(best.select("query_id", "attempt"), ["query_id", "attempt"], "left_semi")
    cites = materialise(EV.citations(queries, kept))
    answers = EV.grounded_answers(queries, cites, best)
    return (answers.join(best.select("query_id", "score", "level"), "query_id").join(tries, "query_id")
            .join(attempts, "query_id"))
