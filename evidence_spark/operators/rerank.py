"""Second-stage retrieval over candidate lists: scoring, merging, de-duplication, guards."""

from __future__ import annotations

from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.text import contains_any, first_nonblank, squeeze, sval
from .questions import analyze_queries, term_variants
from .relational import top_k

ANALYSIS = ["platform_keywords", "strong_keywords", "weak_keywords", "intent_labels", "preferred_sources",
            "penalized_sources", "phrase_keywords"]
DOC_FIELDS = ["doc_id", "title", "source", "source_type", "path", "url", "text", "node_type", "chunk_id",
              "leaf_id", "parent_id", "pack_id", "origin_doc_id"]


def with_doc_fields(df: DataFrame) -> DataFrame:
    """Candidate rows always have every document field, absent ones blank."""
    for f in DOC_FIELDS:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(""))
    return df


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _keyword_points(kind: str, keywords: str) -> Column:
    """Array of points, one per keyword, from the first place it is found in."""
    title, doc_id, content = K.RERANK_POINTS[kind]

    def points(kw):
        forms = term_variants(kw)
        return (F.when(F.exists(forms, lambda v: F.col("_title_blob").contains(v)), title)
                .when(F.exists(forms, lambda v: F.col("_id").contains(v)), doc_id)
                .when(F.exists(forms, lambda v: F.col("_head").contains(v)), content).otherwise(0.0))

    return F.transform(keywords, points)


def score_candidates(cands: DataFrame, analyzed: DataFrame) -> DataFrame:
    """rerank_score and hit counts for every (query, candidate) row; no shuffle beyond the
    join on the query key."""
    df = with_doc_fields(cands).join(analyzed.select("query_id", *ANALYSIS), "query_id")
    df = (df.withColumn("_t", squeeze("title")).withColumn("_id", squeeze("doc_id"))
          .withColumn("_src", squeeze("source")).withColumn("_path", squeeze("path"))
          .withColumn("_head", squeeze(F.substring("text", 1, 1800)))
          .withColumn("_title_blob", F.concat_ws(" ", "_t", "_src", "_path", squeeze("url"))))
    for kind in K.RERANK_POINTS:
        df = df.withColumn(f"_{kind}", _keyword_points(kind, f"{kind}_keywords"))
        df = df.withColumn(f"{kind}_hits", F.size(F.filter(f"_{kind}", lambda p: p > 0)))
    blob = F.concat_ws(" ", "_t", "_id", "_src", "_path", squeeze("url"), F.substring("_head", 1, 500))
    opposite = reduce(lambda a, b: a | b, [
        ~F.array_contains("platform_keywords", p) & blob.contains(p) for p in K.PLATFORMS])
    has_platform = F.size("platform_keywords") > 0
    df = df.withColumn("opposite_platform_hit", has_platform & opposite)
    source, kind, node = F.lower(sval("source")), F.lower(sval("source_type")), F.lower(sval("node_type"))
    auth = F.array_contains("intent_labels", "github_authentication")

    def phrase_points(p):
        p = squeeze(p)
        return (F.when(p == "", 0.0).when(F.col("_t").contains(p), 6.0)
                .when(F.col("_id").contains(p) | F.col("_path").contains(p), 4.0)
                .when(F.col("_head").contains(p), 2.0).otherwise(0.0))

    def if_(cond, points):
        return F.when(cond, float(points)).otherwise(0.0)

    score = reduce(lambda a, b: a + b, [
        _sum(F.col("_platform")), if_(has_platform & (F.col("platform_hits") == 0), -4),
        if_(F.col("opposite_platform_hit"), -4), _sum(F.col("_strong")), _sum(F.col("_weak")),
        if_(F.array_contains("preferred_sources", source), 4), if_(F.array_contains("penalized_sources", source), -4.5),
        _sum(F.transform("phrase_keywords", phrase_points)),
        if_(auth & (source == "github_docs"), 3), if_(auth & (source == "gitlab_handbook"), -5),
        if_(auth & contains_any("_t", ["passkey", "authentication", "sign in", "login"]), 4),
        if_(source.isin("github_docs", "gitlab_handbook"), 0.5),
        if_(kind.isin("issue", "ticket") | (source == "github_issues"), -0.5),
        if_(node == "parent", 0.4), if_(node == "parent_pack", 0.8),
        if_((F.size("strong_keywords") > 0) & (F.col("strong_hits") == 0), -3),
        if_((F.col("strong_hits") == 0) & contains_any("_t", ["about", "overview", "getting started"]), -1)])
    df = df.withColumn("rerank_score", score)
    return df.drop("_t", "_id", "_src", "_path", "_head", "_title_blob", "_platform", "_strong", "_weak")


def doc_identity() -> Column:
    node = F.lower(sval("node_type"))
    head = F.substring("text", 1, 80)
    return (F.when(node == "leaf", first_nonblank("leaf_id", "chunk_id", "doc_id", "path", head))
            .when(node == "parent", first_nonblank("parent_id", "doc_id", "path", head))
            .when(node == "parent_pack", first_nonblank("pack_id", "origin_doc_id", "doc_id", head))
            .otherwise(first_nonblank("chunk_id", "doc_id", "title", "url", "path", head)))


def heuristic_rerank(cands: DataFrame, analyzed: DataFrame, k: int) -> DataFrame:
    """Best row per identity, ordered by score and hits, behind three gates and a relative cut.

    Candidate lists are short (a few dozen rows per query), so the windows are per query.
    """
    scored = score_candidates(cands, analyzed).withColumn("_ident", doc_identity())
    per_doc = W.partitionBy("query_id", "_ident")
    scored = (scored.withColumn("_first", F.min("cand_rank").over(per_doc))
              .withColumn("_n", F.row_number().over(per_doc.orderBy(F.col("rerank_score").desc(), "cand_rank")))
              .where("_n = 1"))
    order = [F.col("rerank_score").desc(), F.col("platform_hits").desc(), F.col("strong_hits").desc(),
             F.length("text").desc(), F.col("_first")]
    w = W.partitionBy("query_id").orderBy(*order)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = (scored.withColumn("_pos", F.row_number().over(w))
          .withColumn("_best", F.first("rerank_score").over(every))
          .withColumn("_bp", F.first("platform_hits").over(every))
          .withColumn("_bo", F.first("opposite_platform_hit").over(every)))
    blocked = ((F.size("platform_keywords") > 0) & (F.col("_bp") == 0) & (F.col("_best") < 1.5)) \
        | (F.col("_bo") & (F.col("_best") < 2.0)) | (F.col("_best") < 0.8)
    keep = (F.col("rerank_score") >= F.greatest(F.col("_best") * 0.45, F.lit(0.8))) & ~(
        F.col("opposite_platform_hit") & (F.col("rerank_score") < 2.5))
    df = df.where(~blocked).withColumn("_keep", keep).withColumn(
        "_any", F.max("_keep").over(W.partitionBy("query_id"))).where(F.col("_keep") | ~F.col("_any"))
    return top_k(df, ["query_id"], [F.col("_pos")], k, "rank").drop(
        "_ident", "_first", "_n", "_pos", "_best", "_bp", "_bo", "_keep", "_any", *ANALYSIS)


def intent_prefilter(cands: DataFrame, analyzed: DataFrame, k: int) -> DataFrame:
    """Authentication questions keep only authentication pages when enough of them exist."""
    df = with_doc_fields(cands).join(
        analyzed.select("query_id", F.array_contains("intent_labels", "github_authentication").alias("_auth")), "query_id")
    title, path, head = F.lower("title"), F.lower("path"), F.lower(F.substring("text", 1, 1200))
    hit = (contains_any(title, ["passkey", "authentication", "sign in", "login"])
           | contains_any(path, ["passkey", "authentication"]) | contains_any(head, ["passkey", "authentication"]))
    df = df.withColumn("_hit", F.coalesce(hit & (F.lower(sval("source")) == "github_docs"), F.lit(False)))
    n = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(W.partitionBy("query_id"))
    return df.withColumn("_n", n).where(~F.col("_auth") | F.col("_hit") | (F.col("_n") < max(k, 4))).drop("_auth", "_hit", "_n")


def merge_parents(hits: DataFrame, parents: DataFrame, min_children: int = 2, min_siblings: int = 2,
                  max_results: int | None = None) -> DataFrame:
    """Replace sibling leaves by their parent, or sibling parents by a pack of three."""
    hits = with_doc_fields(hits)
    p = parents.where(sval("parent_id") != "").select(
        sval("parent_id").alias("_pid"), F.col("text").alias("_ptext"), F.coalesce(F.col("parent_index").cast("int"), F.lit(0)).alias("_px"),
        sval("doc_id").alias("_pdoc"), sval("title").alias("_ptitle"), sval("source").alias("_psource"),
        sval("source_type").alias("_ptype"), sval("path").alias("_ppath"), sval("url").alias("_purl"),
        sval("origin_doc_id").alias("_porigin"))
    df = hits.withColumn("_pid", sval("parent_id")).join(p, "_pid", "left").withColumn("_known", F.col("_px").isNotNull())
    known = df.where("_known").withColumn("_origin", sval("origin_doc_id"))
    by_parent = known.groupBy("query_id", "_pid").agg(F.count("*").alias("_n"), F.min("rank").alias("_rank"),
                                                      F.first("_origin").alias("_origin"), *[F.first(c).alias(c) for c in p.columns if c != "_pid"])
    merged = by_parent.where(F.col("_n") >= min_children)
    left = by_parent.where((F.col("_n") < min_children) & (F.col("_origin") != ""))
    seen = F.array_sort(F.collect_list(F.struct(F.col("_rank"), F.col("_pid"), F.col("_px"), F.col("_ptext"))))
    packs = left.groupBy("query_id", "_origin").agg(
        seen.alias("_ps"), F.sum("_n").alias("_leaves"), F.min("_rank").alias("_rank"),
        *[F.min_by(c, F.struct("_px", "_rank")).alias(c) for c in ["_ptitle", "_psource", "_ptype", "_ppath", "_purl"]]
    ).where(F.size("_ps") >= min_siblings)
    chosen = F.array_sort(F.transform(F.slice("_ps", 1, 3), lambda x: F.struct(
        x["_px"].alias("px"), x["_rank"].alias("r"), x["_pid"].alias("pid"), F.trim(x["_ptext"]).alias("t"))))
    packs = packs.withColumn("_c", F.filter(chosen, lambda x: x["t"] != ""))
    pids = F.array_join(F.transform("_c", lambda x: x["pid"]), "||")
    pack_id = F.concat(F.lit("pack_"), F.substring(F.md5(F.concat(F.col("_origin"), F.lit("::"), pids)), 1, 16))

    consumed = merged.select("query_id", "_pid").unionByName(
        packs.select("query_id", F.explode(F.transform("_ps", lambda x: x["_pid"])).alias("_pid")))
    rest = df.join(consumed, ["query_id", "_pid"], "left_anti")

    def shaped(frame, node, values):
        cols = {**{f: F.lit("") for f in DOC_FIELDS}, **values}
        return frame.select("query_id", F.col("_rank").alias("rank"), *[cols[f].alias(f) for f in DOC_FIELDS if f != "node_type"],
                            F.lit(node).alias("node_type"))

    as_parent = shaped(merged, "parent", dict(
        doc_id=F.col("_pdoc"), title=F.col("_ptitle"), source=F.col("_psource"), source_type=F.col("_ptype"),
        path=F.col("_ppath"), url=F.col("_purl"), text=F.col("_ptext"), parent_id=F.col("_pid"), origin_doc_id=F.col("_porigin")))
    as_pack = shaped(packs, "parent_pack", dict(
        doc_id=F.concat(F.col("_origin"), F.lit("::pack")), title=F.col("_ptitle"), source=F.col("_psource"),
        source_type=F.col("_ptype"), path=F.col("_ppath"), url=F.col("_purl"),
        text=F.trim(F.array_join(F.transform("_c", lambda x: x["t"]), "\n\n---\n\n")), pack_id=pack_id,
        parent_id=F.coalesce(F.get("_c", F.lit(0))["pid"], F.lit("")), origin_doc_id=F.col("_origin")))
    out = rest.select("query_id", "rank", *DOC_FIELDS).unionByName(as_parent).unionByName(as_pack)
    if max_results is None:
        return out
    return top_k(out, ["query_id"], [F.col("rank"), F.col("doc_id")], max_results, "_m").drop("_m")


def origin_key() -> Column:
    return first_nonblank("origin_doc_id", "doc_id", "path", "url")


def dedupe_by_origin(hits: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """One row per origin: the biggest node type, then the better rank. Rows without any
    origin are kept once each and come first."""
    df = with_doc_fields(hits).withColumn("_o", origin_key())
    node = F.lower(sval("node_type"))
    size = F.when(node == "parent_pack", 3).when(node == "parent", 2).when(node == "leaf", 1).otherwise(0)
    w = W.partitionBy("query_id", "_o").orderBy(size.desc(), F.col(rank))
    df = df.withColumn("_n", F.row_number().over(w)).where((F.col("_o") == "") | (F.col("_n") == 1))
    order = [F.when(F.col("_o") == "", 0).otherwise(1), F.col(rank)]
    return top_k(df, ["query_id"], order, k, "final_rank").drop("_o", "_n")


def model_rerank(hits: DataFrame, queries: DataFrame, k: int,
                 score: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Order by a supplied batch model; without one the first k rows pass through."""
    if score is None:
        return top_k(hits, ["query_id"], [F.col("rank")], k, "_m").drop("_m")

    @F.pandas_udf("double")
    def predict(question: pd.Series, text: pd.Series) -> pd.Series:
        return score(question, text).astype(float)

    df = hits.drop("query").join(queries.select("query_id", "query"), "query_id").withColumn("ce_score", predict("query", "text"))
    second = F.coalesce(F.col("rerank_score"), F.lit(0.0)) if "rerank_score" in df.columns else F.lit(0.0)
    return top_k(df, ["query_id"], [F.col("ce_score").desc(), second.desc(), F.col("rank")], k, "_m").drop(
        "query", "rank").withColumnRenamed("_m", "rank")


def merge_sources(results: list[DataFrame]) -> DataFrame:
    """Union of per-domain results, best score first, distinct on five fields, re-indexed."""
    parts = [with_doc_fields(r).select("query_id", F.lit(i).alias("_src"), "rank", *DOC_FIELDS, "rerank_score")
             for i, r in enumerate(results)]
    df = reduce(DataFrame.unionByName, parts)
    key = ["doc_id", "path", "url", "title", "source"]
    for c in key:
        df = df.withColumn(c, F.coalesce(c, F.lit("")))
    score = F.coalesce(F.col("rerank_score"), F.lit(float("-inf")))
    order = [score.desc(), F.col("_src"), F.col("rank")]
    df = df.withColumn("_n", F.row_number().over(W.partitionBy("query_id", *key).orderBy(*order))).where("_n = 1")
    return df.withColumn("index", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).drop("_n", "_src", "rank")


# fixed values: guardrail reasons
GUARD_REASONS = {
    "none": "Retriever không tìm được tài liệu liên quan.",
    "one_unscored": "Chỉ có 1 tài liệu và chưa có tín hiệu score đủ rõ, nên ưu tiên hiển thị source trước.",
    "one_low": "Chỉ có 1 tài liệu và độ khớp còn thấp, chưa đủ chắc để trả lời tổng hợp.",
    "one_middle": "Chỉ có 1 tài liệu ở mức khớp trung bình, nên ưu tiên show nguồn trước khi trả lời mạnh tay.",
    "top_low": "Tài liệu top đầu có score quá thấp.",
    "few": "Số tài liệu tốt quá ít so với top_k yêu cầu, nên ưu tiên show sources.",
    "both_weak": "Top 2 tài liệu đều chưa đủ mạnh, nên ưu tiên show sources để tránh hallucination.",
    "close": "Các tài liệu top đầu đang khá sít nhau và chưa đủ mạnh, nên chưa nên kết luận chắc chắn.",
    "ok": "Retriever cho tín hiệu đủ ổn để trả lời tổng hợp.",
}


def guardrail_decisions(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """allow / search / clarify per query from the number of hits and the first two scores."""
    scored = F.col("rerank_score").isNotNull()
    place = F.sum(F.when(scored, 1).otherwise(0)).over(
        W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    m = hits.withColumn("_p", F.when(scored, place)).groupBy("query_id").agg(
        F.count("*").alias("retrieved_docs"), F.count("rerank_score").alias("scored_docs"),
        F.max(F.when(F.col("_p") == 1, F.col("rerank_score"))).alias("top1_score"),
        F.max(F.when(F.col("_p") == 2, F.col("rerank_score"))).alias("top2_score"))
    df = queries.select("query_id").join(m, "query_id", "left")
    df = df.withColumn("retrieved_docs", F.coalesce("retrieved_docs", F.lit(0))).withColumn(
        "scored_docs", F.coalesce("scored_docs", F.lit(0)))
    n, t1, t2 = F.col("retrieved_docs"), F.col("top1_score"), F.col("top2_score")
    df = df.withColumn("score_gap", t1 - t2)
    case = (F.when(n == 0, "none").when((n == 1) & t1.isNull(), "one_unscored").when((n == 1) & (t1 < 4.0), "one_low")
            .when((n == 1) & (t1 < 7.0), "one_middle").when(t1 < 2.5, "top_low")
            .when(F.lit(k >= 3) & (n < 2), "few").when((t1 < 5.0) & (t2 < 4.0), "both_weak")
            .when((F.col("score_gap") < 0.35) & (t1 < 6.0), "close").otherwise("ok"))
    df = df.withColumn("_case", case)
    action = (F.when(F.col("_case").isin("none", "one_low", "top_low"), "fallback_to_clarify")
              .when(F.col("_case") == "ok", "allow_answer").otherwise("fallback_to_search"))
    reason = F.create_map(*[x for kv in GUARD_REASONS.items() for x in map(F.lit, kv)])[F.col("_case")]
    return df.withColumn("action", action).withColumn("reason", reason).drop("_case")


def analyse_and_rerank(queries: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    return heuristic_rerank(cands, analyze_queries(queries), k)
