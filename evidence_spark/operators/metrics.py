"""Retrieval and answer quality metrics over all evaluation cases at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.text import squeeze, sval, tokens
from .relational import top_k

LABELS = ["expected_sources", "expected_documents", "expected_categories"]
DIMENSIONS = ["correctness", "groundedness", "citation_relevance", "completeness"]


def _low(values) -> Column:
    return F.filter(F.transform(values, lambda x: squeeze(x)), lambda x: x != "")


def _two_way(expected: str, fields: list[str], have) -> Column:
    """Any expected label inside any field, or any field inside a label."""
    candidates = _low(F.array(*[sval(f) for f in fields if f in have]))
    return F.exists(_low(F.col(expected)), lambda e: F.exists(candidates, lambda c: c.contains(e) | e.contains(c)))


def annotate_relevance(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Source, document and category matches and the combined relevance of each result."""
    df = results.join(cases.select("query_id", *LABELS), "query_id")
    have = set(df.columns)
    kinds = _low(F.array(*[sval(f) for f in ["source", "source_type"] if f in have]))
    df = (df.withColumn("match_source", F.arrays_overlap(_low(F.col("expected_sources")), kinds))
          .withColumn("match_document", _two_way("expected_documents", ["doc_id", "origin_doc_id", "title", "path", "url"], have))
          .withColumn("match_category", _two_way("expected_categories", ["category", "source_type", "title", "path"], have)))
    points = [F.when(F.coalesce(F.col(f"match_{n}"), F.lit(False)), p).otherwise(0) for n, p in K.RELEVANCE_POINTS.items()]
    return df.withColumn("relevance", reduce(lambda a, b: a + b, points))


def ndcg(annotated: DataFrame, k: int) -> DataFrame:
    """Per case; the ideal order re-sorts the retrieved rows only."""
    top = annotated.where(F.col("rank") <= k)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    both = top.withColumn("_best", best).groupBy("query_id").agg(
        F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(gain / F.log2(F.col("_best") + 1.0)).alias("idcg"))
    return both.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def case_ranks(annotated: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """First matching rank per case and aspect, with which aspects are labelled."""
    def first(cond):
        return F.min(F.when(cond & (F.col("rank") <= k), F.col("rank")))
    ranks = annotated.groupBy("query_id").agg(
        first(F.col("relevance") > 0).alias("rank_overall"), first(F.col("match_source")).alias("rank_source"),
        first(F.col("match_document")).alias("rank_document"), first(F.col("match_category")).alias("rank_category"),
        F.count("*").alias("result_count"))
    sized = {n: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
             for n, c in zip(["source", "document", "category"], LABELS)}
    df = cases.select("query_id", *[sized[n].alias(f"eval_{n}") for n in sized])
    df = df.withColumn("eval_overall", F.col("eval_source") | F.col("eval_document") | F.col("eval_category"))
    return df.join(ranks, "query_id", "left").join(ndcg(annotated, k), "query_id", "left").withColumn(
        "result_count", F.coalesce("result_count", F.lit(0)))


def rank_metrics(annotated: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """hit@k, MRR and nDCG by aspect over labelled cases."""
    aspects = ["overall", "source", "document", "category"]
    long = case_ranks(annotated, cases, k).select("query_id", "ndcg", F.explode(F.array(*[
        F.struct(F.lit(a).alias("aspect"), F.col(f"eval_{a}").alias("labelled"), F.col(f"rank_{a}").alias("first_rank"))
        for a in aspects])).alias("_a")).select("ndcg", "_a.*")
    on = F.col("labelled")
    hit = on & F.col("first_rank").isNotNull()
    n = F.sum(F.when(on, 1).otherwise(0))
    return long.groupBy("aspect").agg(
        n.alias("queries_evaluated"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"),
        F.avg(F.when(on, F.when(hit, 1.0).otherwise(0.0))).alias("hit_at_k"),
        F.avg(F.when(on, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))).alias("mrr"),
        F.avg(F.when(on & (F.col("aspect") == "overall"), F.coalesce("ndcg", F.lit(0.0)))).alias("ndcg_at_k"))


def intent_accuracy(cases: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Share of labelled cases whose expected intents were all predicted."""
    df = cases.join(analyzed.select("query_id", "intent_labels"), "query_id")
    expected = _low(F.col("expected_answer_intents"))
    hit = F.size(F.array_except(expected, "intent_labels")) == 0
    df = df.where(F.size(expected) > 0)
    return df.agg(F.count("*").alias("queries_evaluated"), F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).alias("hits"),
                  F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("accuracy"))


def benchmark_summary(annotated: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Label coverage, result counts and node/source counts as (section, name, value) rows."""
    ranks = case_ranks(annotated, cases, k)
    def n(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("double")
    one = ranks.agg(
        F.count("*").cast("double").alias("query_count"), F.sum("result_count").cast("double").alias("total_results"),
        F.avg("result_count").alias("average_results_per_query"),
        *[n(F.col(f"eval_{a}")).alias(f"{a}_labeled_queries") for a in ["overall", "source", "document", "category"]])
    cols = one.columns
    totals = one.select(F.explode(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in cols])).alias("_r")).select("_r.*")
    parts = [totals]
    for section, c in [("node_type_counts", "node_type"), ("source_counts", "source")]:
        if c in annotated.columns:
            parts.append(annotated.where(sval(c) != "").groupBy(sval(c).alias("name")).agg(
                F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value"))
    return reduce(DataFrame.unionByName, parts)


def labelled_misses(annotated: DataFrame, cases: DataFrame, k: int, limit: int = 10) -> DataFrame:
    """First labelled cases without a hit, with their top result."""
    miss = case_ranks(annotated, cases, k).where("eval_overall AND rank_overall IS NULL").select("query_id")
    head = annotated.where("rank = 1").select("query_id", sval("title").alias("top_result_title"), sval("source").alias("top_result_source"))
    df = miss.join(cases.select("query_id", "query"), "query_id").join(head, "query_id", "left")
    return df.fillna("").orderBy("query_id").limit(limit)


# -- evidence recall ------------------------------------------------------------------

def id_aliases(value: Column) -> Column:
    v = sval(value)
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(
        v, F.substring_index(v, "::", -1), F.substring_index(v, ":", -1))))


def evidence_recall(cases: DataFrame, evidence: DataFrame, k: int = 5, id_fields=("entity_id",)) -> DataFrame:
    """recall@k on entity ids, source-type hits and groundedness per case.

    Evidence rows have query_id, pos, id, source_type, metadata map; only k rows per case
    are looked at, so the per-case sets are small.
    """
    top = evidence.where(F.col("pos") <= k)
    fields = ["id", "entity_id", "customer_id", "account_id", "ticket_id", "product_id", "service_id", "policy_id",
              "risk_event_id", "issue_id", "message_id", "kg_node_id"]
    linked = F.filter(F.transform(F.split(F.coalesce(F.col("metadata")["linked_ticket_ids"], F.lit("")), "\\|"),
                                  lambda x: F.trim(x)), lambda x: x != "")
    aliases = F.array_distinct(F.transform(F.concat(id_aliases(F.col("id")), linked, *[
        id_aliases(F.col("metadata")[f]) for f in fields]), lambda x: F.lower(x)))
    types = F.array_distinct(F.filter(F.array(F.lower(sval("source_type")), F.lower(sval(F.col("metadata")["source_type"]))), lambda x: x != ""))
    per = top.select("query_id", aliases.alias("_al"), types.alias("_ty")).groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list("_al"))).alias("_al"),
        F.array_distinct(F.flatten(F.collect_list("_ty"))).alias("_ty"),
        F.max((F.size("_al") > 0) & (F.size("_ty") > 0)).alias("_cited"), F.count("*").alias("_n"))
    df = cases.join(per, "query_id", "left")
    none = F.array().cast("array<string>")
    want_ids, want_types = F.array_distinct(_low(F.col("expected_entity_ids"))), F.array_distinct(_low(F.col("expected_source_types")))
    df = df.withColumn("_al", F.coalesce("_al", none)).withColumn("_ty", F.coalesce("_ty", none))
    df = df.withColumn("entity_hits", F.array_sort(F.array_intersect(want_ids, "_al"))).withColumn(
        "source_type_hits", F.array_sort(F.array_intersect(want_types, "_ty")))
    has_ids, has_types = F.size(want_ids) > 0, F.size(want_types) > 0
    hit = F.when(has_types, F.size("source_type_hits") > 0)
    grounded = F.when(~F.coalesce("_cited", F.lit(False)), False).when(has_ids, F.size("entity_hits") > 0).when(
        hit.isNotNull(), hit).otherwise(F.coalesce("_n", F.lit(0)) > 0)
    return (df.withColumn("recall", F.when(has_ids, F.size("entity_hits") / F.size(want_ids)))
            .withColumn("source_type_hit", hit)
            .withColumn("source_type_all_hit", F.when(has_types, F.size(F.array_except(want_types, "_ty")) == 0))
            .withColumn("groundedness", grounded).drop("_al", "_ty", "_cited", "_n"))


# fixed values: topics a question may ask for that no document supports
UNSUPPORTED = [(["phone"], ["private phone", "phone number", "mobile number"]),
               (["discount", "approval chain"], ["discount approval", "approval chain", "discount percentage"])]


def grounding_proxies(recall: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Groundedness, plus the missing-information check on flagged cases (NULL elsewhere)."""
    q = F.lower("query")
    asked = [reduce(lambda a, b: a | b, [q.contains(t) for t in trig]) for trig, _ in UNSUPPORTED]
    hay = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")), F.to_json("metadata")))
    told = [reduce(lambda a, b: a | b, [hay.contains(t) for t in terms]) for _, terms in UNSUPPORTED]
    flags = evidence.where(F.col("pos") <= k).groupBy("query_id").agg(
        F.count("*").alias("_n"), *[F.max(t).alias(f"_t{i}") for i, t in enumerate(told)])
    df = recall.join(flags, "query_id", "left")
    false_support = reduce(lambda a, b: a | b, [a & F.coalesce(f"_t{i}", F.lit(False)) for i, a in enumerate(asked)])
    relevant = (F.size("entity_hits") > 0) | (F.size("source_type_hits") > 0) | F.col("_n").isNull()
    return df.select("query_id", "groundedness", F.when(F.coalesce("missing_info", F.lit(False)), relevant & ~false_support).alias("missing_info_handled"))


def evidence_summary(recall: DataFrame, proxies: DataFrame | None = None) -> DataFrame:
    """Averages over the cases that have a value, one row."""
    def rate(c):
        return F.avg(F.when(F.col(c).isNotNull(), F.when(F.col(c), 1.0).otherwise(0.0)))
    df = recall
    aggs = [F.count("*").alias("query_count"), F.avg(F.round("recall", 4)).alias("recall_at_5"),
            rate("source_type_hit").alias("source_type_hit_rate"), rate("source_type_all_hit").alias("source_type_all_hit_rate"),
            rate("groundedness").alias("groundedness_rate")]
    if proxies is not None:
        df = df.join(proxies.select("query_id", "missing_info_handled"), "query_id", "left")
        aggs += [rate("missing_info_handled").alias("missing_info_handling_rate"), F.count("missing_info_handled").alias("missing_info_cases")]
    return df.agg(*aggs)


def weak_cases(recall: DataFrame, limit: int = 10) -> DataFrame:
    bad = (F.coalesce("recall", F.lit(0.0)) < 0.4) | ~F.coalesce("source_type_hit", F.lit(True)) | ~F.col("groundedness")
    return recall.where(bad).orderBy("query_id").limit(limit)


def quality_gate(summary: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One pass/fail row per threshold on a one-row summary; a missing metric fails."""
    limits = {"recall_at_5": K.GATE_MIN_RECALL, "source_type_hit_rate": K.GATE_MIN_SOURCE_HIT} if thresholds is None else thresholds
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual"), F.lit(float(v)).alias("minimum"))
                     for m, v in limits.items()])
    return summary.select(F.explode(rows).alias("_r")).select(
        "_r.*", F.coalesce(F.col("_r.actual") >= F.col("_r.minimum"), F.lit(False)).alias("passed"))


# -- answer quality -------------------------------------------------------------------

def _coverage(text: Column, phrases: str) -> Column:
    """Share of phrases found in a text; NULL without phrases."""
    ps = F.coalesce(F.col(phrases), F.array().cast("array<string>"))
    found = F.filter(ps, lambda p: (squeeze(p) != "") & text.contains(squeeze(p)))
    return F.when(F.size(ps) > 0, F.size(found) / F.size(ps))


def answer_quality(answers: DataFrame, cases: DataFrame, annotated: DataFrame) -> DataFrame:
    """Four scored dimensions per answer, their mean and whether all evaluated ones pass.

    answers: query_id, answer, source_count, stage, used_fallback.
    """
    ranks = annotated.groupBy("query_id").agg(*[
        F.min(F.when(F.col(f"match_{a}"), F.col("rank"))).alias(f"_r_{a}") for a in ["source", "document", "category"]])
    df = cases.join(answers, "query_id").join(ranks, "query_id", "left")
    text = squeeze("answer")
    empty = F.array().cast("array<string>")
    listed = lambda c: F.size(F.coalesce(F.col(c), empty)) > 0
    must = _coverage(text, "must_include")
    forbidden = F.coalesce(_coverage(text, "must_not_include") > 0, F.lit(False))
    ref = F.array_distinct(F.filter(tokens("reference_answer", "analyser"), lambda t: (F.length(t) >= 4) & ~t.isin(K.QUALITY_STOPWORDS)))
    recall = F.when(F.size(ref) > 0, F.size(F.array_intersect(ref, tokens("answer", "analyser"))) / F.size(ref))
    parts = F.array_compact(F.array(must, recall))
    base = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(1.0)
    rated = listed("must_include") | listed("must_not_include") | (sval("reference_answer") != "")
    df = df.withColumn("correctness", F.when(rated, F.when(forbidden, 0.0).otherwise(base)))
    df = df.withColumn("correctness_pass", F.when(rated, ~forbidden & (F.coalesce(must, F.lit(1.0)) == 1.0)
                                                  & (F.coalesce(recall, F.lit(1.0)) >= 0.5)))
    df = df.withColumn("completeness", _coverage(text, "completeness_points"))
    df = df.withColumn("completeness_pass", F.col("completeness") == 1.0)
    pieces = F.array_compact(F.array(*[F.when(listed(c), F.coalesce(1.0 / F.col(f"_r_{a}"), F.lit(0.0)))
                                       for a, c in zip(["source", "document", "category"], LABELS)]))
    df = df.withColumn("citation_relevance", F.when(F.size(pieces) > 0, F.aggregate(pieces, F.lit(0.0), lambda a, x: a + x) / F.size(pieces)))
    df = df.withColumn("citation_relevance_pass", F.col("citation_relevance") >= 0.5)
    stage_ok = (sval("stage") == "ok") & ~F.coalesce("used_fallback", F.lit(False))
    enough = F.col("source_count") >= F.greatest(F.lit(1), F.coalesce("minimum_source_count", F.lit(0)))
    # the rounded score decides support, as it does for the published dimension
    support = F.coalesce(F.round("citation_relevance", 4), F.when(enough, 1.0).otherwise(0.0))
    df = df.withColumn("groundedness", (F.when(stage_ok, 1.0).otherwise(0.0) + F.when(enough, 1.0).otherwise(0.0) + support) / 3.0)
    df = df.withColumn("groundedness_pass", stage_ok & enough & (support >= 0.5))
    scores = F.array_compact(F.array(*[F.round(F.col(d), 4) for d in DIMENSIONS]))
    passes = F.array_compact(F.array(*[F.col(f"{d}_pass") for d in DIMENSIONS]))
    return df.select("query_id", *[F.col(c) for d in DIMENSIONS for c in (d, f"{d}_pass")],
                     (F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).alias("overall"),
                     F.forall(passes, lambda p: p).alias("overall_pass"))


def answer_quality_summary(scored: DataFrame) -> DataFrame:
    """Cases, passes, pass rate and mean score per dimension and overall."""
    long = scored.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score"), F.col(f"{d}_pass").alias("passed"))
        for d in [*DIMENSIONS, "overall"]])).alias("_r")).select("_r.*").where("score IS NOT NULL")
    return long.groupBy("dimension").agg(
        F.count("*").alias("cases_evaluated"), F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("passes"),
        F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"), F.avg("score").alias("average_score"))


def answer_failures(scored: DataFrame) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(F.col(f"{d}_pass") == F.lit(False), d) for d in DIMENSIONS]))
    return scored.where(~F.col("overall_pass")).select("query_id", F.col("overall").alias("overall_score"), failed.alias("failed_dimensions"))
