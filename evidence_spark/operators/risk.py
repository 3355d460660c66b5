"""Trailing-window risk features, heuristic scores, explanations and isolation scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import contains_any, one_of, record_text, sval
from ..session import materialise
from .relational import top_k


def instant(c) -> Column:
    """ISO text to a timestamp; blank or bad text gives NULL."""
    return F.try_to_timestamp(F.nullif(sval(c), F.lit("")))


def _low(c) -> Column:
    return F.lower(sval(c))


def ticket_flags(df: DataFrame) -> DataFrame:
    """Adds the activity and escalation predicates every ticket report relies on."""
    escalate = (one_of(_low("sla_status"), K.BAD_SLA) | (_low("status") == "pending_engineering")
                | (_low("priority") == "p1"))
    text = F.col("_text") if "_text" in df.columns else record_text(df.columns)
    return (df.withColumn("is_active", one_of(_low("status"), K.OPEN_STATUSES))
              .withColumn("is_critical", (_low("priority") == "p1") | (_low("severity") == "sev1")
                          | (_low("category") == "incident"))
              .withColumn("is_escalation", escalate)
              .withColumn("is_negative", escalate | contains_any(text, ["frustrated", "urgent"])
                          | one_of(_low("priority"), ["p1", "p2"])))


def risk_flags(df: DataFrame) -> DataFrame:
    severe = one_of(_low("severity"), K.HIGH_SEVERITIES)
    high_score = F.coalesce(F.expr("try_cast(trim(risk_score) as int)"), F.lit(0)) >= K.HIGH_RISK_SCORE
    return (df.withColumn("is_active", ~one_of(_low("status"), K.INACTIVE_RISK_STATUSES))
              .withColumn("is_high", severe | high_score)
              .withColumn("is_escalation", severe | one_of(_low("event_type"), K.ESCALATION_RISK_TYPES))
              .withColumn("is_negative", severe | high_score
                          | one_of(_low("event_type"), K.NEGATIVE_RISK_TYPES)))


def signals(tickets: DataFrame, risks: DataFrame) -> DataFrame:
    """Tickets and risk events as one narrow stream of dated signals per customer."""
    def common(source, entity, ts, title, summary):
        text = F.col("_text")
        return [sval("customer_id").alias("customer_id"), F.lit(source).alias("source_type"),
                sval(entity).alias("entity_id"), sval(title).alias("title"),
                sval(summary).alias("summary"), sval(ts).alias("created_at"),
                instant(ts).alias("at"), F.col("_ord").cast("long").alias("_ord"),
                contains_any(text, K.LOGIN_TERMS).alias("login"),
                contains_any(text, K.API_TERMS).alias("api"),
                contains_any(text, K.REFUND_TERMS).alias("refund")]

    tickets = tickets.withColumn("_text", record_text(tickets.columns))
    risks = risks.withColumn("_text", record_text(risks.columns))
    t = ticket_flags(tickets).select(
        *common("ticket", "ticket_id", "created_at", "title", "description"),
        F.greatest(instant("created_at"), instant("updated_at")).alias("seen_at"),
        F.col("is_critical").alias("critical"), F.col("is_escalation").alias("escalation"),
        F.col("is_negative").alias("negative"))
    r = risk_flags(risks).select(
        *common("risk_event", "risk_event_id", "detected_at", "event_type", "summary"),
        instant("detected_at").alias("seen_at"),
        F.lit(False).alias("critical"), F.col("is_escalation").alias("escalation"),
        F.col("is_negative").alias("negative"))
    return t.unionByName(r)


def anchor_of(tickets: DataFrame, risks: DataFrame, as_of=None) -> Column:
    """Newest timestamp of the dataset as a scalar; ``as_of`` covers an undated dataset."""
    seen = tickets.select(F.greatest(instant("created_at"), instant("updated_at")).alias("t")).unionByName(
        risks.select(instant("detected_at").alias("t")))
    newest = seen.agg(F.max("t").alias("t")).scalar()
    return F.coalesce(newest, F.lit(as_of).cast("timestamp")) if as_of is not None else newest


def recent_signals(tickets: DataFrame, risks: DataFrame, as_of=None) -> DataFrame:
    """Signals of the 30 days up to the anchor, both ends inclusive."""
    return (signals(tickets, risks)
            .withColumn("anchor", anchor_of(tickets, risks, as_of))
            .where(F.col("at").between(F.col("anchor") - F.expr("INTERVAL 30 DAYS"), F.col("anchor")))
            .withColumn("week", F.col("at") >= F.col("anchor") - F.expr("INTERVAL 7 DAYS")))


def feature_aggregates() -> list[Column]:
    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))
    week, ticket = F.col("week"), F.col("source_type") == "ticket"
    conds = [ticket & week, F.col("critical"), F.col("escalation"), F.col("login") & week,
             F.col("api") & week, F.col("refund"), F.col("negative")]
    return [n(c).alias(name) for name, c in zip(K.FEATURES, conds)]


def risk_features(customers: DataFrame, tickets: DataFrame, risks: DataFrame, as_of=None) -> DataFrame:
    """Seven trailing-window counts per customer; quiet customers get zeros."""
    counts = recent_signals(tickets, risks, as_of).groupBy("customer_id").agg(*feature_aggregates())
    return (customers.select(sval("customer_id").alias("customer_id"))
            .join(counts, "customer_id", "left")
            .select("customer_id", *[F.coalesce(F.col(f), F.lit(0)).cast("double").alias(f)
                                     for f in K.FEATURES]))


def contributing_ids(tickets: DataFrame, risks: DataFrame, as_of=None) -> DataFrame:
    """The records behind the 30-day counts, one row each."""
    return recent_signals(tickets, risks, as_of).select("customer_id", "source_type", "entity_id")


def feature_baselines(features: DataFrame) -> DataFrame:
    """Cohort mean and maximum of every feature, one row."""
    aggs = []
    for f in K.FEATURES:
        aggs += [F.coalesce(F.avg(f), F.lit(0.0)).alias(f"{f}_mean"),
                 F.coalesce(F.max(f), F.lit(0.0)).alias(f"{f}_max")]
    return features.agg(*aggs)


def _with_baselines(features: DataFrame, baselines: DataFrame | None) -> DataFrame:
    base = feature_baselines(features) if baselines is None else baselines
    return features.withColumn("_b", base.select(F.struct(*base.columns)).scalar())


def raw_score() -> Column:
    parts = []
    for f, weight in zip(K.FEATURES, K.FEATURE_WEIGHTS):
        mean = F.col(f"_b.{f}_mean")
        top = F.greatest(F.col(f"_b.{f}_max"), F.lit(1.0))
        spread = F.greatest(top - mean, F.lit(1.0))
        bonus = F.when(F.col(f) > mean, (F.col(f) - mean) / spread * K.ANOMALY_BONUS).otherwise(0.0)
        parts.append(F.col(f) / top * weight + bonus)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, parts)))


def risk_level(score: Column) -> Column:
    level = F.lit("low")
    for floor, name in reversed(K.RISK_LEVELS):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def score_risk(features: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Weighted share of the cohort maximum plus an above-average bonus, clamped to 0-100."""
    scored = _with_baselines(features, baselines).withColumn("raw_score", raw_score()).drop("_b")
    return (scored.withColumn("risk_score", F.round("raw_score", 2))
            .withColumn("risk_level", risk_level(F.col("risk_score"))))


def risk_reasons(features: DataFrame, limit: int = 4) -> DataFrame:
    """Strongest features per customer by value x weight; ties keep the feature order."""
    entries = F.array(*[
        F.struct((-F.col(f) * w).alias("rank_key"), F.lit(i).alias("ix"), F.col(f).alias("value"),
                 F.lit(label).alias("label"), F.lit(w).alias("weight"))
        for i, (f, w, label) in enumerate(zip(K.FEATURES, K.FEATURE_WEIGHTS, K.FEATURE_LABELS))])
    best = F.slice(F.array_sort(F.filter(entries, lambda e: e["value"] > 0)), 1, limit)
    texts = F.transform(best, lambda e: F.concat(
        e["label"], F.lit(": "), e["value"].cast("bigint").cast("string"), F.lit(" signal(s), weight "),
        e["weight"].cast("int").cast("string")))
    none = F.array(F.lit("No recent risk feature signals were found for this customer."))
    return (features.select("customer_id", F.posexplode(F.when(F.size(texts) > 0, texts).otherwise(none))
                            .alias("pos", "reason"))
            .select("customer_id", (F.col("pos") + 1).alias("position"), "reason"))


def deviation_reasons(features: DataFrame, baselines: DataFrame | None = None, limit: int = 4) -> DataFrame:
    """Features furthest above the cohort mean, relative first, then absolute, then name."""
    df = _with_baselines(features, baselines)
    entries = F.array(*[
        F.struct(((F.col(f) - F.col(f"_b.{f}_mean")) / F.greatest(F.col(f"_b.{f}_mean"), F.lit(1.0))).alias("relative"),
                 (F.col(f) - F.col(f"_b.{f}_mean")).alias("deviation"), F.lit(f).alias("feature"),
                 F.col(f).alias("value"), F.lit(label).alias("label"),
                 F.col(f"_b.{f}_mean").alias("mean"))
        for f, label in zip(K.FEATURES, K.FEATURE_LABELS)])
    high = F.filter(entries, lambda e: (e["value"] > 0) & (e["deviation"] > 0))
    best = F.slice(F.sort_array(high, asc=False), 1, limit)
    texts = F.transform(best, lambda e: F.concat(
        e["label"], F.lit(" is above cohort baseline: "), e["value"].cast("bigint").cast("string"),
        F.lit(" signal(s) vs "), F.format_string("%.2f", e["mean"]), F.lit(" average")))
    none = F.array(F.lit("No feature materially exceeds the synthetic cohort baseline."))
    return (df.select("customer_id", F.posexplode(F.when(F.size(texts) > 0, texts).otherwise(none))
                      .alias("pos", "reason"))
            .select("customer_id", (F.col("pos") + 1).alias("position"), "reason"))


def related_events(tickets: DataFrame, risks: DataFrame, limit: int = 12, as_of=None) -> DataFrame:
    """Newest contributing records per customer; on equal time tickets come first."""
    rows = recent_signals(tickets, risks, as_of).select(
        "customer_id", "source_type", "entity_id", "title", "summary", "created_at", "_ord")
    order = [F.col("created_at").desc(), F.col("source_type").desc(), F.col("_ord").asc()]
    return top_k(rows, ["customer_id"], order, limit, "position").drop("_ord")


# -- isolation scores ---------------------------------------------------------------

TREE_SCHEMA = "tree int, node int, feature int, cut double, lo int, hi int, size double, depth int"


def _mean_path(n):
    """Average unsuccessful-search depth of a tree over n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + 0.5772156649015329) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow_tree(tree: int, points: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one isolation tree over a sample of at most a few hundred points."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes, todo = [], [(0, points, 0)]
    next_id = 1
    while todo:
        node, pts, depth = todo.pop()
        spans = pts.max(axis=0) - pts.min(axis=0) if len(pts) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spans > 0)
        if depth >= limit or len(pts) <= 1 or len(usable) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, float(len(pts)), depth))
            continue
        feature = int(rng.choice(usable))
        low, high = pts[:, feature].min(), pts[:, feature].max()
        cut = float(rng.uniform(low, high))
        left = pts[:, feature] < cut
        nodes.append((tree, node, feature, cut, next_id, next_id + 1, float(len(pts)), depth))
        todo += [(next_id, pts[left], depth + 1), (next_id + 1, pts[~left], depth + 1)]
        next_id += 2
    return nodes


def _path_lengths(forest: dict[int, pd.DataFrame], points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points))
    for t in forest.values():
        at = np.zeros(len(points), dtype=int)
        feature, cut = t["feature"].to_numpy(), t["cut"].to_numpy()
        lo, hi = t["lo"].to_numpy(), t["hi"].to_numpy()
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            here = at[rows]
            goes_low = points[rows, feature[here]] < cut[here]
            at[rows] = np.where(goes_low, lo[here], hi[here])
        total += t["depth"].to_numpy()[at] + _mean_path(t["size"].to_numpy()[at])
    return total / len(forest)


def grow_forest(features: DataFrame, n_trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Trees as rows. Each tree sees the ``sample`` rows with its smallest hashes.

    A hash threshold thins the rows first, so the exact top-``sample`` selection per tree
    only handles a small multiple of the sample, whatever the cohort size.
    """
    n = features.agg(F.count("*").alias("n")).scalar()
    space = 2 ** 40
    share = F.least(F.lit(1.0), F.lit(8.0 * sample) / F.greatest(n, F.lit(1)))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))

    def draw(t):
        return F.pmod(F.xxhash64(F.col("customer_id"), t, F.lit(seed)), F.lit(space))

    drawn = (features.withColumn("_share", share)
             .withColumn("tree", F.explode(F.filter(trees, lambda t: draw(t) < F.col("_share") * space)))
             .withColumn("_draw", draw(F.col("tree"))))
    picked = top_k(drawn, ["tree"], [F.col("_draw"), F.col("customer_id")], sample, "_r")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values("customer_id")[K.FEATURES].to_numpy(dtype=float)
        rows = _grow_tree(int(key[0]), points, seed)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREE_SCHEMA.split(", ")])

    return picked.select("tree", "customer_id", *K.FEATURES).groupBy("tree").applyInPandas(fit, TREE_SCHEMA)


def isolation_risk(features: DataFrame, n_trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Outlier score per customer, min-max scaled to 0-100 (50 when the cohort is flat).

    The forest has at most ``n_trees * (2 * sample)`` nodes whatever the data size, so it
    is the one thing brought to the driver and broadcast; the customers never are.
    Fewer than two customers fall back to the heuristic score; ``model`` names the score
    that was used. The features are stored once, since several steps read them.
    """
    spark = features.sparkSession
    features = materialise(features)
    if features.limit(2).count() < 2:
        return score_risk(features).select("customer_id", "risk_score", "risk_level", F.lit("heuristic").alias("model"))
    nodes = grow_forest(features, n_trees, sample, seed).toPandas()
    forest = spark.sparkContext.broadcast(
        {int(t): g.sort_values("node").reset_index(drop=True) for t, g in nodes.groupby("tree")})
    sizes = nodes.loc[nodes["node"] == 0, "size"]
    scale = float(_mean_path([max(sizes.max(), 2.0)])[0])

    def score(batches):
        for pdf in batches:
            depth = _path_lengths(forest.value, pdf[K.FEATURES].to_numpy(dtype=float))
            yield pd.DataFrame({"customer_id": pdf["customer_id"], "oddness": 2.0 ** (-depth / scale)})

    raw = features.select("customer_id", *K.FEATURES).mapInPandas(score, "customer_id string, oddness double")
    ends = raw.agg(F.struct(F.min("oddness").alias("lo"), F.max("oddness").alias("hi")).alias("e")).scalar()
    scaled = raw.withColumn("_e", ends).withColumn(
        "raw", F.when(F.col("_e.hi") > F.col("_e.lo"),
                      (F.col("oddness") - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo")) * 100.0)
        .otherwise(50.0))
    return scaled.select("customer_id", F.round("raw", 2).alias("risk_score"),
                         risk_level(F.col("raw")).alias("risk_level"), F.lit("isolation_forest").alias("model"))
