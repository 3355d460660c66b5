"""Embedding near-duplicates by sorted projection passes.

Every pass orders the vectors of a label lexicographically by concatenated random hashes (signs of projections around
the label's centre) and compares each vector with a bounded window of its neighbours in that order. Pairs verified by
cosine are united across passes. Inside the resulting components every pair is then verified once, in blocks, so link
counts don't depend on the window.

A vector with more partners than windows hold (the hub of a star) is then placed again, at the codes of random vectors
as near to it as a link reaches, the more often the more partners it has found. Each place meets a window of its own, so
what a hub finds grows by a factor from round to round. Rounds end when one adds no link between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import components, store
from .pivot_topk import usable

PASSES = 16
WINDOW = 48
BITS = 62
CENTRE_SAMPLE = 2048  # vectors a label's centre is averaged over (smallest hashes of their ids)
BLOCK = 1024  # members of a component that meet in one task
BUCKET_ROWS = 8192  # members of small components handled together
PLACES = 1024  # further places of a hub that are made in one row


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of tiny and huge components finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Joins left and right in the parent array (smaller position becomes the root)."""
    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in zip(left.tolist(), right.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return parent


def window_links(x: np.ndarray, group: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, i + d), 1 <= d <= window, of one group with cosine at least ``least``."""
    left, right = [], []
    for d in range(1, min(window, len(x) - 1) + 1):
        hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-d], x[d:]) >= least) & (group[:-d] == group[d:]))
        left.append(hit)
        right.append(hit + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def around(x: np.ndarray, n: int, least: float, rng: np.random.Generator) -> np.ndarray:
    """n random unit vectors whose cosine with the unit vector x is ``least``."""
    side = rng.standard_normal((n, len(x)))
    side -= np.outer(side @ x, x)
    side /= np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), np.finfo(float).tiny)
    return least * x + np.sqrt(1 - least * least) * side


def linked_classes(classes: DataFrame, least: float, passes: int, window: int, hubs: DataFrame | None = None, turn: int = 0) -> DataFrame:
    """Spanning links (a, b) that the passes find between class representatives of equal label and length.

    ``hubs`` (label, vec, rep, places) are among the classes and get further places in the order. ``turn`` changes the hashes.
    """
    spark = classes.sparkSession
    dims = [r[0] for r in classes.select(F.size("vec")).distinct().collect()]
    rng = np.random.default_rng([20240607, turn])
    planes = {d: rng.standard_normal((d, passes * BITS)) for d in sorted(dims)}
    by_hash = Window.partitionBy("label", F.size("vec")).orderBy(F.xxhash64("rep"))
    sample = classes.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= CENTRE_SAMPLE)
    n = spark.sparkContext.defaultParallelism
    centres = sample.groupBy("label", F.size("vec").alias("dim")).applyInPandas(
        lambda pdf: pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": [len(pdf["vec"].iloc[0])], "centre": [unit(pdf["vec"]).mean(axis=0)]}),
        f"label {dict(classes.dtypes)['label']}, dim int, centre array<double>")

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

        def coded(x: np.ndarray, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(part):
                bits = (x - np.stack(part["centre"].to_numpy())) @ planes[x.shape[1]] > 0
                keys = (bits.reshape(len(x), passes, BITS) * weights).sum(axis=2)
                for p in range(passes):
                    yield pd.DataFrame({"pass": p, "label": part["label"], "dim": x.shape[1], "code": keys[:, p], "rep": part["rep"], "vec": part["vec"]})

        for pdf in batches:
            for _, part in pdf.groupby(pdf["vec"].map(len)):
                x = unit(part["vec"])
                plain = part["places"].to_numpy() == 0
                yield from coded(x[plain], part[plain])
                for i in np.flatnonzero(~plain).tolist():
                    row = part.iloc[[i]]
                    seed = [turn, int(row["rep"].iloc[0]) % (1 << 63), int(row["block"].iloc[0])]
                    near = around(x[i], int(row["places"].iloc[0]), least, np.random.default_rng(seed))
                    yield from coded(near, row.loc[row.index.repeat(len(near))])

    kind = dict(classes.dtypes)
    shape = f"pass int, label {kind['label']}, dim int, code long, rep long, vec {kind['vec']}"
    rows = classes.select("label", "vec", "rep", F.lit(0).alias("places"), F.lit(0).alias("block"))
    if hubs is not None:  # a hub's places are dealt out over tasks
        blocks = hubs.select("label", "vec", "rep", "places", F.explode(F.sequence(F.lit(0), F.floor((F.col("places") - 1) / PLACES).cast("int"))).alias("block"))
        left = F.least(F.lit(PLACES), F.col("places") - F.col("block") * PLACES).cast("int")
        rows = rows.unionByName(blocks.select("label", "vec", "rep", left.alias("places"), "block").repartition(n, "rep", "block"))
    placed = rows.withColumn("dim", F.size("vec")).join(centres, ["label", "dim"]).mapInPandas(codes, shape)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, first = TaskContext.get().partitionId(), None, True
        head = None
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if head is None or len(head) < window:
                head = pdf.head(window) if head is None else pd.concat([head, pdf]).head(window)
            yield links(rows)
            held = rows.tail(window)
        if head is not None:
            for side, border, keep in (("head", part - 1, head), ("tail", part, held)):
                yield keep.assign(kind=side, border=border, ord=np.arange(len(keep)), a=keep["rep"], b=keep["rep"])[OUT]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, own in rows.groupby("dim"):
            _, group = np.unique(own["pass"].to_numpy().astype(str) + "|" + own["label"].to_numpy().astype(str), return_inverse=True)
            left, right = window_links(unit(own["vec"]), group, window, least)
            parent = forest(len(own), left, right, np.arange(len(own)))
            child = np.flatnonzero(parent != np.arange(len(own)))
            ids = own["rep"].to_numpy()
            edges.append(pd.DataFrame({"a": ids[child], "b": ids[parent[child]]}))
        out = pd.concat(edges)
        return out.assign(kind="link", border=0, ord=0, **{"pass": 0, "label": None, "dim": 0, "vec": None})[OUT]

    OUT = ["kind", "border", "ord", "a", "b", "pass", "label", "dim", "vec"]
    out_shape = f"kind string, border int, ord int, a long, b long, pass int, label {kind['label']}, dim int, vec {kind['vec']}"
    ordered = placed.repartitionByRange(max(n, 2), "pass", "label", "dim", "code", "rep").sortWithinPartitions("pass", "label", "dim", "code", "rep")
    passed = store(ordered.mapInPandas(compare, out_shape))

    def seam(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["kind", "ord"], ascending=[False, True])  # the tail of one partition, then the head of the next
        return links(rows.assign(rep=rows["a"]))[["a", "b"]]

    seams = passed.where("kind != 'link'").groupBy("border").applyInPandas(seam, "a long, b long")
    return passed.where("kind = 'link'").select("a", "b").unionByName(seams).distinct()


def link_counts(members: DataFrame, least: float) -> DataFrame:
    """(rep, linked, degree): the sum of ``m`` over all classes of the same component that rep links with, and their number."""
    kind = dict(members.dtypes)["m"]
    sizes = store(members.groupBy("component").agg(F.count("*").alias("g")))
    total = members.count()
    spot = F.pmod(F.xxhash64("rep"), F.ceil(F.col("g") / BLOCK)).cast("int")
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // BUCKET_ROWS)))).cast("long")
    known = members.join(sizes, "component")
    small = known.where(F.col("g") <= BLOCK).select(bucket.alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("own"), "component", "rep", "m", "vec")
    large = known.where(F.col("g") > BLOCK).withColumn("own", spot).withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("g") / BLOCK).cast("int") - 1)))
    large = large.select(F.col("component").alias("k"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "rep", "m", "vec")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, across = [], key[1] != key[2]
        pdf = pdf.sort_values("component", kind="stable")
        for _, part in pdf.groupby("component", sort=False):
            x, m = unit(part["vec"]), part["m"].to_numpy()
            if across:  # two blocks of one component: only pairs between them
                own = part["own"].to_numpy()
                a, b = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
                hit = (x[a] @ x[b].T) >= least
                sums, degree = np.zeros(len(x), m.dtype), np.zeros(len(x), np.int64)
                sums[a], sums[b] = hit @ m[b], hit.T @ m[a]
                degree[a], degree[b] = hit.sum(axis=1), hit.sum(axis=0)
            else:
                hit = (x @ x.T) >= least
                np.fill_diagonal(hit, False)
                sums, degree = hit @ m, hit.sum(axis=1)
            out.append(pd.DataFrame({"rep": part["rep"].to_numpy(), "linked": sums, "degree": degree}))
        return pd.concat(out)

    both = small.unionByName(large)
    found = both.groupBy("k", "i", "j").applyInPandas(count, f"rep long, linked {kind}, degree long")
    return found.groupBy("rep").agg(F.sum("linked").alias("linked"), F.sum("degree").alias("degree"))


def crowded(members: DataFrame, counts: DataFrame, least: float, window: int) -> DataFrame:
    """(label, vec, rep, component, places) of members that may have more partners than their windows showed.

    A partner counts as one over the number of its own partners, so the shares of all members add up to their number:
    the centre of a star has a large share, the members of a group that all link with each other have one of about 1.
    """
    weighed = members.join(counts.where("degree > 0").select("rep", (1 / F.col("degree")).alias("w")), "rep")
    shares = link_counts(weighed.select("rep", "component", F.col("w").alias("m"), "vec"), least)
    share = F.floor(2 * F.col("linked") / window).cast("int")
    return members.join(shares.select("rep", share.alias("places")), "rep").where("places > 0").select("label", "vec", "rep", "component", "places")


def vector_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                      passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Only vectors of equal, non-null label and equal length are compared. Vectors that are null, empty or all zero, or
    hold null or non-finite components, link with nothing: n_links 0 and a component of their own. Equal vectors are
    compared once, as a class with a multiplicity. Repeated ids stay separate rows that share the values of their id.
    An empty table gives no rows. No two vectors below ``least`` are linked; pairs in different components can be
    missed only if no pass brings them, or a further place of one of them, within the window.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # cosines are double in any case
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vec"), F.col(label_col).alias("label"))
    sound = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    fine = rows.where(sound)
    classes = store(fine.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    links = store(linked_classes(classes, least, passes, window))
    turn = 0
    while True:
        turn += 1
        labels = store(components(links))
        members = store(classes.join(labels.withColumnRenamed("node", "rep"), "rep"))
        counts = store(link_counts(members.select("rep", "component", "m", "vec"), least))
        hubs = store(crowded(members, counts, least, window))
        if hubs.isEmpty():
            break
        # hubs meet everything of their labels that is in no component of a hub
        here = classes.join(hubs.select("label").distinct(), "label", "left_semi")
        inside = members.join(hubs.select("component").distinct(), "component", "left_semi").select("rep")
        others = here.join(inside, "rep", "left_anti").select("label", "vec", "rep")
        fresh = linked_classes(store(others.unionByName(hubs.select("label", "vec", "rep"))), least, passes, window, hubs, turn)
        home = labels.groupBy("node").agg(F.min("component").alias("component"))
        fresh = fresh.join(home.toDF("a", "ca"), "a", "left").join(home.toDF("b", "cb"), "b", "left")
        fresh = store(fresh.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
        if fresh.isEmpty():
            break
        links = store(links.unionByName(fresh))
    known = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    known = store(known.select("label", "vec", F.coalesce("component", "rep").alias("component_id"),
                               (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    good = fine.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
