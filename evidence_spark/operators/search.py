"""First-stage retrieval: lexical, sparse and dense top-k, filters and rank fusion.

The lexical and the sparse job share one shape. Documents become postings of the items that some
question has, where they are read. A share of the documents gives every question a score that its
results reach, and items too frequent to reach it by themselves are read only for documents that
come near it by their rarer items. The results are exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.text import first_nonblank, nonblank, sval, tokens, words
from ..session import materialise, small_side
from .relational import substring_pairs, top_k

FILTER_FIELDS = ["source_type", "customer_id", "ticket_id", "service_id", "product_id"]
VALUE_FIELDS = ["entity_id", "source_type", "title", "customer_id", "account_id", "ticket_id",
                "product_id", "service_id", "policy_id", "risk_event_id", "issue_id"]
EVAL_VALUE_FIELDS = ["entity_id", "customer_id", "account_id", "ticket_id", "product_id", "service_id",
                     "policy_id", "risk_event_id", "issue_id", "message_id", "kg_node_id", "title"]


# -- filters ------------------------------------------------------------------------

def normalise_filters(filters: dict | None) -> dict[str, list[str]]:
    out = {}
    for field in FILTER_FIELDS:
        raw = (filters or {}).get(field)
        values = raw if isinstance(raw, (list, tuple, set)) else [] if raw is None else [raw]
        kept = [str(v).strip() for v in values if str(v).strip()]
        if kept:
            out[field] = kept
    return out


def filter_metadata(docs: DataFrame, filters: dict | None = None, source: str | None = None) -> DataFrame:
    """AND over the filter fields, each an IN-list; applied before any ranking."""
    conds = [sval(f).isin(v) for f, v in normalise_filters(filters).items()]
    if source is not None:
        conds.append(F.col("source") == source)
    return docs.where(reduce(lambda a, b: a & b, conds)) if conds else docs


def filter_sources(docs: DataFrame, sources=(), types=(), fallback: bool = False) -> DataFrame:
    def norm(vs):
        return sorted({str(v).strip().lower() for v in vs if str(v).strip()})
    conds = [F.col("source").isin(norm(sources))] if norm(sources) else []
    if fallback and norm(types):
        conds.append(F.col("source_type").isin(norm(types)))
    return docs.where(reduce(lambda a, b: a | b, conds)) if conds else docs


def identity() -> Column:
    """Document key used for ties and fusion."""
    typed = F.when((sval("source_type") != "") & (sval("entity_id") != ""),
                   F.concat_ws(":", sval("source_type"), sval("entity_id")))
    return F.coalesce(typed, F.nullif(first_nonblank("doc_id"), F.lit("")), F.substring("text", 1, 120))


# -- shared scoring job ---------------------------------------------------------------

FIRST_SHARE = 16  # one document in so many is scored first, for the k-th scores
_SLACK = 1e-6  # of a bound, for sums in another order


_MARK = "\x01"  # words have no such character


def postings(docs: DataFrame, found: dict[str, Column], wanted: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Stored postings (doc_key, kind, term, n) of the wanted items, straight from the scan.

    ``found`` has an array of terms for each kind, those of "w" words, a term repeated as often as it counts; ``wanted`` has
    kind and term. The wanted items are matched where a document is read, so that the rest of its tokens goes into no exchange.
    """
    def marked(kind: str, values: Column) -> Column:
        return values if kind == "w" else F.transform(values, lambda v: F.concat(F.lit(kind + _MARK), v))

    names = wanted.select("kind", "term", F.when(F.col("kind") == "w", F.col("term")).otherwise(F.concat_ws(_MARK, "kind", "term")).alias("_i"))
    # the outer form keeps Spark from evaluating the array a second time in a filter
    rows = docs.select("doc_key", *carry, F.explode_outer(F.concat(*[marked(*x) for x in found.items()])).alias("_i")).join(small_side(names), "_i")
    return materialise(rows.select("doc_key", *carry, "kind", "term", F.lit(1.0).alias("n")))


def best_documents(held: DataFrame, items: DataFrame, k: int, order: list[Column], carry: tuple[str, ...] = (),
                   keep=None, first: Column | None = None) -> DataFrame:
    """Exact top-k rows (query_id, doc_key, score, rank) over postings, by upper bounds.

    A score is the sum of ``w * n`` over a question's items and the largest ``bonus``. A share of the documents is scored
    in full, and a question's k-th score there is a bound that no result is below. Its items, the most frequent first, are
    then passed over as long as all of them together stay below the bound: a document with no other item can't be a result.
    Of the rest of the documents only those whose other items reach the bound with what was passed over are completed.
    ``keep`` filters (doc_key, query_id, carry) pairs before ranks are taken; ``first`` tells which documents are the share.
    """
    keep = keep or (lambda pairs: pairs)
    stats = held.groupBy("kind", "term").agg(F.count("*").alias("df"), F.max("n").alias("top"))
    own = W.partitionBy("query_id").orderBy((F.col("df") / (F.col("w") * F.col("top") + F.col("bonus"))).desc(), "kind", "term").rowsBetween(W.unboundedPreceding, 0)
    ranked = materialise(items.join(stats, ["kind", "term"]).withColumn("run", F.sum(F.col("w") * F.col("top")).over(own) + F.max("bonus").over(own)).drop("df", "top"))
    first = F.pmod(F.xxhash64("doc_key"), F.lit(FIRST_SHARE)) == 0 if first is None else first

    def pairs(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        # a document's postings meet in one task, so its sums need no further exchange
        joined = rows.repartition("doc_key").join(small_side(chosen.select("query_id", "kind", "term", "w", "bonus")), ["kind", "term"])
        return keep(joined.groupBy("doc_key", "query_id").agg(
            F.sum(F.col("w") * F.col("n")).alias("_s"), F.max("bonus").alias("_b"), *[F.first(c).alias(c) for c in carry]))

    cols = ["query_id", "doc_key", "score", *carry]
    one = pairs(held.where(first), ranked).withColumn("score", F.col("_s") + F.col("_b")).select(*cols).where("score > 0")
    one = materialise(top_k(one, ["query_id"], order, k).drop("rank"))
    floors = one.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - _SLACK).alias("floor"))
    cut = materialise(ranked.join(floors, "query_id", "left").withColumn("passed", F.coalesce(F.col("run") < F.col("floor"), F.lit(False))))
    over = cut.where("passed")
    bounds = cut.groupBy("query_id").agg(F.first("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("passed"), F.col("run"))), F.lit(0.0)).alias("rest"))
    two = pairs(held.where(~first), cut.where("NOT passed")).join(small_side(bounds), "query_id")
    two = materialise(two.where("floor IS NULL OR _s + _b + rest >= floor").drop("floor", "rest"))
    more = (two.select("query_id", "doc_key").join(over.select("query_id", "kind", "term", "w", "bonus"), "query_id")
            .join(held.select("doc_key", "kind", "term", "n"), ["doc_key", "kind", "term"])
            .groupBy("query_id", "doc_key").agg(F.sum(F.col("w") * F.col("n")).alias("_s2"), F.max("bonus").alias("_b2")))
    zero = F.lit(0.0)
    two = two.join(more, ["query_id", "doc_key"], "left").withColumn(
        "score", F.col("_s") + F.coalesce("_s2", zero) + F.greatest("_b", F.coalesce("_b2", zero)))
    return top_k(one.unionByName(two.select(*cols).where("score > 0")), ["query_id"], order, k)


def first_alike(held: DataFrame, k: int, ties: list[Column], allowed: DataFrame | None = None) -> DataFrame:
    """Stored postings, one for each term, of the documents that can be among the first k of a question.

    Documents with the same postings have the same score for every question, so only the first k of them by ``ties`` can be
    results. The same postings are told by their number and two sums of 48-bit hashes. With ``allowed`` (see
    ``allowed_pairs``) such documents are alike only if the questions' filters can't tell them apart either.
    """
    item = lambda seed: F.shiftrightunsigned(F.xxhash64("kind", "term", "n", F.lit(seed)), 16)
    carried = [c for c in held.columns if c not in ("doc_key", "kind", "term", "n")]
    docs = held.groupBy("doc_key").agg(F.count("*").alias("_n"), F.sum(item(1)).alias("_h1"), F.sum(item(2)).alias("_h2"),
                                       *[F.first(c).alias(c) for c in carried])
    alike = ["_n", "_h1", "_h2"]
    if allowed is not None:
        alike += ["source_type", *[f"_a_{f}" for f in ID_FILTERS]]
        for f in ID_FILTERS:  # an id that no question asks for tells nothing
            asked = allowed.select(F.col(f).alias(f"_a_{f}")).where(F.col(f"_a_{f}").isNotNull()).distinct()
            docs = docs.join(small_side(asked), F.col(f) == F.col(f"_a_{f}"), "left")
    few = top_k(docs, alike, ties, k).select("doc_key")
    kept = held.join(small_side(few), "doc_key", "left_semi")
    return materialise(kept.groupBy("doc_key", *carried, "kind", "term").agg(F.sum("n").alias("n")))


def _query_items(queries: DataFrame, kind: str, values: Column) -> DataFrame:
    return queries.select("query_id", F.lit(kind).alias("kind"), F.explode(values).alias("term"))


def rarest_gram_pairs(vocab: DataFrame, word: str, needles: DataFrame, needle: str, n: int = 4) -> DataFrame:
    """(word, needle) where a needle occurs inside a word of a stored vocabulary of distinct words, for few needles.

    Each needle is filed under its rarest n-gram in the vocabulary (a shorter needle under
    itself). The grams of a word meet those of the needles where the word is read, so that
    no other gram is kept, and the candidates are verified.
    """
    def grams(c, size):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1),
                                            lambda p: F.substr(c, p, size)))

    nd = materialise(needles.select(F.col(needle).alias("_nd")).where(F.length("_nd") > 0).distinct())
    short = nd.where(F.length("_nd") < n)
    sizes = short.agg(F.collect_set(F.length("_nd"))).first()[0]  # fewer than n numbers
    words = vocab.select(F.col(word).alias("_w"))

    def met(wanted: DataFrame, lengths: list[int]) -> DataFrame:
        cut = F.array_distinct(F.flatten(F.array(*[F.when(F.length("_w") >= m, grams(F.col("_w"), F.lit(m))).otherwise(F.array().cast("array<string>")) for m in lengths])))
        return words.select("_w", F.explode(cut).alias("_g")).join(small_side(wanted), "_g")

    long_grams = nd.where(F.length("_nd") >= n).select("_nd", F.explode(grams(F.col("_nd"), F.lit(n))).alias("_g"))
    counts = met(long_grams.select("_g").distinct(), [n]).groupBy("_g").agg(F.count("*").alias("_c"))
    # a gram the vocabulary lacks has no count: such a needle occurs nowhere
    filed = (long_grams.join(counts, "_g", "left").groupBy("_nd")
             .agg(F.min_by("_g", F.struct(F.coalesce("_c", F.lit(0)), "_g")).alias("_g")))
    keyed = filed.unionByName(short.select("_nd", F.col("_nd").alias("_g")))
    return (met(keyed, sorted({*sizes, n})).where(F.col("_w").contains(F.col("_nd")))
            .select(F.col("_w").alias(word), F.col("_nd").alias(needle)).distinct())


# -- lexical ------------------------------------------------------------------------

def metadata_values(fields: list[str], have) -> Column:
    """Non-blank metadata values in lower case; a value stored in two fields counts twice."""
    return F.array_compact(F.array(*[F.lower(nonblank(f)) for f in fields if f in have]))


ID_FILTERS = FILTER_FIELDS[1:]


def allowed_pairs(scored: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep pairs inside each question's own filters.

    ``allowed`` has query_id, source_types (empty means any) and the four id fields (NULL
    means any). Runs before the rank limit, so the top k is taken among allowed documents.
    """
    ids = ID_FILTERS
    rules = small_side(allowed.select("query_id", "source_types", *[F.col(f).alias(f"_f_{f}") for f in ids]))
    ok = (F.size("source_types") == 0) | F.array_contains("source_types", F.col("source_type"))
    for f in ids:
        ok = ok & (F.col(f"_f_{f}").isNull() | (F.col(f"_f_{f}") == F.col(f)))
    return scored.join(rules, "query_id").where(ok).drop("source_types", *[f"_f_{f}" for f in ids])


def lexical_search(queries: DataFrame, docs: DataFrame, k: int, filters: dict | None = None,
                   profile: str = "retrieval", allowed: DataFrame | None = None) -> DataFrame:
    """Token overlap, title and metadata bonuses; highest score first, then identity.

    profile "retrieval": +2 when a query token occurs in the title, ties by doc_key descending.
    profile "eval": ids and all metadata searched, no title bonus, ties by source_type and id
    descending.
    """
    docs = filter_metadata(docs, filters)
    have = set(docs.columns)
    plain = profile == "retrieval"
    # a column of its own, so that a scan trims the fields once
    docs = docs.withColumn("_v", metadata_values(VALUE_FIELDS if plain else EVAL_VALUE_FIELDS, have))
    values = F.col("_v")
    if plain:
        hay = F.concat_ws(" ", F.coalesce("text", F.lit("")), values)
    else:
        searched = [c for c in have if c not in ("text", "doc_key", "_ord")]
        hay = F.concat_ws(" ", F.coalesce("text", F.lit("")), *[F.col(c) for c in searched])
    title_words = F.array_distinct(F.regexp_extract_all(F.lower(sval("title")), F.lit(K.WORD_PATTERN), F.lit(0)))
    # only words of questions count, and those leave out what a profile drops
    found = {"w": F.array_distinct(words(hay, K.WORD_PATTERN if plain else K.EVAL_WORD_PATTERN)), "v": values}
    if plain:
        found["t"] = title_words
    q_items = _query_items(queries, "w", tokens("query", profile))
    held = docs.select(F.explode(values).alias("term"))  # made distinct once most are passed over
    q = queries.select("query_id", F.lower("query").alias("_q"))
    q_items = q_items.unionByName(
        substring_pairs(q, "query_id", "_q", held, "term").select("query_id", F.lit("v").alias("kind"), "term"))
    if plain:
        vocab = docs.select(F.explode(title_words).alias("word")).distinct()
        toks = queries.select("query_id", F.explode(tokens("query", profile)).alias("token"))
        q_items = q_items.unionByName(
            rarest_gram_pairs(materialise(vocab), "word", toks, "token").join(toks, "token")
            .select("query_id", F.lit("t").alias("kind"), F.col("word").alias("term")).distinct())
    items = materialise(q_items.distinct().withColumn("w", F.when(F.col("kind") == "w", 1.0).when(F.col("kind") == "v", 4.0).otherwise(0.0))
                        .withColumn("bonus", F.when(F.col("kind") == "t", 2.0).otherwise(0.0)))
    carry = () if plain else ("source_type", "doc_id")
    if allowed is not None:
        carry = tuple(dict.fromkeys([*carry, *FILTER_FIELDS]))
    ties = [F.col("doc_key").desc()] if plain else [F.col("source_type").desc(), F.col("doc_id").desc()]
    held = first_alike(postings(docs, found, items.select("kind", "term").distinct(), carry), k, ties, allowed)
    keep = (lambda pairs: allowed_pairs(pairs, allowed)) if allowed is not None else None
    return best_documents(held, items, k, [F.col("score").desc(), *ties], carry, keep).select(
        "query_id", "doc_key", F.lit("lexical").alias("channel"), "rank", "score")


def sparse_search(queries: DataFrame, docs: DataFrame, k: int, filters: dict | None = None,
                  idf: bool = True, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 over term postings. ``idf=False`` weights all terms alike.

    ``allowed`` holds each question's own filters (see ``allowed_pairs``); term weights and lengths are those of all ``docs``.
    """
    carry = tuple(FILTER_FIELDS) if allowed is not None else ()
    docs = filter_metadata(docs, filters)
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(K.WORD_PATTERN), F.lit(0)),
                     lambda t: F.length(t) > 2)
    q_terms = materialise(queries.select("query_id", F.lit("w").alias("kind"), F.explode(tokens("query")).alias("term")).distinct())
    wanted = small_side(q_terms.select("term").distinct())
    # one scan: a row for each document's length (no term) and one for each wanted term
    base = docs.select("doc_key", *carry, terms.alias("_t")).withColumn("_len", F.size("_t").cast("double"))
    rows = base.select("doc_key", *carry, "_len", F.explode(F.concat(F.array(F.lit("")), F.coalesce("_t", F.array().cast("array<string>")))).alias("term"))
    found = rows.join(wanted.withColumn("_hit", F.lit(True)), "term", "left").where("_hit OR term = ''")
    # dealt by document: its rows stay side by side in files and exchanges, where its key then takes hardly any room
    counted = materialise(found.repartition("doc_key").groupBy("doc_key", "term").agg(
        F.count("*").cast("double").alias("tf"), F.first("_len").alias("_len"), *[F.first(c).alias(c) for c in carry]))
    stats = counted.where("term = ''").agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("_len").alias("avg")).alias("s")).scalar()
    held = counted.where("term <> ''").select(
        "doc_key", *carry, F.lit("w").alias("kind"), "term",
        (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / stats["avg"]))).alias("n"))
    df = held.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weight = F.log(1.0 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) if idf else F.lit(1.0)
    items = q_terms.join(df, "term").withColumn("_n", stats["n"]).select("query_id", "kind", "term", weight.alias("w"), F.lit(0.0).alias("bonus"))
    order = [F.round("score", 9).desc(), F.col("doc_key").asc()]
    keep = (lambda pairs: allowed_pairs(pairs, allowed)) if allowed is not None else None
    few = first_alike(held, k, [F.col("doc_key").asc()], allowed)
    return best_documents(few, items, k, order, carry, keep).select(
        "query_id", "doc_key", F.lit("sparse").alias("channel"), "rank", "score")


# -- dense --------------------------------------------------------------------------

QUERY_BLOCK = 1024
DOC_BLOCK = 8192


def dense_search(queries: DataFrame, docs: DataFrame, k: int, filters: dict | None = None,
                 query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK, allowed: DataFrame | None = None) -> DataFrame:
    """Exact cosine top-k of every question over all documents.

    ``allowed`` holds each question's own filters (see ``allowed_pairs``); ``docs`` then carries the filter fields, and the
    k rows are taken among a question's own documents. A question without a row there finds nothing.

    Questions and documents are dealt by hash into blocks of about these sizes, and every
    pair of blocks is one matrix product in a task. Nothing passes the driver but two
    counts. A pair gives k rows per question, which Spark's rank limit merges.
    """
    fields = FILTER_FIELDS if allowed is not None else []
    docs = filter_metadata(docs, filters).select("doc_key", *fields, F.col("embedding").alias("_d"))
    asked = queries.select("query_id", F.col("embedding").alias("_v"))
    if allowed is not None:
        asked = materialise(asked.join(allowed.select("query_id", "source_types", *[F.col(f).alias(f"_f_{f}") for f in ID_FILTERS]), "query_id"))
    n_q, n_d = max(1, -(-asked.count() // query_block)), max(1, -(-docs.count() // doc_block))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = right["doc_key"].to_numpy(dtype=object)  # plain objects: Arrow strings in several chunks don't go back
        qi, at, found = np.empty(0, int), np.empty(0, int), np.empty(0)
        if len(left) and len(right):
            q, m = (_unit(np.vstack(x.to_numpy()).astype(float)) for x in (left["_v"], right["_d"]))
            sims = q @ m.T
            mine = _permitted(left, right) if fields else np.ones_like(sims, dtype=bool)
            sims[~mine] = -np.inf
            keep = mine
            if sims.shape[1] > k:
                keep = mine & (sims >= -np.partition(-sims, k - 1, axis=1)[:, k - 1:k])
            qi, at = np.nonzero(keep)
            found = sims[qi, at]
            by_key = np.empty(len(keys), int)
            by_key[np.argsort(keys, kind="stable")] = np.arange(len(keys))
            order = np.lexsort((by_key[at], -found, qi))
            nth = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
            qi, at, found = (x[order[nth < k]] for x in (qi, at, found))
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[qi], "doc_key": pd.Series(keys[at], dtype=object), "score": found})

    types = f"query_id {dict(asked.dtypes)['query_id']}, doc_key {dict(docs.dtypes)['doc_key']}, score double"
    short = dealt(asked, "query_id", "_qb", n_q, "_db", n_d).groupBy("_qb", "_db").cogroup(
        dealt(docs, "doc_key", "_db", n_d, "_qb", n_q).groupBy("_qb", "_db")).applyInPandas(search, types)
    return top_k(short, ["query_id"], [F.col("score").desc(), F.col("doc_key").asc()], k).select(
        "query_id", "doc_key", F.lit("dense").alias("channel"), "rank", "score")


def _permitted(asked: pd.DataFrame, docs: pd.DataFrame) -> np.ndarray:
    """Which documents of a block each question's filters admit; equal filters are tested once."""
    out = np.ones((len(asked), len(docs)), dtype=bool)
    rules = [(tuple(t), *ids) for t, *ids in zip(asked["source_types"], *[asked[f"_f_{f}"] for f in ID_FILTERS])]
    rows: dict[tuple, list[int]] = {}
    for i, rule in enumerate(rules):
        rows.setdefault(tuple(None if v is None or v != v else v for v in rule), []).append(i)
    for (types, *ids), at in rows.items():
        ok = docs["source_type"].isin(types).to_numpy() if types else np.ones(len(docs), dtype=bool)
        for field, value in zip(ID_FILTERS, ids):
            if value is not None:
                ok = ok & (docs[field] == value).to_numpy(dtype=bool, na_value=False)
        out[at] = ok
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


# -- fusion -------------------------------------------------------------------------

def sparse_or_lexical(sparse: DataFrame, lexical: DataFrame) -> DataFrame:
    """Per query the sparse list, or the lexical list when the sparse one is empty."""
    return sparse.unionByName(lexical.join(sparse.select("query_id").distinct(), "query_id", "left_anti"))


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 1.0,
             sparse_weight: float = 1.0, rrf_k: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion of a dense and a sparse-or-lexical list.

    A key repeated inside a channel counts with its later rank; ties keep first-seen
    order, dense before sparse.
    """
    hits = dense.withColumn("_side", F.lit(0)).unionByName(sparse.withColumn("_side", F.lit(1)))

    def last(side, value):
        cond = F.col("_side") == side
        return F.max_by(F.when(cond, F.col(value)), F.when(cond, F.col("rank")))

    fused = hits.groupBy("query_id", "doc_key").agg(
        last(0, "rank").alias("dense_rank"), last(0, "score").alias("dense_score"),
        last(1, "rank").alias("sparse_rank"), last(1, "score").alias("sparse_score"),
        F.min(F.struct("_side", "rank")).alias("_seen"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    score = (F.coalesce(F.lit(dense_weight) / (rrf_k + F.col("dense_rank")), F.lit(0.0))
             + F.coalesce(F.lit(sparse_weight) / (rrf_k + F.col("sparse_rank")), F.lit(0.0)))
    fused = fused.withColumn("fused_score", score)
    return top_k(fused, ["query_id"], [F.col("fused_score").desc(), F.col("_seen").asc()], k).drop("_seen")
