"""Steps whose cost must not grow with rows that are alike."""

from pyspark.sql import functions as F

from evidence_spark.operators import chunking as C, graph as G, relational as R, search as SE
from evidence_spark.plans import asking, bindings, retrieval_queries as RQ

FIELDS = ["source_type", "customer_id", "ticket_id", "service_id", "product_id"]


def _tickets(spark, n=300):
    text = F.concat(F.lit("Login loop, status "), F.when(F.col("id") % 3 == 0, "open").otherwise("closed"), F.lit(", number "), F.col("id").cast("string"))
    return spark.range(n).select(
        F.format_string("t%04d", "id").alias("doc_key"), F.concat(F.lit("id"), F.col("id").cast("string")).alias("doc_id"), text.alias("text"),
        F.lit("Login").alias("title"), F.lit("ticket").alias("source_type"), F.concat(F.lit("tkt_"), F.col("id").cast("string")).alias("ticket_id"),
        F.concat(F.lit("cust_"), (F.col("id") % 50).cast("string")).alias("customer_id"), F.lit("").alias("service_id"), F.lit("").alias("product_id"))


def _seen(monkeypatch):
    counts, real = [], SE.best_documents
    monkeypatch.setattr(SE, "best_documents", lambda held, *a, **b: (counts.append(held.select("doc_key").distinct().count()), real(held, *a, **b))[1])
    return counts


def test_documents_alike_are_scored_k_times(spark, monkeypatch):
    counts = _seen(monkeypatch)
    q = spark.createDataFrame([(1, "Why is the login status open?"), (2, "closed login of tkt_7 twice tkt_7")], "query_id long, query string")
    got = {(r.query_id, r.rank): (r.doc_key, r.score) for r in SE.lexical_search(q, _tickets(spark), 2).collect()}
    assert got == {(1, 1): ("t0297", 9.0), (1, 2): ("t0294", 9.0), (2, 1): ("t0007", 13.0), (2, 2): ("t0299", 8.0)}
    assert counts[0] <= 10
    bm = [(r.query_id, r.rank, r.doc_key) for r in SE.sparse_search(q, _tickets(spark), 2).orderBy("query_id", "rank").collect()]
    assert bm == [(1, 1, "t0000"), (1, 2, "t0003"), (2, 1, "t0001"), (2, 2, "t0002")]
    assert counts[1] <= 10


def test_documents_alike_but_for_a_filter_all_count(spark, monkeypatch):
    counts = _seen(monkeypatch)
    q = spark.createDataFrame([(1, "login status"), (2, "login status")], "query_id long, query string")
    allowed = spark.createDataFrame([(1, ["ticket"], "cust_4", None, None, None), (2, [], None, "tkt_5", None, None)],
                                    "query_id long, source_types array<string>, customer_id string, ticket_id string, service_id string, product_id string")
    got = {(r.query_id, r.rank): r.doc_key for r in SE.lexical_search(q, _tickets(spark), 2, allowed=allowed).collect()}
    assert got == {(1, 1): "t0254", (1, 2): "t0204", (2, 1): "t0005"}
    assert counts[0] <= 12


def test_a_value_held_twice_counts_twice(spark):
    q = spark.createDataFrame([(1, "about xy_1")], "query_id long, query string")
    docs = spark.createDataFrame([("a", "xy_1", "xy_1"), ("b", "xy_1", "")], "doc_key string, customer_id string, ticket_id string").withColumn("text", F.lit(""))
    assert {r.doc_key: r.score for r in SE.lexical_search(q, docs.withColumn("title", F.lit("")), 5).collect()} == {"a": 9.0, "b": 5.0}


def test_needles_no_text_has_are_passed_over_where_they_are_read(spark):
    texts = spark.createDataFrame([(1, "what about cust_17 and the gateway timeout today"), (2, "no")], "id long, _text string")
    needles = spark.range(2000).select(F.concat(F.lit("cust_"), F.col("id").cast("string")).alias("_needle")).unionByName(
        spark.createDataFrame([("gateway timeout",), ("gateway timeout tomorrow",), ("no",)], "_needle string"))
    left = {r[0] for r in R._within(needles, texts, 4).collect()}
    assert {"cust_1", "cust_17", "gateway timeout", "no"} <= left and len(left) < 20
    pairs = {tuple(r) for r in R.substring_pairs(texts, "id", "_text", needles, "_needle").collect()}
    assert pairs == {(1, "cust_1"), (1, "cust_17"), (1, "gateway timeout"), (2, "no")}


def test_no_gram_of_a_word_is_stored(spark, monkeypatch):
    stored, real = [], SE.materialise
    monkeypatch.setattr(SE, "materialise", lambda df: (stored.append(df.columns), real(df))[1])
    words = spark.createDataFrame([("overtime",), ("times",), ("ab",), ("b",)], "w string")
    needles = spark.createDataFrame([("time",), ("b",), ("zzzz",)], "t string")
    assert {tuple(r) for r in SE.rarest_gram_pairs(words, "w", needles, "t").collect()} == {("overtime", "time"), ("times", "time"), ("ab", "b"), ("b", "b")}
    assert not [c for c in stored if "_g" in c]


def test_fusion_makes_no_lexical_job_where_bm25_finds_rows():
    assert RQ.sparse_hits is asking.sparse_hits


def test_nodes_with_the_same_tokens_are_scored_k_times(spark, monkeypatch):
    counts, real = [], G.best_documents
    monkeypatch.setattr(G, "best_documents", lambda held, *a, **b: (counts.append(held.select("doc_key").distinct().count()), real(held, *a, **b))[1])
    nodes = spark.range(200).select(
        F.format_string("n%03d", "id").alias("node_id"), F.lit("T").alias("node_type"), F.when(F.col("id") == 150, "login loop").otherwise("x").alias("label"),
        F.when(F.col("id") == 150, "a login loop").otherwise("loop of login").alias("text"), F.create_map(F.lit("k"), F.lit("v")).alias("properties"))
    q = spark.createDataFrame([(1, "login loop"), (2, "loop of")], "query_id long, query string")
    got = {(r.query_id, r.rank): (r.node_id, r.score) for r in G.search_nodes(nodes, q, 2).collect()}
    assert got == {(1, 1): ("n150", 11), (1, 2): ("n000", 2), (2, 1): ("n000", 7), (2, 2): ("n001", 7)}
    assert counts[0] <= 4


def test_expansion_from_tables_stores_no_edges(spark, monkeypatch):
    """The edges of the tables met hop by hop; unknown seeds and unknown ends lead nowhere, repeated rows count once."""
    tickets = spark.createDataFrame(
        [(1, "tkt_1", "cust_1", "prod_1", "svc_1", "SLA breach", "Team A"), (2, "tkt_1", "cust_2", "prod_9", "svc_1", "Later", "Team  A"), (3, "tkt_2", "cust_1", "", "svc_9", "Other", "")],
        "_ord long, ticket_id string, customer_id string, product_id string, service_id string, title string, assigned_team string").selectExpr(
        "*", "'' AS description", "'' AS category", "'' AS priority", "'' AS severity", "'' AS status", "'' AS sla_status", "'sla' AS tags", "'' AS channel")
    tables = {
        "tickets": tickets,
        "customers": spark.createDataFrame([(1, "cust_1", "acct_1", "Ann"), (2, "cust_2", "acct_x", "Bob")], "_ord long, customer_id string, account_id string, full_name string"),
        "products": spark.createDataFrame([(1, "prod_1", "One", "Team A", "Team A")], "_ord long, product_id string, product_name string, support_owner_team string, engineering_owner_team string"),
        "knowledge_base_docs": spark.createDataFrame([(1, "pol_sla", "Guide", "P", "prod_1", "svc_1")], "_ord long, policy_id string, title string, owner_team string, product_id string, service_id string"),
        "ticket_resolutions": spark.createDataFrame([(1, "res_1", "tkt_1", "pol_sla", "gh_1"), (2, "res_2", "tkt_8", "pol_sla", "gh_2")], "_ord long, resolution_id string, ticket_id string, linked_policy_id string, linked_issue_id string")
        .selectExpr("*", "'' AS summary", "'' AS resolved_at", "'' AS resolution_type"),
        "github_issues": spark.createDataFrame([(1, "gh_1", "Issue", "tkt_1|tkt_7", "Team A")], "_ord long, issue_id string, title string, linked_ticket_ids string, assignee_team string")}
    seeds = spark.createDataFrame([(1, "Customer:cust_1"), (1, "Ticket:tkt_1"), (2, "Ticket:tkt_8"), (3, "Team:Team_A"), (4, "Policy:pol_sla"), (5, "Account:acct_x")], "query_id long, node_id string")
    edges = G.build_edges(tables).localCheckpoint()
    stored, real = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df: (stored.append(df.columns), real(df))[1])
    rows = [tuple(r) for r in G.table_neighbors(tables, seeds, 3).select("query_id", "node_id", "hop").collect()]
    assert stored and not [c for c in stored if "dst" in c]
    reach = {tuple(r) for r in G.neighbors(edges, seeds, 3).select("query_id", "node_id", "hop").collect()}
    assert len(rows) == len(reach) and set(rows) == reach and {r[0] for r in reach} == {1, 3, 4}


def test_short_texts_are_chunked_where_they_are_read(spark, monkeypatch):
    """Only sources of several units are numbered by windows; long texts, repeated and missing ones are chunked whole."""
    seen, real = [], C.ordinal
    monkeypatch.setattr(C, "ordinal", lambda df, *a: (seen.append(sorted({r.doc_id for r in df.select("doc_id").collect()})), real(df, *a))[1])
    note = "A note about the login loop, with enough words in it to be kept as a chunk, number "
    rows = [(f"d{i}", "other", note + str(i)) for i in range(50)] + [("long", "other", note * 400), ("none", "other", None), ("same", "a", note), ("same", "b", note + "two"), ("md", "github_docs", f"# A\n{note}\n# B\n{note}")]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string").selectExpr("*", "'text' AS source_type", "'' AS title", "'' AS path")
    got = {}
    for r in C.chunk_corpus(docs).orderBy("chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.start_index, r.text))
    assert seen == [["md", "same"]]
    assert all(got[f"d{i}"] == [(0, 0, note + str(i))] for i in range(50)) and "none" not in got
    whole = note * 400
    assert [c[0] for c in got["long"]] == list(range(len(got["long"]))) and len(got["long"]) > 100
    assert all(whole[at:at + len(text)] == text for _, at, text in got["long"]) and got["long"][-1][1] + len(got["long"][-1][2]) >= len(whole) - 80
    assert [c[0] for c in got["same"]] == [0, 1] and [c[0] for c in got["md"]] == [0, 1]


def test_only_parents_of_candidates_reach_the_merge(spark, monkeypatch):
    seen, real = [], asking.RR.merge_parents
    monkeypatch.setattr(asking.RR, "merge_parents", lambda hits, parents, **a: (seen.append(parents.count()), real(hits, parents, **a))[1])
    text = "How the login loop is left, "
    parents = spark.range(500).selectExpr("concat('p', id) AS parent_id", "id AS parent_index", f"concat('{text}', id) AS text", "concat('d', id) AS doc_id", "'' AS title", "'' AS source",
                                          "'' AS source_type", "'' AS path", "'' AS url", "concat('o', id) AS origin_doc_id")
    leaves = parents.selectExpr("concat('l', parent_index) AS doc_key", "doc_id", "text", "'leaf' AS node_type", "concat('l', parent_index) AS leaf_id", "parent_id", "origin_doc_id")
    ask = spark.createDataFrame([(1, "login loop")], "query_id long, query string")
    hits = spark.createDataFrame([(1, f"l{i}", i + 1) for i in range(6)], "query_id long, doc_key string, rank int")
    out = asking.staged_retrieval(ask, hits, leaves, 2, parents).collect()
    assert len(out) == 2 and 0 < seen[0] <= 6


def test_needles_are_read_in_one_scan_and_may_repeat(spark):
    texts = spark.createDataFrame([(1, "all about xy and the gateway timeout")], "id long, _text string")
    needles = spark.range(60).select(F.element_at(F.array(*map(F.lit, ["xy", "gateway", "no", "gateway timeout today"])), (F.col("id") % 4 + 1).cast("int")).alias("_needle"))
    left = R._within(needles, texts, 4)
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert sorted(r[0] for r in left.collect()) == ["gateway", "no", "xy"]  # short ones are told by the join
    assert {tuple(r) for r in R.substring_pairs(texts, "id", "_text", needles, "_needle").collect()} == {(1, "xy"), (1, "gateway")}


def test_the_corpus_is_dealt_by_its_narrow_tables(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(bindings, "materialise", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    r = bindings.Roles(spark, "/root/testdata/sf0.001")
    assert RQ._corpus(r).count() == r["corpus"].count()
    dealt = [line.split("RepartitionByExpression")[1] for line in plans[0].splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and sorted(d.split("#")[0].strip(" [") for d in dealt) == ["doc_id", "o_orderkey"]
