from pyspark.sql import functions as F

from evidence_spark import constants as K
from evidence_spark.operators import evidence as EV, metrics as M, risk as RK, support as S

TICKET = ["ticket_id", "customer_id", "product_id", "service_id", "title", "description", "category", "priority", "severity", "status", "sla_status", "created_at", "updated_at", "tags"]


def _tickets(spark, rows):
    return spark.createDataFrame([(i, *[r.get(c, "") for c in TICKET]) for i, r in enumerate(rows)], "_ord long, " + ", ".join(f"{c} string" for c in TICKET))


def _risks(spark, rows):
    cols = ["risk_event_id", "customer_id", "event_type", "severity", "risk_score", "detected_at", "summary", "status"]
    return spark.createDataFrame([(i, *[r.get(c, "") for c in cols]) for i, r in enumerate(rows)], "_ord long, " + ", ".join(f"{c} string" for c in cols))


def test_windows_are_inclusive_and_future_free(spark):
    t = _tickets(spark, [dict(ticket_id="t1", customer_id="c1", created_at="2024-02-01T00:00:00Z", updated_at="2024-03-02T00:00:00Z", priority="p1"),
                         dict(ticket_id="t2", customer_id="c1", created_at="2024-02-24T00:00:00Z"),
                         dict(ticket_id="t3", customer_id="c1", created_at="2024-01-31T23:59:59Z"), dict(ticket_id="t4", customer_id="c1", created_at="bad")])
    r = _risks(spark, [dict(risk_event_id="r1", customer_id="c2", detected_at="2024-02-25T00:00:00Z", severity="high", summary="auth")])
    cust = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "customer_id string")
    got = {x["customer_id"]: x for x in RK.risk_features(cust, t, r).collect()}
    assert got["c1"]["ticket_count_7d"] == 1 and got["c1"]["critical_ticket_count_30d"] == 1
    assert got["c2"]["failed_login_count_7d"] == 1 and got["c2"]["negative_signal_count_30d"] == 1
    assert all(got["c3"][f] == 0 for f in K.FEATURES)
    scores = {x["customer_id"]: x for x in RK.score_risk(RK.risk_features(cust, t, r)).collect()}
    assert scores["c3"]["risk_score"] == 0.0 and scores["c3"]["risk_level"] == "low"
    assert RK.risk_reasons(RK.risk_features(cust, t, r)).where("customer_id = 'c3'").first()["reason"].startswith("No recent")


def test_isolation_prefers_the_outlier(spark):
    rows = [(f"c{i}", *[float(i % 3)] * 7) for i in range(60)] + [("odd", *[50.0] * 7)]
    f = spark.createDataFrame(rows, "customer_id string, " + ", ".join(f"{x} double" for x in K.FEATURES))
    out = RK.isolation_risk(f, n_trees=30, sample=64).orderBy(F.col("risk_score").desc()).collect()
    assert out[0]["customer_id"] == "odd" and out[0]["risk_score"] == 100.0 and out[-1]["risk_score"] == 0.0
    assert RK.isolation_risk(f.limit(1)).count() == 1


def test_triage_branches(spark):
    t = _tickets(spark, [dict(ticket_id="1", priority="p3", severity="sev1", status="open"), dict(ticket_id="2", category="security", status="open"),
                         dict(ticket_id="3", priority="p3", status="resolved", sla_status="breached"), dict(ticket_id="4", status="open")])
    got = {r["ticket_id"]: r for r in S.triage_tickets(t).collect()}
    assert (got["1"]["recommended_priority"], got["1"]["recommended_status"]) == ("p1", "pending_engineering")
    assert (got["2"]["recommended_priority"], got["2"]["escalation_required"]) == ("p2", True)
    assert (got["3"]["recommended_priority"], got["3"]["recommended_status"], got["3"]["escalation_required"]) == ("p2", "resolved", True)
    assert got["4"]["recommended_priority"] == "p4" and not got["4"]["escalation_required"]


def _evidence(spark, rows):
    return spark.createDataFrame(rows, "query_id long, pos long, id string, text string, metadata map<string,string>, context_source string, source_type string, title string")


def test_sufficiency_freshness_and_conflicts(spark):
    q = spark.createDataFrame([(1, "SLA status of tkt_1"), (2, "hello there")], "query_id long, query string")
    ev = _evidence(spark, [(1, 1, "Ticket:tkt_1", "Status: open", {"entity_id": "tkt_1", "status": "closed", "created_at": "2024-01-01T00:00:00Z"}, "both", "ticket", "T"),
                           (1, 2, "Policy:pol_1", "x", {"entity_id": "pol_1"}, "graph", "policy", "P")])
    s = {r["query_id"]: r for r in EV.evidence_sufficiency(q, ev, "2024-06-29 00:00:00").collect()}
    assert s[1]["missing_source_types"] == [] and s[1]["conflicts"] == ["Conflicting status for tkt_1: closed, open"]
    want = 0.22 * 0.5 + 0.18 * 2 / 3 + 0.18 + 0.25 + 0.07 - 0.15
    assert abs(s[1]["raw_score"] - want) < 1e-9 and s[1]["level"] == "medium" and s[2]["level"] == "low"
    for day, score in [("2024-06-30", 0.6), ("2024-12-31", 0.6), ("2025-01-01", 0.1)]:
        again = EV.evidence_sufficiency(q, ev, f"{day} 00:00:00").where("query_id = 1").first()
        assert abs(again["raw_score"] - (want - 0.07 + 0.07 * score)) < 1e-9


def test_citations_and_answer(spark):
    q = spark.createDataFrame([(1, "refund for tkt_1 and the phone number")], "query_id long, query string")
    ev = _evidence(spark, [(1, i, f"Ticket:tkt_{i}", "Header:\nNo match here. Refund is due for tkt_1!", {"entity_id": f"tkt_{i}"}, "vector", "ticket", f"T{i}") for i in range(1, 7)])
    c = EV.citations(q, ev).orderBy("index").collect()
    assert c[0]["snippet"] == "Refund is due for tkt_1!" and [x["claim_index"] for x in c] == [1, 2, 3, 4, None, None]
    s = EV.evidence_sufficiency(q, ev, "2024-01-01 00:00:00")
    a = EV.grounded_answers(q, EV.citations(q, ev), s).first()
    assert a["missing_information"][0].endswith("phone number") and "- [1] ticket tkt_1 (T1): Refund" in a["answer"] and a["confidence"] == "low"


def test_merge_keeps_vector_first(spark):
    v = spark.createDataFrame([(1, 1, "b", {"source_type": "ticket", "entity_id": "t1"}), (1, 2, "a", {"title": "free"})], "query_id long, rank int, text string, metadata map<string,string>")
    nodes = spark.createDataFrame([("Ticket:t1", "Ticket", "L", "g", {"x": "1"}), ("Account:a", "Account", "A", "", {"x": "2"})], "node_id string, node_type string, label string, text string, properties map<string,string>")
    ctx = spark.createDataFrame([(1, "Ticket:t1"), (1, "Account:a")], "query_id long, node_id string")
    out = EV.merge_evidence(EV.evidence_from_hits(v), EV.evidence_from_nodes(ctx, nodes)).orderBy("pos").collect()
    assert [(r["id"], r["context_source"]) for r in out] == [("Ticket:t1", "both"), ("free", "vector"), ("Account:a", "graph")]
    assert out[0]["text"] == "Vector evidence:\nb\n\nGraph evidence:\ng" and out[0]["metadata"]["x"] == "1"


def test_rank_metrics_and_gate(spark):
    cases = spark.createDataFrame([(1, ["s"], [], []), (2, ["s"], [], []), (3, [], [], [])],
                                  "query_id long, expected_sources array<string>, expected_documents array<string>, expected_categories array<string>")
    res = spark.createDataFrame([(1, 1, "S"), (2, 1, "x"), (2, 2, "s"), (3, 1, "s")], "query_id long, rank int, source string")
    m = {r["aspect"]: r for r in M.rank_metrics(M.annotate_relevance(res, cases), cases, 3).collect()}
    assert m["overall"]["queries_evaluated"] == 2 and m["overall"]["hit_at_k"] == 1.0 and m["overall"]["mrr"] == 0.75
    assert m["document"]["queries_evaluated"] == 0 and m["document"]["mrr"] is None
    gate = M.quality_gate(spark.createDataFrame([(0.7, None)], "recall_at_5 double, source_type_hit_rate double")).collect()
    assert [g["passed"] for g in gate] == [True, False]


def test_snippets_are_chosen_once_and_blocks_travel_once(spark):
    q = spark.createDataFrame([(1, "sla breach of tkt_1"), (2, "nothing")], "query_id long, query string")
    ev = spark.createDataFrame([(1, 1, "Ticket:tkt_1", "Title: x\nThe SLA breach is near. tkt_1 waits.", {"entity_id": "tkt_1"}, "vector", "ticket", "T"),
                                (1, 2, "Ticket:tkt_2", "", {"ticket_id": "tkt_2"}, "graph", "ticket", "U")],
                               "query_id long, pos long, id string, text string, metadata map<string,string>, context_source string, source_type string, title string")
    cites = EV.citations(q, ev)
    assert "regexp" not in cites._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["index"], r["snippet"], r["claim_index"], r["entity_id"]) for r in cites.orderBy("index").collect()] == [
        (1, "The SLA breach is near.", 1, "tkt_1"), (2, "", None, "tkt_2")]
    blocks = EV.context_blocks(ev)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    text = blocks.first()["context_text"]
    assert text.index("[1] T") < text.index("[2] U") and text.startswith("Enterprise evidence context\n\n[1]")
    keys = spark.createDataFrame([({"source_type": "Ticket", "entity_id": "tkt_1", "customer_id": "c"},), ({"customer_id": "c", "account_id": "a"},),
                                  ({"source_type": "other", "entity_id": "x", "ticket_id": "t"},), ({"kg_node_id": "Team:a", "ticket_id": "t"},), ({},)], "metadata map<string,string>")
    assert [r[0] for r in keys.select(EV.canonical_id()).collect()] == ["Ticket:tkt_1", "Customer:c", "", "Team:a", ""]
