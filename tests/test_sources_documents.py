import json

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import documents as D, graph as G, quality as Q
from evidence_spark.sources import readers as RD
from evidence_spark.sources.cases import load_eval_cases
from evidence_spark.specs import SUPPORT, get_domain

FILES = {
    "crm/customers.csv": "customer_id,account_id,full_name,email,role,region,timezone,created_at,status,support_tier,preferred_contact_channel\n"
                         "cust_1,acct_1,\"Ann, Lee\",a@x.io,admin,EU,UTC,2024-01-01T00:00:00Z,active,gold,email\ncust_2,acct_9,Bo,,dev,,UTC,,active,,\n",
    "crm/accounts.csv": "account_id,account_name,industry,segment,region,account_owner,contract_start_date,contract_end_date,arr_usd,health_score,risk_level,created_at\n"
                        "acct_1,North,tech,mid,EU,Team A!,,,1,80,low,\n",
    "crm/products.csv": "product_id,product_name,product_family,service_id,plan_name,lifecycle_stage,support_owner_team,engineering_owner_team,docs_url\n"
                        "prod_1,Sync,core,svc_1,pro,ga,team_a,team_b,\n",
    "support/tickets.csv": "ticket_id,account_id,customer_id,product_id,service_id,title,description,category,priority,severity,status,channel,created_at,updated_at,first_response_due_at,resolution_due_at,sla_status,assigned_team,assignee,tags\n"
                           "tkt_1,acct_1,cust_1,prod_1,svc_1,API timeout,\"line one\nline two\",technical,p1,sev1,open,web,2024-01-02T00:00:00Z,2024-01-03T00:00:00Z,,,breached,team_a,,api|sync\n"
                           "tkt_2,acct_1,cust_x,prod_1,,Seat question,,general,,,open,web,2024-01-02,,,,,,,\n",
    "support/ticket_messages.csv": "message_id,ticket_id,author_type,author_id,created_at,visibility,message_type,body,sentiment,contains_action_item\n"
                                   "msg_1,tkt_1,customer,cust_1,2024-01-02,public,reply,help,neg,false\nmsg_2,tkt_1,customer,cust_1,2024-01-03,internal,reply,secret,neg,false\n",
    "support/ticket_resolutions.csv": "resolution_id,ticket_id,resolved_at,resolution_type,summary,root_cause,linked_policy_id,linked_issue_id,customer_visible_response,preventive_action\n"
                                      "res_1,tkt_1,2024-01-04,fix,done,,pol_sla,gh_1,Fixed.,\n",
    "engineering/service_catalog.csv": "service_id,service_name,description,product_id,owner_team,support_escalation_team,tier,slack_channel,runbook_policy_id,on_call_rotation,repo,status\n"
                                       "svc_1,Gateway,routes,prod_1,team_b,team_a,1,#g,pol_sla,r,repo/g,active\n",
    "risk/risk_events.csv": "risk_event_id,account_id,customer_id,ticket_id,product_id,service_id,event_type,severity,risk_score,detected_at,source,summary,evidence_refs,recommended_action,status\n"
                            "risk_1,acct_1,cust_1,tkt_1,prod_1,svc_1,incident,high,90,2024-01-02T00:00:00Z,mon,API down,tkt_1,act,open\n",
    "knowledge_base/sla.md": "---\npolicy_id: pol_sla\ntitle: \"SLA: rules\"\ntags: [sla, 'gold']\n# note: x\n---\n\n# Heading\n\nBody text\n",
    "knowledge_base/plain.md": "# Plain title\r\ntext",
    "engineering/github_issues.jsonl": json.dumps({"issue_id": "gh_1", "repo": "r", "number": 7, "title": "Bug", "body": "b", "state": "open", "labels": ["x", "y"],
        "service_id": "svc_1", "product_id": "prod_1", "linked_ticket_ids": ["tkt_1", "tkt_none"], "created_at": "2024-01-01", "updated_at": "", "closed_at": None}) + "\n\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("support")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(text.encode())
    return str(base)


@pytest.fixture(scope="module")
def tables(spark, root):
    return RD.load_domain(spark, "Enterprise-Support", root)


def test_csv_and_markdown_rows(tables):
    t = tables["tickets"].orderBy("_ord").collect()
    assert t[0]["description"] == "line one\nline two" and t[0]["metadata"]["customer_id"] == "cust_1"
    kb = {r["policy_id"]: r for r in tables["knowledge_base_docs"].collect()}
    assert kb["pol_sla"]["title"] == "SLA: rules" and kb["pol_sla"]["tags"] == "sla|gold"
    assert kb["pol_sla"]["content"] == "# Heading\n\nBody text" and kb["pol_sla"]["path"] == "knowledge_base/sla.md"
    assert kb["plain"]["title"] == "Plain title"


def test_validation_report(tables):
    got = {(r["table_name"], r["line"], r["rule"]) for r in Q.validation_report(tables, SUPPORT).collect()}
    assert got == {("tickets", 3, "dangling_fk")}


def test_documents(tables):
    docs = {r["id"]: r for r in D.build_documents("enterprise_support", tables).collect()}
    assert len(docs) == 2 + 2 + 2 + 1 + 1 + 1
    ticket = docs["enterprise_support::ticket::tkt_1"]["text"]
    assert "Messages: 2024-01-02 | customer | public | reply: help, 2024-01-03" in ticket
    assert "Related engineering issues: gh_1 - Bug - open" in ticket and "Account: North" in ticket
    issue = docs["enterprise_support::github_issue::gh_1"]
    assert "Linked tickets: tkt_1 - API timeout - open - p1" in issue["text"] and issue["metadata"]["ticket_id"] is None
    assert docs["enterprise_support::customer::cust_2"]["text"].splitlines()[-1] == "Account ID: acct_9"
    assert D.build_documents("enterprise_support", tables).groupBy("id").count().where("count > 1").count() == 0


def test_graph(tables):
    nodes = G.build_nodes(tables)
    by_id = {r["node_id"]: r for r in nodes.collect()}
    assert by_id["Team:Team_A"]["label"] == "Team A!" and by_id["RiskEvent:risk_1"]["label"] == "API down"
    edges = {(r["src"], r["dst"], r["edge_type"]): r["properties"] for r in G.build_edges(tables, nodes).collect()}
    assert edges[("Ticket:tkt_1", "Policy:pol_sla", "REFERENCES_POLICY")] == {"reason": "rule_based_ticket_context"}
    assert ("Ticket:tkt_2", "Service:", "AFFECTS_SERVICE") not in edges and ("Service:svc_1", "Policy:pol_sla", "REFERENCES_POLICY") in edges
    assert ("Service:svc_1", "Policy:pol_sla", "REFERENCES_POLICY") not in {
        (r["src"], r["dst"], r["edge_type"]) for r in G.build_edges(tables, nodes, as_built=True).collect()}


def test_bad_json_names_the_line(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"issue_id": "a"}\n\n[1]\n')
    with pytest.raises(ValueError, match="line 3"):
        RD.read_entity_jsonl(spark, str(p), RD.ISSUE_SCHEMA)
    assert RD.read_entity_jsonl(spark, str(p), RD.ISSUE_SCHEMA, "quarantine").where(F.col("_corrupt_record").isNotNull()).count() == 1
    with pytest.raises(FileNotFoundError):
        RD.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        get_domain("nope")


def test_eval_cases(spark):
    raw = spark.createDataFrame([(1, "", "What is  SLA?", ["A", " a", ""], "doc"), (2, "c9", "q", None, None)],
                                "_ord long, id string, query string, expected_sources array<string>, expected_document string")
    got = load_eval_cases(raw).orderBy("_ord").collect()
    assert got[0]["case_id"] == "case-001-what-is-sla" and got[0]["expected_sources"] == ["A"] and got[0]["expected_documents"] == ["doc"]
    assert got[1]["case_id"] == "c9"


def test_edges_and_nodes_of_repeated_keys(spark):
    """Without given nodes the edges are those between all nodes of the tables, repeated rows and missing ends included."""
    tickets = spark.createDataFrame(
        [(1, "tkt_1", "cust_1", "prod_1", "svc_1", "SLA breach", "a", "Team A"), (2, "tkt_1", "cust_2", "prod_9", "svc_1", "Later title", "b", "Team  A"),
         (3, "tkt_2", "cust_1", "", "svc_9", "Other", "c", "")],
        "_ord long, ticket_id string, customer_id string, product_id string, service_id string, title string, description string, assigned_team string").selectExpr(
        "*", "'' AS category", "'' AS priority", "'' AS severity", "'' AS status", "'' AS sla_status", "'sla' AS tags", "'' AS channel")
    customers = spark.createDataFrame([(1, "cust_1", "acct_1", "Ann"), (2, "cust_2", "acct_x", "Bob")], "_ord long, customer_id string, account_id string, full_name string")
    products = spark.createDataFrame([(1, "prod_1", "One", "Team A", "Team A")], "_ord long, product_id string, product_name string, support_owner_team string, engineering_owner_team string")
    policies = spark.createDataFrame([(1, "pol_sla", "Policy guide", "P", "prod_1", "svc_1")], "_ord long, policy_id string, title string, owner_team string, product_id string, service_id string")
    solved = spark.createDataFrame([(1, "res_1", "tkt_1", "fix", "pol_sla", "gh_1"), (2, "res_2", "tkt_8", "fix", "pol_sla", "gh_2"), (3, "res_3", "tkt_1", "fix", "pol_sla", "gh_1")],
                                   "_ord long, resolution_id string, ticket_id string, resolution_type string, linked_policy_id string, linked_issue_id string").selectExpr("*", "'' AS summary", "'' AS resolved_at")
    issues = spark.createDataFrame([(1, "gh_1", "Issue", "tkt_1|tkt_7", "Team A")], "_ord long, issue_id string, title string, linked_ticket_ids string, assignee_team string")
    tables = {"customers": customers, "products": products, "tickets": tickets, "knowledge_base_docs": policies, "ticket_resolutions": solved, "github_issues": issues}
    nodes = G.build_nodes(tables)
    got = {r["node_id"]: (r["label"], r["properties"]) for r in nodes.collect()}
    assert nodes.count() == len(got) and got["Ticket:tkt_1"][0] == "Later title" and got["Ticket:tkt_1"][1]["customer_id"] == "cust_2"
    assert got["Team:Team_A"][0] == "Team A"  # the owners of issues come after those of tickets
    want = {(r["src"], r["dst"], r["edge_type"]): r["properties"] for r in G.build_edges(tables, nodes).collect()}
    rows = G.build_edges(tables).collect()
    assert len(rows) == len(want) and {(r["src"], r["dst"], r["edge_type"]): r["properties"] for r in rows} == want
    assert want[("Ticket:tkt_1", "Policy:pol_sla", "HAS_RESOLUTION")]["resolution_id"] == "res_1"
    assert ("Ticket:tkt_1", "GitHubIssue:gh_1", "RELATED_TO_ISSUE") in want and ("Ticket:tkt_8", "Policy:pol_sla", "HAS_RESOLUTION") not in want
