"""Role views: the given star-schema tables presented as support-domain tables.

Each view is a plain projection or join written in the SQL subset that Spark and DuckDB
share, so a query and its check start from the same rows. ``@ISO(x)`` formats a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]

_S = "CAST({} AS STRING)"


def s(expr: str) -> str:
    return _S.format(expr)


ROLE_SQL: dict[str, str] = {}

ROLE_SQL["customers"] = f"""
SELECT c_custkey AS _ord, concat('cust_', {s('c_custkey')}) AS customer_id, concat('acct_', {s('c_nationkey')}) AS account_id,
  c_name AS full_name, concat('c', {s('c_custkey')}, '@example.com') AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' ELSE 'developer' END AS role, '' AS region,
  'UTC' AS timezone, '2024-01-01T00:00:00Z' AS created_at, 'active' AS status, lower(c_mktsegment) AS support_tier,
  CASE c_custkey % 2 WHEN 0 THEN 'email' ELSE 'portal' END AS preferred_contact_channel
FROM customer"""

ROLE_SQL["accounts"] = f"""
SELECT n_nationkey AS _ord, concat('acct_', {s('n_nationkey')}) AS account_id, n_name AS account_name,
  'trade' AS industry, coalesce(r_name, '') AS segment, coalesce(r_name, '') AS region,
  concat(coalesce(r_name, 'Global'), ' Success Team') AS account_owner, '' AS contract_start_date,
  '' AS contract_end_date, {s('n_nationkey * 1000')} AS arr_usd, {s('40 + (n_nationkey * 7) % 60')} AS health_score,
  CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level, '' AS created_at
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""

ROLE_SQL["products"] = f"""
SELECT p_partkey AS _ord, concat('prod_', {s('p_partkey')}) AS product_id, p_name AS product_name,
  lower(p_type) AS product_family, '' AS service_id, p_brand AS plan_name, 'ga' AS lifecycle_stage,
  concat(p_brand, ' Support') AS support_owner_team, concat(p_type, ' Engineering') AS engineering_owner_team,
  '' AS docs_url FROM part"""

ROLE_SQL["service_catalog"] = f"""
SELECT s_suppkey AS _ord, concat('svc_', {s('s_suppkey')}) AS service_id, s_name AS service_name,
  concat('Handles requests routed to ', s_name) AS description, concat('prod_', {s('s_suppkey')}) AS product_id,
  concat('Nation ', {s('s_nationkey')}, ' Ops') AS owner_team,
  concat('Tier ', {s('s_suppkey % 3')}, ' Support') AS support_escalation_team, {s('s_suppkey % 3')} AS tier,
  concat('#svc-', {s('s_suppkey')}) AS slack_channel,
  CASE s_suppkey % 4 WHEN 0 THEN 'pol_sla' WHEN 1 THEN 'pol_incident_response' WHEN 2 THEN 'pol_access' ELSE '' END
    AS runbook_policy_id, '' AS on_call_rotation, concat('repo/', s_name) AS repo, 'active' AS status
FROM supplier"""

_TOPIC = """CASE {k} % 8 WHEN 0 THEN 'API gateway timeout during sync' WHEN 1 THEN 'SSO login loop after rotation'
    WHEN 2 THEN 'Billing credit missing from invoice' WHEN 3 THEN 'Data export is late'
    WHEN 4 THEN 'Incident with duplicate_orders' WHEN 5 THEN 'MFA reset for lost_device'
    WHEN 6 THEN 'Question about seat limits' ELSE 'Frustrated user reports slow search' END"""
_CATEGORY = """CASE {k} % 8 WHEN 0 THEN 'technical' WHEN 1 THEN 'access' WHEN 2 THEN 'billing' WHEN 3 THEN 'data'
    WHEN 4 THEN 'incident' WHEN 5 THEN 'security' ELSE 'general' END"""
_TAGS = """CASE {k} % 8 WHEN 0 THEN 'api_timeout|batch' WHEN 1 THEN 'login|sso' WHEN 2 THEN 'refund| billing '
    WHEN 3 THEN 'export' WHEN 4 THEN 'outage|sev' WHEN 5 THEN 'mfa||device' ELSE '' END"""

ROLE_SQL["tickets"] = f"""
SELECT o_orderkey AS _ord, concat('tkt_', {s('o_orderkey')}) AS ticket_id,
  coalesce(concat('acct_', {s('c_nationkey')}), '') AS account_id, concat('cust_', {s('o_custkey')}) AS customer_id,
  CASE WHEN l.pk IS NULL THEN '' ELSE concat('prod_', {s('l.pk')}) END AS product_id,
  CASE WHEN l.sk IS NULL THEN '' ELSE concat('svc_', {s('l.sk')}) END AS service_id,
  concat({_TOPIC.format(k='o_orderkey')}, ' for order ', {s('o_orderkey')}) AS title,
  concat('Customer reports: ', lower({_TOPIC.format(k='o_orderkey')})) AS description,
  {_CATEGORY.format(k='o_orderkey')} AS category,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'p1' WHEN '2' THEN 'p2' WHEN '3' THEN 'p3' ELSE 'p4' END AS priority,
  CASE WHEN substr(o_orderpriority, 1, 1) = '1' AND o_orderkey % 2 = 0 THEN 'sev1'
       WHEN substr(o_orderpriority, 1, 1) = '2' AND o_orderkey % 3 = 0 THEN 'sev2' ELSE 'sev3' END AS severity,
  CASE WHEN o_orderstatus = 'P' THEN 'pending_engineering'
       WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'resolved'
       WHEN o_orderkey % 4 = 0 THEN 'pending_customer' ELSE 'open' END AS status,
  'portal' AS channel, @ISO(o_orderdate) AS created_at, @ISO(o_orderdate + INTERVAL '1' DAY) AS updated_at,
  @ISO(o_orderdate + INTERVAL '4' HOUR) AS first_response_due_at, @ISO(o_orderdate + INTERVAL '2' DAY) AS resolution_due_at,
  CASE WHEN o_totalprice >= 450000 THEN 'breached' WHEN o_totalprice >= 400000 THEN 'at_risk'
       WHEN o_totalprice < 20000 THEN '' ELSE 'within_sla' END AS sla_status,
  concat('Team ', {s('o_orderkey % 6')}) AS assigned_team, '' AS assignee, {_TAGS.format(k='o_orderkey')} AS tags
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey AS ok, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) l
  ON o_orderkey = l.ok"""

ROLE_SQL["ticket_messages"] = f"""
SELECT CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS _ord,
  concat('msg_', {s('l_orderkey')}, '_', {s('l_linenumber')}, '_', {s('l_partkey')}, '_', {s('l_suppkey')}) AS message_id,
  concat('tkt_', {s('l_orderkey')}) AS ticket_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'customer' ELSE 'engineering' END AS author_type,
  concat('agent_', {s('l_suppkey')}) AS author_id, @ISO(l_shipdate) AS created_at,
  CASE l_returnflag WHEN 'A' THEN 'internal' ELSE 'public' END AS visibility,
  CASE l_linestatus WHEN 'O' THEN 'update' ELSE 'reply' END AS message_type,
  concat('Line ', {s('l_linenumber')}, ' part ', {s('l_partkey')}, ' from supplier ', {s('l_suppkey')}, ' needs review') AS body,
  CASE WHEN l_discount > 0.07 THEN 'negative' ELSE 'neutral' END AS sentiment, 'false' AS contains_action_item
FROM lineitem"""

ROLE_SQL["ticket_resolutions"] = f"""
SELECT o_orderkey AS _ord, concat('res_', {s('o_orderkey')}) AS resolution_id, concat('tkt_', {s('o_orderkey')}) AS ticket_id,
  @ISO(o_orderdate + INTERVAL '1' DAY) AS resolved_at, CASE o_orderkey % 2 WHEN 0 THEN 'fix' ELSE 'workaround' END AS resolution_type,
  concat('Resolved by change ', {s('o_orderkey % 7')}) AS summary, '' AS root_cause,
  CASE o_orderkey % 5 WHEN 0 THEN 'pol_sla' WHEN 1 THEN 'pol_access' WHEN 2 THEN 'pol_refund' WHEN 3 THEN '' ELSE 'pol_unknown' END
    AS linked_policy_id, concat('gh_', {s('o_orderkey')}) AS linked_issue_id,
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('Change ', {s('o_orderkey % 7')}, ' is live.') END AS customer_visible_response,
  '' AS preventive_action FROM orders WHERE o_orderstatus = 'F'"""

ROLE_SQL["github_issues"] = f"""
SELECT doc_id AS _ord, concat('gh_', {s('doc_id')}) AS issue_id, source AS repo, {s('doc_id')} AS number,
  concat('Issue ', {s('doc_id')}, ' in ', source) AS title, text AS body,
  CASE doc_id % 2 WHEN 0 THEN 'open' ELSE 'closed' END AS state, concat(lang, '|', source) AS labels,
  concat('svc_', {s('doc_id % 100')}) AS service_id, concat('prod_', {s('doc_id')}) AS product_id,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('tkt_', {s('doc_id')})
    WHEN 2 THEN concat('tkt_', {s('doc_id * 20')}, '| tkt_', {s('doc_id')}) ELSE concat('tkt_', {s('doc_id')}, '|tkt_none') END AS linked_ticket_ids,
  CASE doc_id % 3 WHEN 0 THEN 'sev1' ELSE 'sev3' END AS severity, '2024-01-02T00:00:00Z' AS created_at,
  '2024-01-03T00:00:00Z' AS updated_at, '' AS closed_at, concat('Team ', {s('doc_id % 6')}) AS assignee_team,
  '' AS resolution_summary FROM documents"""

_KIND = """CASE WHEN event_type = 'error' THEN (CASE event_id % 4 WHEN 0 THEN 'incident' WHEN 1 THEN 'sla_breach'
    WHEN 2 THEN 'security' ELSE 'usage_anomaly' END) WHEN event_type = 'purchase' THEN 'billing_review' ELSE 'login_review' END"""

ROLE_SQL["risk_events"] = f"""
SELECT event_id AS _ord, concat('risk_', {s('event_id')}) AS risk_event_id,
  CASE event_id % 2 WHEN 0 THEN concat('acct_', {s('user_id % 25')}) ELSE '' END AS account_id,
  concat('cust_', {s('user_id')}) AS customer_id,
  CASE event_id % 3 WHEN 0 THEN '' ELSE concat('tkt_', {s('event_id')}) END AS ticket_id,
  concat('prod_', {s('event_id')}) AS product_id, concat('svc_', {s('event_id % 100')}) AS service_id,
  {_KIND} AS event_type,
  CASE WHEN value >= 150 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS severity,
  {s('CAST(floor(CASE WHEN value > 99 THEN 99 ELSE value END) AS BIGINT)')} AS risk_score,
  @ISO(ts) AS detected_at, 'events' AS source, concat({_KIND}, ' signal ', {s('event_id')}) AS summary,
  concat('tkt_', {s('event_id')}, '|pol_sla') AS evidence_refs, 'Review the signal' AS recommended_action,
  CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'mitigated' ELSE 'closed' END AS status
FROM events WHERE event_type IN ('error', 'purchase', 'signup')"""

ROLE_SQL["recent_tickets"] = f"""
SELECT event_id AS _ord, concat('tkt_e', {s('event_id')}) AS ticket_id, concat('cust_', {s('user_id')}) AS customer_id,
  concat('prod_', {s('event_id % 50')}) AS product_id, concat('svc_', {s('event_id % 100')}) AS service_id,
  {_TOPIC.format(k='event_id')} AS title, concat('Seen as ', event_type) AS description,
  {_CATEGORY.format(k='event_id')} AS category,
  CASE WHEN value >= 120 THEN 'p1' WHEN value >= 80 THEN 'p2' WHEN value >= 30 THEN 'p3' ELSE 'p4' END AS priority,
  CASE event_id % 9 WHEN 0 THEN 'sev1' ELSE 'sev3' END AS severity,
  CASE event_id % 5 WHEN 0 THEN 'pending_engineering' WHEN 1 THEN 'resolved' ELSE 'open' END AS status,
  CASE event_id % 11 WHEN 0 THEN 'breached' ELSE 'within_sla' END AS sla_status, @ISO(ts) AS created_at,
  @ISO(ts + INTERVAL '1' HOUR) AS updated_at, {_TAGS.format(k='event_id')} AS tags
FROM events WHERE event_type IN ('view', 'click')"""

ROLE_SQL["knowledge_base_docs"] = f"""
SELECT item_id AS _ord, CASE item_id WHEN 0 THEN 'pol_sla' WHEN 1 THEN 'pol_api_timeout' WHEN 2 THEN 'pol_login_troubleshooting'
    WHEN 3 THEN 'pol_security_escalation' WHEN 4 THEN 'pol_refund' WHEN 5 THEN 'pol_data_retention' WHEN 6 THEN 'pol_access'
    WHEN 7 THEN 'pol_incident_response' WHEN 8 THEN 'pol_enterprise_support' ELSE concat('pol_', {s('item_id')}) END AS policy_id,
  concat('Policy guide ', {s('item_id')}) AS title, 'policy' AS policy_type, 'Policy Team' AS owner_team,
  CASE item_id % 3 WHEN 0 THEN concat('prod_', {s('item_id')}) ELSE '' END AS product_id,
  CASE item_id % 3 WHEN 1 THEN concat('svc_', {s('item_id')}) ELSE '' END AS service_id,
  '2024-01-01' AS effective_date, '2024-10-01' AS review_date, 'sla| support ' AS tags,
  concat('Guidance number ', {s('item_id')}) AS summary, concat('knowledge_base/', {s('item_id')}, '.md') AS path,
  text AS content FROM benchmark"""

_ASK = f"""concat(CASE item_id % 8
    WHEN 0 THEN concat('What is the SLA status of tkt_', {s('item_id')}, ' and who owns svc_', {s('item_id')}, '?')
    WHEN 1 THEN concat('Summarize customer cust_', {s('item_id')}, ' health and renewal risk.')
    WHEN 2 THEN concat('Which policy covers the billing credit and refund for tkt_', {s('item_id')}, '?')
    WHEN 3 THEN concat('Why is the api gateway timeout on svc_', {s('item_id')}, ' an incident?')
    WHEN 4 THEN concat('Triage priority and severity for ticket tkt_', {s('item_id')}, '.')
    WHEN 5 THEN 'How do I sign in to github with a passkey using ssh?'
    WHEN 6 THEN 'Show sources about the gitlab handbook and repository access policy.'
    ELSE concat('Is there a phone number for cust_', {s('item_id')}, ' and its open issue?') END, ' ', text)"""

ROLE_SQL["questions"] = f"SELECT item_id AS query_id, {_ASK} AS query FROM benchmark"

_ND = "CAST('' AS STRING)"
ROLE_SQL["corpus"] = f"""
SELECT concat('document:doc_', {s('doc_id')}) AS doc_key, concat('doc::', {s('doc_id')}) AS doc_id, text,
  CASE doc_id % 4 WHEN 0 THEN 'github_docs' WHEN 1 THEN 'gitlab_handbook' WHEN 2 THEN 'github_issues' ELSE source END AS source,
  'document' AS source_type, concat('doc_', {s('doc_id')}) AS entity_id,
  CASE doc_id % 4 WHEN 0 THEN concat('Signing in with a passkey part ', {s('doc_id')}) WHEN 1 THEN concat('GitLab handbook policy ', {s('doc_id')})
    WHEN 2 THEN concat('Issue about repository access ', {s('doc_id')}) ELSE concat('Overview ', source, ' ', lang, ' ', {s('doc_id')}) END AS title,
  '' AS customer_id, '' AS account_id, '' AS ticket_id, '' AS product_id, '' AS service_id, '' AS policy_id,
  CASE doc_id % 4 WHEN 0 THEN concat('authentication/', {s('doc_id')}, '.md') ELSE concat('files/', {s('doc_id')}) END AS path,
  concat('https://docs.example.com/', {s('doc_id')}) AS url FROM documents
UNION ALL
SELECT concat('ticket:', ticket_id), concat('ticket::', ticket_id),
  concat('Support Ticket', chr(10), 'Title: ', title, chr(10), 'Status: ', status, chr(10), 'Priority: ', priority, chr(10),
    'SLA status: ', sla_status, chr(10), description, '. Tags: ', tags, '.'),
  'tickets', 'ticket', ticket_id, title, customer_id, account_id, ticket_id, product_id, service_id, '', '', '' FROM tickets
UNION ALL
SELECT concat('knowledge_base:', policy_id), concat('kb::', policy_id), content, 'policies', 'knowledge_base', policy_id, title,
  '', '', '', product_id, service_id, policy_id, path, '' FROM knowledge_base_docs"""

ROLE_SQL["question_vectors"] = "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"
ROLE_SQL["doc_vectors"] = f"SELECT concat('document:doc_', {s('vec_id')}) AS doc_key, embedding FROM embeddings"

ROLE_SQL["leaf_hits"] = f"""
SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rank,
  CASE l_linenumber % 5 WHEN 0 THEN 'parent' ELSE 'leaf' END AS node_type,
  concat('leaf_', {s('l_orderkey')}, '_', {s('l_linenumber')}, '_', {s('l_partkey')}) AS leaf_id, concat('tkt_', {s('l_orderkey')}) AS parent_id,
  concat('cust_', {s('o_custkey')}) AS origin_doc_id, concat('line_', {s('l_orderkey')}, '_', {s('l_linenumber')}, '_', {s('l_partkey')}) AS doc_id,
  concat('Line ', {s('l_linenumber')}, ' of order ', {s('l_orderkey')}) AS text, 'Order line' AS title, 'lines' AS source, 'line' AS source_type, '' AS path, '' AS url
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ROLE_SQL["parent_nodes"] = """
SELECT ticket_id AS parent_id, _ord AS parent_index, concat(' ', title, ' ') AS text, concat('ticket::', ticket_id) AS doc_id, title, 'tickets' AS source,
  'ticket' AS source_type, '' AS path, '' AS url, customer_id AS origin_doc_id FROM tickets"""

ROLE_SQL["eval_cases"] = f"""
SELECT query_id, query, CASE query_id % 5 WHEN 0 THEN 'tickets' WHEN 1 THEN 'GitHub_Docs' WHEN 2 THEN 'ticket|policies' ELSE '' END AS sources,
  CASE query_id % 4 WHEN 0 THEN concat('ticket::tkt_', {s('query_id')}) WHEN 1 THEN 'passkey' ELSE '' END AS documents,
  CASE query_id % 3 WHEN 0 THEN 'incident|policy guide' WHEN 1 THEN 'ticket' ELSE '' END AS categories,
  CASE query_id % 8 WHEN 5 THEN 'github_authentication' WHEN 6 THEN 'gitlab_handbook|repository_access' WHEN 2 THEN 'gitlab_handbook' WHEN 0 THEN 'repository_access' ELSE '' END AS intents,
  CASE query_id % 2 WHEN 0 THEN concat('tkt_', {s('query_id')}, '|cust_', {s('query_id')}) ELSE '' END AS entity_ids,
  CASE query_id % 3 WHEN 0 THEN 'ticket|customer' WHEN 1 THEN 'ticket' ELSE '' END AS source_types
FROM questions"""

ROLE_SQL["customer_questions"] = f"""
SELECT c_custkey AS query_id, CASE c_custkey % 4
    WHEN 0 THEN concat('Summarize customer cust_', {s('c_custkey')}, ' account health and renewal.')
    WHEN 1 THEN concat('Why is tkt_', {s('c_custkey')}, ' at SLA breach risk for cust_', {s('c_custkey')}, '?')
    WHEN 2 THEN concat('Which refund policy applies and what is the phone number of cust_', {s('c_custkey')}, '?')
    ELSE 'Explain the api gateway timeout and the login loop' END AS query FROM customer"""

ROLE_SQL["customer_hits"] = f"""
SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank,
  concat('Title: ', title, chr(10), 'Status: ', status, chr(10), 'Priority: ', priority, chr(10), 'SLA status: ', sla_status, chr(10),
    description, '. The customer waits for an answer! Severity ', severity, '.') AS text,
  'ticket' AS source_type, ticket_id AS entity_id, title, customer_id, ticket_id, product_id, service_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'open' ELSE status END AS status, priority, created_at
FROM orders JOIN tickets ON o_orderkey = _ord"""

ROLE_SQL["customer_nodes"] = f"""
SELECT c_custkey AS query_id, concat('Customer:cust_', {s('c_custkey')}) AS node_id FROM customer
UNION ALL SELECT c_custkey, concat('Account:acct_', {s('c_nationkey')}) FROM customer
UNION ALL SELECT o_custkey, concat('Ticket:tkt_', {s('o_orderkey')}) FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT user_id, concat('RiskEvent:risk_', {s('event_id')}) FROM events WHERE event_type IN ('error', 'purchase', 'signup')"""

ROLE_SQL["graded_answers"] = f"""
SELECT query_id, query AS answer, query_id % 4 AS source_count, CASE query_id % 5 WHEN 0 THEN 'no_documents' ELSE 'ok' END AS stage, query_id % 7 = 0 AS used_fallback,
  CASE query_id % 3 WHEN 0 THEN 'tkt_|SLA  status' WHEN 1 THEN 'customer' ELSE '' END AS must_include, CASE query_id % 4 WHEN 3 THEN 'phone number' ELSE '' END AS must_not_include,
  CASE query_id % 2 WHEN 0 THEN 'owns|policy|the' ELSE '' END AS completeness_points, CASE query_id % 5 WHEN 1 THEN 'Customer health and renewal risk summary' ELSE '' END AS reference_answer,
  query_id % 3 AS minimum_source_count FROM questions"""

ROLE_SQL["session_turns"] = f"""
SELECT conv_id AS session_id, turn, role, CASE WHEN role = 'user' AND turn > 0 AND conv_id % 5 = 1 THEN 'Còn HTTPS thì sao?'
    WHEN role = 'user' AND turn > 0 AND conv_id % 5 = 2 THEN concat('Phần đó ', text)
    WHEN role = 'user' AND turn > 0 AND conv_id % 5 = 3 THEN concat('Ý tôi là ', text) ELSE text END AS content
FROM conversations"""

ROLE_SQL["md_docs"] = f"""
SELECT {s('doc_id')} AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'github_docs' WHEN 1 THEN 'gitlab_handbook' ELSE source END AS source,
  'markdown' AS source_type, concat('Document ', {s('doc_id')}) AS title, concat('docs/', {s('doc_id')}, '.md') AS path,
  concat('# Document ', {s('doc_id')}, chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10), '## Part', chr(10)))) AS text
FROM documents"""

ROLE_SQL["raw_issues"] = f"""
SELECT doc_id AS _ord, CASE WHEN doc_id % 10 = 9 THEN {s('doc_id - 9')} ELSE {s('doc_id')} END AS id, doc_id AS number,
  concat(CASE doc_id % 6 WHEN 0 THEN 'Cannot access repo' WHEN 1 THEN 'Login error' WHEN 2 THEN 'VPN drops' WHEN 3 THEN 'Setup question'
    WHEN 4 THEN 'Urgent' ELSE 'Note' END, ' ', {s('doc_id')}) AS title, text AS body,
  CASE doc_id % 2 WHEN 0 THEN 'open' ELSE 'closed' END AS state, lang, source,
  CASE WHEN doc_id % 13 = 0 THEN 'pr' END AS pull_request, '' AS created_at, '' AS updated_at,
  concat('https://issues.example.com/', {s('doc_id')}) AS html_url FROM documents"""

ROLE_SQL["md_files"] = f"""
SELECT concat(CASE doc_id % 4 WHEN 0 THEN 'get-started' WHEN 1 THEN 'authentication' WHEN 2 THEN 'repositories' ELSE 'billing' END,
    '/topic-', {s('doc_id')}, '.md') AS path,
  concat('---', chr(10), 'title: T', chr(10), '---', chr(10), CASE doc_id % 2 WHEN 0 THEN concat('# Guide ', {s('doc_id')}, chr(10)) ELSE '' END,
    '{{% data variables.product.name %}} and {{{{ output }}}} ', chr(13), chr(10), chr(10), chr(10), chr(10), text) AS content FROM documents"""

ROLE_SQL["banking_customers"] = f"""
SELECT c_custkey AS _ord, {s('c_custkey')} AS customer_id, c_name AS full_name, '' AS email, lower(c_mktsegment) AS segment, '' AS region,
  CASE c_custkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS risk_tier, 'verified' AS kyc_status, '2024-01-01' AS created_at FROM customer"""
ROLE_SQL["banking_accounts"] = f"""
SELECT c_custkey AS _ord, concat('ba_', {s('c_custkey')}) AS account_id, {s('c_custkey')} AS customer_id, 'checking' AS account_type,
  'open' AS status, '2024-01-01' AS opened_at, {s('CAST(floor(c_acctbal) AS BIGINT)')} AS balance_usd, 'true' AS online_banking_enabled FROM customer"""
ROLE_SQL["banking_merchants"] = f"""
SELECT s_suppkey AS _ord, concat('m_', {s('s_suppkey')}) AS merchant_id, s_name AS merchant_name, 'retail' AS category,
  concat('N', {s('s_nationkey')}) AS country, CASE s_suppkey % 4 WHEN 0 THEN 'high' ELSE 'low' END AS risk_level FROM supplier"""
ROLE_SQL["banking_transactions"] = f"""
SELECT o_orderkey AS _ord, concat('txn_', {s('o_orderkey')}) AS transaction_id, concat('ba_', {s('o_custkey')}) AS account_id,
  {s('o_custkey')} AS customer_id, concat('m_', {s('o_orderkey % 120')}) AS merchant_id, {s('CAST(floor(o_totalprice) AS BIGINT)')} AS amount_usd,
  'USD' AS currency, CASE o_orderkey % 2 WHEN 0 THEN 'purchase' ELSE 'transfer' END AS transaction_type, 'web' AS channel, 'US' AS country,
  @ISO(o_orderdate) AS created_at, lower(o_orderstatus) AS status, '' AS device_id, 'US' AS ip_country FROM orders"""
ROLE_SQL["banking_alerts"] = f"""
SELECT event_id AS _ord, concat('al_', {s('event_id')}) AS alert_id, concat('txn_', {s('event_id')}) AS transaction_id,
  {s('user_id')} AS customer_id, concat('ba_', {s('user_id')}) AS account_id, event_type AS alert_type,
  CASE WHEN value >= 100 THEN 'high' ELSE 'low' END AS severity, 'open' AS status, @ISO(ts) AS created_at, concat('rule_', event_type) AS rule_name,
  concat('Alert ', {s('event_id')}, ' on ', event_type) AS summary, 'Call the customer' AS recommended_action FROM events"""
ROLE_SQL["banking_cases"] = f"""
SELECT event_id AS _ord, concat('case_', {s('event_id')}) AS case_id, {s('user_id')} AS customer_id, concat('ba_', {s('user_id')}) AS account_id,
  'structuring' AS case_type, 'open' AS status, @ISO(ts) AS opened_at, 'p2' AS priority, concat('Case ', {s('event_id')}) AS summary,
  concat('al_', {s('event_id')}, '|al_', {s('event_id + 7')}, '|al_none') AS linked_alert_ids, 'aml' AS assigned_team,
  'File a report' AS recommended_action FROM events WHERE event_type = 'error'"""
ROLE_SQL["banking_policies"] = f"""
SELECT item_id AS _ord, concat('bf_pol_', {s('item_id')}) AS policy_id, concat('Policy ', {s('item_id')}) AS title,
  concat('policies/', {s('item_id')}, '.md') AS path, text AS content FROM benchmark"""

SUPPORT_TABLES = ["customers", "accounts", "products", "tickets", "ticket_messages", "ticket_resolutions",
                  "service_catalog", "github_issues", "risk_events", "knowledge_base_docs"]
BANKING_TABLES = {"customers": "banking_customers", "accounts": "banking_accounts", "transactions": "banking_transactions",
                  "merchants": "banking_merchants", "fraud_alerts": "banking_alerts", "aml_cases": "banking_cases",
                  "policies": "banking_policies"}

_ISO = re.compile(r"@ISO\(([^()]*)\)")


def spark_text(sql: str) -> str:
    return _ISO.sub(r"""date_format(\1, "yyyy-MM-dd'T'HH:mm:ss'Z'")""", sql)


def duck_text(sql: str) -> str:
    return _ISO.sub(r"strftime(\1, '%Y-%m-%dT%H:%M:%SZ')", sql)


def mentioned(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


class Roles:
    """Lazy access to base tables and role views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir, self._held = spark, sf_dir.rstrip("/"), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._held:
            self._held[name] = self._view(name) if name in ROLE_SQL else \
                self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._held[name]

    def _view(self, name: str) -> DataFrame:
        sql = spark_text(ROLE_SQL[name])
        deps = mentioned(sql, [*BASE_TABLES, *ROLE_SQL])
        for d in deps:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{d}\b", rf"\1 {{{d}}}", sql)
        sql = _braces(sql, deps)
        return self.spark.sql(sql, **{d: self[d] for d in deps})

    def shared(self, name: str, build) -> DataFrame:
        """A stored result that several steps of one query start from."""
        key = f"shared:{name}"
        if key not in self._held:
            self._held[key] = materialise(build())
        return self._held[key]

    def hold(self, *names) -> None:
        """Store views that several steps of one query read, before other views are built on them."""
        for name in names:
            if f"stored:{name}" not in self._held:
                self._held[name] = self._held[f"stored:{name}"] = materialise(self[name])

    def spread(self, **keys) -> None:
        """Deal tables by key before views are built on them: a given file may be one task. Narrow rows travel, not the view's texts."""
        for name, key in keys.items():
            self._held[name] = self[name].repartition(key)

    def support(self, *names) -> dict[str, DataFrame]:
        return {n: self[n] for n in (names or SUPPORT_TABLES)}

    def banking(self) -> dict[str, DataFrame]:
        return {n: self[view] for n, view in BANKING_TABLES.items()}


def _braces(sql: str, deps) -> str:
    """Double literal braces, keep the {table} placeholders."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for d in deps:
        sql = sql.replace("{{" + d + "}}", "{" + d + "}")
    return sql
