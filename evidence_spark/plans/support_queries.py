"""Queries over the relational side: joins, validation, documents, analytics, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.text import dashed, pipe_list, sval
from ..operators import documents as D, quality as Q, relational as R, risk as RK, support as S
from ..sources.index import upsert_index, upsert_rows
from ..session import new_folder
from ..specs import BANKING, SUPPORT
from .bindings import BANKING_TABLES
from .registry import SHARED, any_term, in_list, ln, lns, query

joined = lambda c: F.array_join(c, "|")


# -- joins --------------------------------------------------------------------------

@query("lookup_join", """
SELECT ticket_id, title, coalesce(d.author_id, '') AS last_author, coalesce(d.body, '') AS last_body
FROM tickets LEFT JOIN (SELECT ticket_id AS tk, arg_max(author_id, (_ord, message_id)) AS author_id, arg_max(body, (_ord, message_id)) AS body
  FROM ticket_messages GROUP BY ticket_id) d ON tickets.ticket_id = d.tk""")
def _(r):
    order = F.struct("_ord", "message_id")
    return R.lookup_join(r["tickets"], r["ticket_messages"], "ticket_id", "ticket_id",
                         {"last_author": "author_id", "last_body": "body"}, order=order).select(
        "ticket_id", "title", "last_author", "last_body")


@query("nest_children", """
SELECT c.customer_id, coalesce(t.n, 0) AS n_tickets, coalesce(t.tickets, '') AS tickets FROM customers c LEFT JOIN (
  SELECT customer_id, count(*) AS n, string_agg(concat_ws(' - ', ticket_id, status), '|' ORDER BY _ord) AS tickets
  FROM tickets GROUP BY customer_id) t ON c.customer_id = t.customer_id""")
def _(r):
    nested = R.nest_children(r["tickets"], "customer_id", dashed("ticket_id", "status"))
    return r["customers"].select("customer_id").join(nested, "customer_id", "left").select(
        "customer_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_tickets"),
        F.coalesce(joined("items"), F.lit("")).alias("tickets"))


SHARED["issue_links"] = """
SELECT issue_id, _ord, trim(x.v) AS tk, x.p FROM (
  SELECT issue_id, _ord, unnest(list_transform(string_split(linked_ticket_ids, '|'), lambda v, i: {'v': v, 'p': i})) AS x FROM github_issues)
WHERE trim(x.v) <> ''"""


@query("array_link_join", """
SELECT issue_id, string_agg(concat_ws(' - ', tickets.ticket_id, title), '|' ORDER BY p) AS linked
FROM issue_links JOIN tickets ON tk = ticket_id GROUP BY issue_id""")
def _(r):
    out = R.array_link_join(r["github_issues"], "issue_id", pipe_list("linked_ticket_ids"), r["tickets"],
                            "ticket_id", dashed("ticket_id", "title"))
    return out.select("issue_id", joined("linked").alias("linked"))


@query("contains_join", """
SELECT query_id, ticket_id, count(*) AS hits FROM (
  SELECT DISTINCT query_id, ticket_id, f, v FROM (SELECT query_id, lower(query) AS q FROM questions) qq
  JOIN (SELECT ticket_id, unnest([ {'f': 1, 'v': lower(ticket_id)}, {'f': 2, 'v': lower(customer_id)}, {'f': 3, 'v': lower(product_id)},
     {'f': 4, 'v': lower(service_id)}, {'f': 5, 'v': lower(title)} ], recursive := true) FROM tickets) tt ON v <> '' AND contains(q, v))
GROUP BY query_id, ticket_id""")
def _(r):
    values = F.array(*[F.lower(sval(c)) for c in ["ticket_id", "customer_id", "product_id", "service_id", "title"]])
    pairs = R.contains_join(r["questions"], "query_id", "query", r["tickets"], "ticket_id", values)
    return pairs.groupBy("query_id", "ticket_id").agg(F.count("*").alias("hits"))


@query("manifest_enrich", """
SELECT CASE WHEN page_id % 5 = 0 THEN concat('files/', page_id) ELSE url END AS page_url,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS m_url, CASE WHEN page_id % 3 = 0 THEN concat('page_', page_id) ELSE concat('Page ', page_id) END AS title
FROM pages""")
def _(r):
    from ..operators.corpus import enrich_from_manifest
    pages = r["pages"].withColumn("file_name", F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")))
    manifest = pages.where("page_id % 3 <> 0").select(
        "file_name", "url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.lit("2024").alias("fetched_at"), F.col("page_id").alias("_ord"))
    own = pages.select("page_id", "file_name", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("files/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("page_url"))
    df = enrich_from_manifest(own, manifest)
    stem = F.regexp_replace("file_name", "\\.html$", "")
    return df.select("page_url", "m_url", F.when(F.col("m_title") == "", stem).otherwise(F.col("m_title")).alias("title"))


# -- projections and filters ----------------------------------------------------------

@query("entity_metadata", """
SELECT 'ticket_message' AS source_type, message_id AS entity_id, coalesce(nullif(message_type, ''), '') AS title,
  CASE WHEN author_type = 'customer' AND author_id <> '' THEN author_id ELSE '' END AS customer_id, ticket_id FROM ticket_messages""")
def _(r):
    df = D.with_metadata(r["ticket_messages"], "ticket_message", ["message_id"], ["message_type"])
    return df.select("metadata.source_type", "metadata.entity_id", *[
        F.coalesce(f"metadata.{c}", F.lit("")).alias(c) for c in ["title", "customer_id", "ticket_id"]])


# -- validation -----------------------------------------------------------------------

@query("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in
    ["customers", "accounts", "products", "tickets", "ticket_messages", "ticket_resolutions", "service_catalog",
     "github_issues", "risk_events", "knowledge_base_docs"]))
def _(r):
    return Q.table_counts(r.support())


_LINED = "SELECT l_orderkey * 10000 + l_partkey AS _ord, concat('tkt_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS line_id FROM lineitem"
SHARED["line_ids"] = _LINED


@query("check_unique", """
SELECT 'lines' AS table_name, line, 'duplicate_key' AS rule,
  concat('lines:', line, ': duplicate line_id ''', line_id, ''' (first seen on line ', f, ')') AS message FROM (
  SELECT line_id, _ord AS line, min(_ord) OVER (PARTITION BY line_id) AS f FROM line_ids) WHERE line > f""")
def _(r):
    lines = r["lineitem"].select(
        (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("_ord"),
        F.concat(F.lit("tkt_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("line_id"))
    return Q.check_unique(lines, "lines", "line_id")


def _fk_sql(src, col, dst, key, blank=True):
    blank_part = f"""SELECT '{src}' AS table_name, CAST(_ord AS BIGINT) AS line, 'blank_fk' AS rule,
  concat('{src}:', _ord, ': missing foreign key {col}') AS message FROM {src} WHERE trim({col}) = '' UNION ALL """ if blank else ""
    return blank_part + f"""SELECT '{src}' AS table_name, CAST(_ord AS BIGINT) AS line, 'dangling_fk' AS rule,
  concat('{src}:', _ord, ': invalid foreign key {col}=''', trim({col}), ''' -> {dst}.{key}') AS message
  FROM {src} WHERE {"trim(" + col + ") <> '' AND " if blank else ""} trim({col}) NOT IN (SELECT trim({key}) FROM {dst} WHERE trim({key}) <> '')"""


@query("check_fk", _fk_sql("tickets", "product_id", "products", "product_id") + " UNION ALL "
       + _fk_sql("ticket_resolutions", "linked_policy_id", "knowledge_base_docs", "policy_id"))
def _(r):
    a = Q.check_fk(r["tickets"], "tickets", "product_id", r["products"], "products", "product_id")
    b = Q.check_fk(r["ticket_resolutions"], "ticket_resolutions", "linked_policy_id", r["knowledge_base_docs"],
                   "knowledge_base_docs", "policy_id")
    return a.unionByName(b)


@query("check_array_fk", """
SELECT 'github_issues' AS table_name, _ord AS line, 'dangling_list_id' AS rule,
  concat('github_issues:', _ord, ': invalid linked_ticket_ids value ''', tk, '''') AS message
FROM issue_links WHERE tk NOT IN (SELECT ticket_id FROM tickets)""")
def _(r):
    return Q.check_array_fk(r["github_issues"], "github_issues", "linked_ticket_ids", r["tickets"], "ticket_id")


@query("check_corpus", f"""
SELECT 'tickets' AS table_name, _ord AS line, 'empty_document' AS rule, concat('tickets:', ticket_id, ': empty content') AS message
FROM tickets WHERE trim(tags) = '' UNION ALL
SELECT 'tickets', 0, 'missing_document', concat('tickets: missing id ', tk) FROM (SELECT DISTINCT tk FROM issue_links)
WHERE tk NOT IN (SELECT ticket_id FROM tickets)""")
def _(r):
    expected = R.explode_ids(r["github_issues"], [], "linked_ticket_ids", "tk").distinct()
    return Q.check_corpus(r["tickets"], "tickets", "ticket_id", "tags", expected)


def _spec_sql(spec, views):
    """One statement for each rule of a domain; ``views`` names the view of a table where it is not the table's own."""
    parts = []
    for t in spec.tables:
        view, text = views.get(t.name, t.name), f"SELECT '{spec.name}' AS domain, '{t.name}' AS table_name, CAST(_ord AS BIGINT) AS line, "
        at = f"concat('{t.name}:', _ord, ': "
        parts.append(f"{text}'blank_key' AS rule, {at}missing {t.key}') AS message FROM {view} WHERE trim({t.key}) = ''")
        parts.append(f"""{text}'duplicate_key', {at}duplicate {t.key} ''', {t.key}, ''' (first seen on line ', f, ')')
  FROM (SELECT _ord, {t.key}, min(_ord) OVER (PARTITION BY {t.key}) AS f FROM {view}) WHERE _ord > f""")
        for col, dst, key in t.foreign_keys:
            if spec.report_blank_fk:
                parts.append(f"{text}'blank_fk', {at}missing foreign key {col}') FROM {view} WHERE trim({col}) = ''")
            parts.append(f"""{text}'dangling_fk', {at}invalid foreign key {col}=''', trim({col}), ''' -> {dst}.{key}') FROM {view}
  WHERE {f"trim({col}) <> '' AND " if spec.report_blank_fk else ""}trim({col}) NOT IN (SELECT trim({key}) FROM {views.get(dst, dst)} WHERE trim({key}) <> '')""")
        for col, dst, key in t.list_keys:
            parts.append(f"""{text}'dangling_list_id', {at}invalid {col} value ''', v, '''') FROM (SELECT _ord, trim(unnest(string_split({col}, '|'))) AS v FROM {view})
  WHERE v <> '' AND v NOT IN (SELECT trim({key}) FROM {views.get(dst, dst)})""")
        if t.text:
            parts.append(f"{text}'empty_document', concat('{t.name}:', {t.key}, ': empty content') FROM {view} WHERE trim({t.text}) = ''")
    return " UNION ALL ".join(parts)


@query("validation_report", _spec_sql(SUPPORT, {}) + " UNION ALL " + _spec_sql(BANKING, BANKING_TABLES))
def _(r):
    both = [(SUPPORT, r.support()), (BANKING, r.banking())]
    parts = [Q.validation_report(tables, spec).select(F.lit(spec.name).alias("domain"), "*") for spec, tables in both]
    return parts[0].unionByName(parts[1])


@query("dup_document_ids", """
SELECT concat('enterprise_support::line::', line_id) AS id, count(*) AS copies FROM line_ids GROUP BY line_id HAVING count(*) > 1""")
def _(r):
    docs = r["lineitem"].select(F.concat(F.lit("enterprise_support::line::tkt_"), F.col("l_orderkey").cast("string"),
                                         F.lit("_"), F.col("l_linenumber").cast("string")).alias("id"))
    return Q.duplicate_ids(docs)


# -- documents ------------------------------------------------------------------------

_TS = "concat_ws(' - ', nullif(ticket_id, ''), nullif(title, ''), nullif(status, ''), nullif(priority, ''))"
_RS = "concat_ws(' - ', nullif(risk_event_id, ''), nullif(event_type, ''), nullif(severity, ''), nullif(summary, ''))"
_IS = "concat_ws(' - ', nullif(issue_id, ''), nullif(title, ''), nullif(state, ''), nullif(severity, ''))"
_MS = "concat(concat_ws(' | ', nullif(created_at, ''), nullif(author_type, ''), nullif(visibility, ''), nullif(message_type, '')), ': ', body)"
_FS = "concat_ws(' - ', nullif(resolution_id, ''), nullif(resolution_type, ''), nullif(summary, ''), nullif(customer_visible_response, ''))"


def _agg(value, table, key, name):
    return f"(SELECT {key} AS k_, string_agg(v_, ', ' ORDER BY _ord, v_) AS {name} FROM (SELECT {key}, _ord, {value} AS v_ FROM {table}) GROUP BY 1)"


@query("customer_documents", f"""
SELECT concat('enterprise_support::customer::', c.customer_id) AS id, c.full_name AS title, {lns('Customer Profile',
    ('Customer ID', 'c.customer_id'), ('Name', 'full_name'), ('Email', 'email'), ('Role', 'role'), ('Region', 'c.region'),
    ('Support tier', 'support_tier'), ('Preferred contact channel', 'preferred_contact_channel'), ('Account ID', 'c.account_id'),
    ('Account', 'a.account_name'), ('Account segment', 'a.segment'), ('Account risk level', 'a.risk_level'),
    ('Account health score', 'a.health_score'), ('Related tickets', 't.tk'), ('Risk events', 'x.rk'))} AS text
FROM customers c LEFT JOIN accounts a ON c.account_id = a.account_id
LEFT JOIN {_agg(_TS, 'tickets', 'customer_id', 'tk')} t ON c.customer_id = t.k_
LEFT JOIN {_agg(_RS, 'risk_events', 'customer_id', 'rk')} x ON c.customer_id = x.k_""")
def _(r):
    return D.customer_documents(r.support("customers", "accounts", "tickets", "risk_events"), unique=True).select("id", "metadata.title", "text")


SHARED["ticket_docs"] = f"""
SELECT concat('enterprise_support::ticket::', t.ticket_id) AS id, t.title, {lns('Support Ticket',
    ('Ticket ID', 't.ticket_id'), ('Title', 't.title'), ('Description', 't.description'), ('Category', 'category'), ('Priority', 't.priority'),
    ('Severity', 't.severity'), ('Status', 't.status'), ('SLA status', 'sla_status'), ('Created at', 't.created_at'), ('Updated at', 'updated_at'),
    ('First response due at', 'first_response_due_at'), ('Resolution due at', 'resolution_due_at'), ('Assigned team', 'assigned_team'),
    ('Assignee', 'assignee'), ('Tags', 'tags'), ('Customer', 'c.full_name'), ('Customer role', 'c.role'), ('Customer support tier', 'c.support_tier'),
    ('Account', 'a.account_name'), ('Account risk level', 'a.risk_level'), ('Product', 'p.product_name'), ('Product family', 'p.product_family'),
    ('Service', 's.service_name'), ('Service owner team', 's.owner_team'), ('Support escalation team', 's.support_escalation_team'),
    ('Messages', 'm.ms'), ('Resolutions', 'f.fs'), ('Related engineering issues', 'i.iss'), ('Risk events', 'x.rk'))} AS text
FROM tickets t LEFT JOIN customers c ON t.customer_id = c.customer_id LEFT JOIN accounts a ON t.account_id = a.account_id
LEFT JOIN products p ON t.product_id = p.product_id LEFT JOIN service_catalog s ON t.service_id = s.service_id
LEFT JOIN {_agg(_MS, 'ticket_messages', 'ticket_id', 'ms')} m ON t.ticket_id = m.k_
LEFT JOIN {_agg(_FS, 'ticket_resolutions', 'ticket_id', 'fs')} f ON t.ticket_id = f.k_
LEFT JOIN (SELECT tk AS k_, string_agg({_IS}, ', ' ORDER BY github_issues._ord) AS iss FROM issue_links JOIN github_issues USING (issue_id) GROUP BY 1) i ON t.ticket_id = i.k_
LEFT JOIN {_agg(_RS, 'risk_events', 'ticket_id', 'rk')} x ON t.ticket_id = x.k_"""


@query("ticket_documents", "SELECT id, title, text FROM ticket_docs")
def _(r):
    return D.ticket_documents(r.support(), unique=True).select("id", "metadata.title", "text")


SHARED["service_docs"] = f"""
SELECT concat('enterprise_support::service::', s.service_id) AS id, service_name AS title, {lns('Service Catalog Entry',
    ('Service ID', 's.service_id'), ('Service', 'service_name'), ('Description', 'description'), ('Product', 'p.product_name'),
    ('Product ID', 's.product_id'), ('Owner team', 'owner_team'), ('Support escalation team', 'support_escalation_team'), ('Tier', 'tier'),
    ('Slack channel', 'slack_channel'), ('Runbook policy ID', 'runbook_policy_id'), ('On-call rotation', 'on_call_rotation'), ('Repository', 'repo'),
    ('Status', 'status'), ('Related tickets', 't.tk'), ('Related engineering issues', 'i.iss'), ('Risk events', 'x.rk'))} AS text
FROM service_catalog s LEFT JOIN products p ON s.product_id = p.product_id
LEFT JOIN {_agg(_TS, 'tickets', 'service_id', 'tk')} t ON s.service_id = t.k_
LEFT JOIN {_agg(_IS, 'github_issues', 'service_id', 'iss')} i ON s.service_id = i.k_
LEFT JOIN {_agg(_RS, 'risk_events', 'service_id', 'rk')} x ON s.service_id = x.k_"""


@query("service_documents", "SELECT id, title, text FROM service_docs")
def _(r):
    return D.service_documents(r.support(), unique=True).select("id", "metadata.title", "text")


SHARED["risk_docs"] = f"""
SELECT concat('enterprise_support::risk_event::', r.risk_event_id) AS id, r.summary AS title, {lns('Risk Event',
    ('Risk event ID', 'r.risk_event_id'), ('Event type', 'event_type'), ('Severity', 'r.severity'), ('Risk score', 'risk_score'),
    ('Detected at', 'detected_at'), ('Status', 'r.status'), ('Source', 'source'), ('Summary', 'summary'), ('Recommended action', 'recommended_action'),
    ('Evidence references', 'evidence_refs'), ('Customer', 'c.full_name'), ('Account', 'a.account_name'), ('Ticket', 't.ts'),
    ('Product', 'p.product_name'), ('Service', 's.service_name'))} AS text
FROM risk_events r LEFT JOIN customers c ON r.customer_id = c.customer_id LEFT JOIN accounts a ON r.account_id = a.account_id
LEFT JOIN products p ON r.product_id = p.product_id LEFT JOIN service_catalog s ON r.service_id = s.service_id
LEFT JOIN (SELECT ticket_id, {_TS} AS ts FROM tickets) t ON r.ticket_id = t.ticket_id"""


@query("risk_documents", "SELECT id, title, text FROM risk_docs")
def _(r):
    return D.risk_documents(r.support(), unique=True).select("id", "metadata.title", "text")


SHARED["issue_docs"] = f"""
SELECT concat('enterprise_support::github_issue::', i.issue_id) AS id, i.title, {lns('Engineering GitHub Issue',
    ('Issue ID', 'i.issue_id'), ('Repository', 'i.repo'), ('Number', 'number'), ('Title', 'i.title'), ('State', 'state'), ('Severity', 'severity'),
    ('Labels', "replace(labels, '|', ', ')"), ('Product', 'p.product_name'), ('Service', 's.service_name'), ('Assignee team', 'assignee_team'),
    ('Created at', 'i.created_at'), ('Updated at', 'updated_at'), ('Closed at', 'closed_at'), ('Body', "trim(body, ' ' || chr(9) || chr(10) || chr(13))"),
    ('Linked tickets', 'l.lk'), ('Resolution summary', 'resolution_summary'))} AS text
FROM github_issues i LEFT JOIN products p ON i.product_id = p.product_id LEFT JOIN service_catalog s ON i.service_id = s.service_id
LEFT JOIN (SELECT issue_id, string_agg(ts, ', ' ORDER BY p) AS lk FROM issue_links JOIN (SELECT ticket_id, {_TS} AS ts FROM tickets) ON tk = ticket_id GROUP BY 1) l
  ON i.issue_id = l.issue_id"""


@query("issue_documents", "SELECT id, title, text FROM issue_docs")
def _(r):
    return D.issue_documents(r.support(), unique=True).select("id", "metadata.title", "text")


@query("knowledge_base_documents", f"""
SELECT concat('enterprise_support::knowledge_base::', policy_id) AS id, title, {lns('Knowledge Base Article',
    ('Policy ID', 'policy_id'), ('Title', 'title'), ('Policy type', 'policy_type'), ('Owner team', 'owner_team'), ('Product ID', 'product_id'),
    ('Service ID', 'service_id'), ('Effective date', 'effective_date'), ('Review date', 'review_date'), ('Tags', "'sla, support'"),
    ('Summary', 'summary'), ('Content', "trim(content, ' ' || chr(9) || chr(10) || chr(13))"))} AS text FROM knowledge_base_docs""")
def _(r):
    return D.knowledge_base_documents(r.support("knowledge_base_docs")).select("id", "metadata.title", "text")


@query("documents_by_type", """
SELECT source, source_type, count(*) AS documents FROM (
  SELECT 'enterprise_support' AS source, 'customer' AS source_type FROM customers UNION ALL SELECT 'enterprise_support', 'ticket' FROM tickets
  UNION ALL SELECT 'enterprise_support', 'knowledge_base' FROM knowledge_base_docs UNION ALL SELECT 'enterprise_support', 'service' FROM service_catalog
  UNION ALL SELECT 'enterprise_support', 'github_issue' FROM github_issues UNION ALL SELECT 'enterprise_support', 'risk_event' FROM risk_events
  UNION ALL SELECT 'banking_fraud', 'customer' FROM banking_customers UNION ALL SELECT 'banking_fraud', 'account' FROM banking_accounts
  UNION ALL SELECT 'banking_fraud', 'transaction' FROM banking_transactions UNION ALL SELECT 'banking_fraud', 'merchant' FROM banking_merchants
  UNION ALL SELECT 'banking_fraud', 'fraud_alert' FROM banking_alerts UNION ALL SELECT 'banking_fraud', 'aml_case' FROM banking_cases
  UNION ALL SELECT 'banking_fraud', 'policy' FROM banking_policies) GROUP BY 1, 2""")
def _(r):
    docs = D.build_documents(K.SUPPORT_DOMAIN, r.support(), True).unionByName(
        D.build_documents(K.BANKING_DOMAIN, r.banking(), True))
    return docs.groupBy("metadata.source", "metadata.source_type").agg(F.count("*").alias("documents"))


_TX = "concat(t.transaction_id, ' - ', amount_usd, ' ', currency, ' - ', transaction_type, ' - ', coalesce(m.merchant_name, ''), ' - ', t.status)"


@query("banking_documents", f"""
SELECT concat('banking_fraud::customer::', c.customer_id) AS id, {lns('Banking Customer', ('Customer ID', 'c.customer_id'), ('Name', 'full_name'),
    ('Segment', 'c.segment'), ('Region', 'c.region'), ('Risk tier', 'risk_tier'), ('KYC status', 'kyc_status'), ('Accounts', 'ac'),
    ('Recent transactions', 'tx'), ('Fraud alerts', 'al'), ('AML cases', 'cs'))} AS text FROM banking_customers c
LEFT JOIN {_agg("concat_ws(' - ', account_id, account_type, status)", 'banking_accounts', 'customer_id', 'ac')} a ON c.customer_id = a.k_
LEFT JOIN {_agg(_TX, '(SELECT t.*, merchant_name FROM banking_transactions t LEFT JOIN banking_merchants m ON t.merchant_id = m.merchant_id) t', 'customer_id', 'tx').replace('m.merchant_name', 'merchant_name')} t ON c.customer_id = t.k_
LEFT JOIN {_agg("concat_ws(' - ', alert_id, alert_type, severity)", 'banking_alerts', 'customer_id', 'al')} l ON c.customer_id = l.k_
LEFT JOIN {_agg("concat_ws(' - ', case_id, case_type, status)", 'banking_cases', 'customer_id', 'cs')} s ON c.customer_id = s.k_
UNION ALL
SELECT concat('banking_fraud::account::', account_id), {lns('Banking Account', ('Account ID', 'account_id'), ('Customer ID', 'customer_id'),
    ('Type', 'account_type'), ('Status', 'status'), ('Balance USD', 'balance_usd'), ('Online banking enabled', 'online_banking_enabled'))} FROM banking_accounts
UNION ALL
SELECT concat('banking_fraud::transaction::', transaction_id), {lns('Banking Transaction', ('Transaction ID', 'transaction_id'), ('Customer ID', 'customer_id'),
    ('Account ID', 'account_id'), ('Merchant', 'merchant_name'), ('Merchant risk', 'risk_level'), ('Amount USD', 'amount_usd'), ('Type', 'transaction_type'),
    ('Channel', 'channel'), ('Country', 't.country'), ('IP country', 'ip_country'), ('Status', 'status'), ('Created at', 'created_at'))}
FROM banking_transactions t LEFT JOIN banking_merchants m ON t.merchant_id = m.merchant_id
UNION ALL
SELECT concat('banking_fraud::merchant::', merchant_id), {lns('Banking Merchant', ('Merchant ID', 'merchant_id'), ('Name', 'merchant_name'),
    ('Category', 'category'), ('Country', 'country'), ('Risk level', 'risk_level'))} FROM banking_merchants
UNION ALL
SELECT concat('banking_fraud::policy::', policy_id), concat_ws(chr(10), 'Banking Fraud Policy', concat('Policy ID: ', policy_id), concat('Title: ', title),
    concat('Path: ', path), nullif(trim(content, ' ' || chr(9) || chr(10) || chr(13)), '')) FROM banking_policies
UNION ALL
SELECT concat('banking_fraud::fraud_alert::', a.alert_id), {lns('Fraud Alert', ('Alert ID', 'a.alert_id'), ('Alert type', 'alert_type'),
    ('Severity', 'severity'), ('Status', 'a.status'), ('Rule', 'rule_name'), ('Summary', 'summary'), ('Recommended action', 'recommended_action'),
    ('Transaction', 'x.tx'))} FROM banking_alerts a
LEFT JOIN (SELECT t.transaction_id, {_TX} AS tx FROM banking_transactions t LEFT JOIN banking_merchants m ON t.merchant_id = m.merchant_id) x ON a.transaction_id = x.transaction_id
UNION ALL
SELECT concat('banking_fraud::aml_case::', c.case_id), {lns('AML Case', ('Case ID', 'c.case_id'), ('Customer ID', 'customer_id'), ('Account ID', 'account_id'),
    ('Case type', 'case_type'), ('Priority', 'priority'), ('Status', 'status'), ('Summary', 'summary'), ('Linked alerts', "replace(linked_alert_ids, '|', ', ')"),
    ('Alert summaries', 'l.ls'), ('Recommended action', 'recommended_action'))} FROM banking_cases c
LEFT JOIN (SELECT case_id, string_agg(b.summary, ', ' ORDER BY x.p) AS ls FROM (SELECT case_id, unnest(list_transform(string_split(linked_alert_ids, '|'),
    lambda v, i: {{'v': v, 'p': i}})) AS x FROM banking_cases) JOIN banking_alerts b ON x.v = b.alert_id GROUP BY 1) l ON c.case_id = l.case_id""")
def _(r):
    return D.build_documents(K.BANKING_DOMAIN, r.banking(), True).select("id", "text")


_CLEAN = ["(?s)\\A---\\s*\\n.*?\\n---\\s*\\n?", "(?s)\\{%\\s*data.*?%\\}", "(?s)\\{%\\s*.*?%\\}", "(?s)\\{\\{.*?\\}\\}", "(?s)<!--.*?-->"]


def clean_sql(expr):
    for i, p in enumerate(_CLEAN):
        expr = f"regexp_replace({expr}, '{p}', '{'' if i == 0 else ' '}', 'g')"
    for p, to in [("\\[AUTOTITLE\\]\\((.*?)\\)", "\\1"), ("\\[([^\\]]+)\\]\\(([^)]+)\\)", "\\1"), ("[ \\t]{2,}", " ")]:
        expr = f"regexp_replace({expr}, '{p}', '{to}', 'g')"
    expr = f"regexp_replace({expr}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    expr = f"replace(replace({expr}, chr(8203), ' '), '  ' || chr(10), chr(10))"
    return f"trim(replace({expr}, '****', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SHARED["record_docs"] = f"""
SELECT 'document' AS source_type, doc_id, title, url, source, path, {clean_sql(f"concat_ws(chr(10) || chr(10), concat('Title: ', title), nullif(trim(text, {WS}), ''))")} AS text FROM corpus
UNION ALL
SELECT 'ticket', id, trim(title), html_url, source, id, {clean_sql(f"concat_ws(chr(10) || chr(10), concat('Ticket ID: ', id), concat('Title: ', title), concat('Labels: ', lang, ', ', source), concat('Body:' || chr(10), nullif(trim(body, {WS}), '')))")} FROM raw_issues"""


def _records(r):
    issues = r["raw_issues"].select("id", "title", "body", "html_url", "source", F.array("lang", "source").alias("labels"))
    corpus = r["corpus"].select("doc_id", "title", "text", "url", "source", "path")
    return corpus, issues


SHARED["record_docs_fixed"] = """
SELECT source_type, doc_id, title, CASE WHEN url = '' AND source = 'github_docs' THEN 'https://docs.github.com/en/' || path ELSE url END AS url, source,
  CASE WHEN path = '' THEN regexp_replace(doc_id, '^.*?::', '') ELSE path END AS path, text FROM record_docs"""


@query("record_documents", "SELECT source_type, doc_id, title, url, source, path, text FROM record_docs_fixed")
def _(r):
    corpus, issues = _records(r)
    docs = D.records_to_documents(corpus, "document").unionByName(D.records_to_documents(issues, "ticket"))
    return docs.select("metadata.*", "text")


@query("rag_corpus", "SELECT source_type, source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM record_docs_fixed WHERE trim(text) <> '' GROUP BY 1, 2")
def _(r):
    corpus, issues = _records(r)
    return D.rag_corpus(corpus, issues).groupBy("metadata.source_type", "metadata.source").agg(
        F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query("source_type_counts", "SELECT source_type, count(*) AS documents, CAST(sum(length(substr(text, 1, 500))) AS BIGINT) AS preview_chars FROM corpus GROUP BY 1")
def _(r):
    return r["corpus"].groupBy("source_type").agg(F.count("*").alias("documents"),
                                                  F.sum(F.length(F.substring("text", 1, 500))).alias("preview_chars"))


# -- index upsert ---------------------------------------------------------------------

SHARED["index_rows"] = f"""
SELECT concat('line::', CAST(l_orderkey AS STRING), '::', CAST(l_linenumber AS STRING)) AS key, l_partkey AS ord, l_suppkey AS sup, l_quantity AS q, l_returnflag AS flag, concat('Line of order ', CAST(l_orderkey AS STRING),
  ' holds the part ', CAST(l_partkey AS STRING), ' and was shipped by the supplier ', CAST(l_suppkey AS STRING)) AS text FROM lineitem"""


@query("index_upsert", """
SELECT key AS source_chunk_id, text, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)), substr(h, 19, 2), '-', substr(h, 21, 12)) AS point_id FROM (
  SELECT key, arg_max(text, (ord, sup, q)) AS text, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(key)) AS h FROM index_rows GROUP BY key)""")
def _(r):
    return upsert_rows(_lines(r["lineitem"])).select("source_chunk_id", "text", "point_id")


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.concat(F.lit("line::"), F.col("l_orderkey").cast("string"), F.lit("::"), F.col("l_linenumber").cast("string")).alias("doc_id"),
        F.struct("l_partkey", "l_suppkey", "l_quantity").alias("_ord"), F.concat(F.lit("Line of order "), F.col("l_orderkey").cast("string"), F.lit(" holds the part "),
                 F.col("l_partkey").cast("string"), F.lit(" and was shipped by the supplier "), F.col("l_suppkey").cast("string")).alias("text"))


@query("index_merge", """
SELECT key AS source_chunk_id, concat(arg_max(text, (back, ord, sup, q)), CASE WHEN max(back) = 1 THEN ' and came back' ELSE '' END) AS text
FROM (SELECT key, ord, sup, q, text, 0 AS back FROM index_rows
  UNION ALL SELECT key, ord, sup, q, text, 1 AS back FROM index_rows WHERE flag = 'R') GROUP BY key""")
def _(r):
    """All lines are written, then those that came back once more with another text."""
    lines, path = r["lineitem"], new_folder(r["lineitem"].sparkSession, "index")
    upsert_index(_lines(lines), path)
    back = _lines(lines.where("l_returnflag = 'R'")).withColumn("text", F.concat("text", F.lit(" and came back")))
    return upsert_index(back, path).select("source_chunk_id", "text")


# -- analytics ------------------------------------------------------------------------

@query("customer_summary", f"""
SELECT c.customer_id, full_name AS customer_name, c.account_id, coalesce(a.account_name, '') AS account_name,
  concat(full_name, ' is a ', role, ' at ', coalesce(a.account_name, 'an unknown account'), ' with ', support_tier,
    ' support. The account risk level is ', coalesce(a.risk_level, 'unknown'), ' with health score ', coalesce(a.health_score, 'unknown'),
    '. There are ', coalesce(t.act, 0), ' active tickets and ', coalesce(r.act, 0), ' active risk events in the synthetic dataset.') AS summary,
  coalesce(t.n, 0) AS ticket_count, coalesce(t.act, 0) AS active_ticket_count, coalesce(r.n, 0) AS risk_event_count,
  coalesce(r.act, 0) AS active_risk_event_count, coalesce(r.hi, 0) AS high_risk_event_count
FROM customers c LEFT JOIN accounts a ON c.account_id = a.account_id
LEFT JOIN (SELECT customer_id, count(*) n, count(*) FILTER (status IN ('open', 'pending_customer', 'pending_engineering')) act FROM tickets GROUP BY 1) t ON c.customer_id = t.customer_id
LEFT JOIN (SELECT customer_id, count(*) n, count(*) FILTER (status NOT IN ('closed', 'mitigated')) act,
   count(*) FILTER (severity IN ('high', 'critical') OR CAST(risk_score AS INT) >= 70) hi FROM risk_events GROUP BY 1) r ON c.customer_id = r.customer_id""")
def _(r):
    return S.customer_summaries(r["customers"], r["accounts"], r["tickets"], r["risk_events"], unique=True)


SHARED["triage0"] = """
SELECT *, (priority = 'p1' OR severity = 'sev1') AS top_, (category IN ('incident', 'security') OR severity = 'sev2') AS serious,
  sla_status IN ('at_risk', 'breached') AS bad FROM tickets"""
SHARED["triage1"] = """
SELECT *, CASE WHEN (serious OR bad) AND p0 IN ('p3', 'p4') THEN 'p2' ELSE p0 END AS rp FROM (
  SELECT *, CASE WHEN top_ THEN 'p1' WHEN priority = '' THEN 'p4' ELSE priority END AS p0 FROM triage0)"""
SHARED["triage2"] = """
SELECT *, (bad OR rp = 'p1' OR (rp = 'p2' AND status IN ('open', 'pending_engineering'))) AS esc FROM triage1"""


@query("triage_tickets", """
SELECT ticket_id, priority AS current_priority, rp AS recommended_priority, status AS current_status,
  CASE WHEN esc AND status NOT IN ('resolved', 'closed') THEN 'pending_engineering' ELSE status END AS recommended_status, esc AS escalation_required,
  coalesce(nullif(concat_ws('|', CASE WHEN top_ THEN 'Ticket is already marked P1 or Sev1.' END,
    CASE WHEN serious THEN 'Incident, security, or Sev2 tickets should be at least P2.' END,
    CASE WHEN bad THEN concat('SLA status is ', sla_status, ', so escalation should be considered.') END,
    CASE WHEN status = 'pending_engineering' THEN 'Ticket is already waiting on engineering.' END), ''),
    'No high-risk signal was found; keep the current ticket handling.') AS reasons,
  coalesce(p.product_name, '') AS product_name, coalesce(s.service_name, '') AS service_name, coalesce(s.owner_team, '') AS owner_team
FROM triage2 t LEFT JOIN products p ON t.product_id = p.product_id LEFT JOIN (SELECT service_id, service_name, owner_team FROM service_catalog) s ON t.service_id = s.service_id""")
def _(r):
    return S.triage_tickets(r["tickets"], r["products"], r["service_catalog"], unique=True).withColumn("reasons", joined("reasons"))


@query("sla_checks", """
SELECT ticket_id, priority, status, sla_status, first_response_due_at, resolution_due_at, esc AS escalation_required,
  CASE WHEN esc THEN 'Escalate to the owning support and engineering teams.' ELSE 'No immediate SLA escalation is required based on current ticket fields.' END AS recommendation,
  concat_ws('|', concat('Ticket SLA status is ', coalesce(nullif(sla_status, ''), 'unknown'), '.'),
    CASE WHEN p1o THEN 'Open P1 tickets require active escalation under the SLA policy.' END,
    CASE WHEN priority = 'p2' AND status = 'pending_engineering' THEN 'P2 tickets waiting on engineering should be monitored for escalation.' END) AS reasons
FROM (SELECT *, p1o OR sla_status IN ('at_risk', 'breached') AS esc FROM (SELECT *, priority = 'p1' AND status NOT IN ('resolved', 'closed') AS p1o FROM tickets))""")
def _(r):
    return S.sla_checks(r["tickets"]).withColumn("reasons", joined("reasons"))


SHARED["ticket_hay"] = """SELECT ticket_id, _ord, lower(concat_ws(' ', title, description, category, priority, severity, sla_status, tags, product_id, service_id)) AS hay FROM tickets"""
SHARED["rule_hits"] = " UNION ALL ".join(
    f"SELECT ticket_id, _ord, {i} AS rn, '{p}' AS policy_id FROM ticket_hay WHERE {any_term('hay', ws)}" for i, (p, ws) in enumerate(K.POLICY_RULES))


@query("policy_rules", """
SELECT t.ticket_id, coalesce(string_agg(policy_id, '|' ORDER BY rn), 'pol_enterprise_support') AS policies FROM tickets t
LEFT JOIN rule_hits h ON t.ticket_id = h.ticket_id GROUP BY t.ticket_id""")
def _(r):
    return r["tickets"].withColumn("_hay", S.ticket_haystack()).select(
        "ticket_id", joined(S.policy_ids(F.col("_hay"), fallback=True)).alias("policies"))


@query("draft_replies", """
SELECT t.ticket_id, concat_ws(chr(10) || chr(10), concat('Hi ', coalesce(nullif(split_part(coalesce(c.full_name, ''), ' ', 1), ''), 'there'), ','),
    concat('Thanks for contacting us about ', t.title, '. We see this affects ', coalesce(p.product_name, 'the product'), ' and ', coalesce(s.service_name, 'the related service'), '.'),
    CASE WHEN m.body IS NOT NULL THEN concat('Based on your latest update, we are tracking: ', m.body, '.') END,
    CASE WHEN f.ticket_id IS NOT NULL THEN nullif(f.customer_visible_response, '') WHEN t.esc THEN 'This has been flagged for escalation based on priority, status, and SLA signals.'
      ELSE 'We are continuing the investigation and will follow up with the next concrete finding.' END,
    CASE WHEN h.titles IS NOT NULL THEN concat('We are using the relevant support guidance: ', h.titles, '.') END,
    'We will keep the response customer-safe and avoid exposing internal notes.') AS draft_reply, coalesce(h.pids, '') AS used_policy_ids
FROM triage2 t LEFT JOIN customers c ON t.customer_id = c.customer_id LEFT JOIN products p ON t.product_id = p.product_id
LEFT JOIN service_catalog s ON t.service_id = s.service_id
LEFT JOIN (SELECT ticket_id, arg_max(body, (_ord, body)) AS body FROM ticket_messages WHERE visibility = 'public' AND author_type = 'customer' GROUP BY 1) m ON t.ticket_id = m.ticket_id
LEFT JOIN ticket_resolutions f ON t.ticket_id = f.ticket_id
LEFT JOIN (SELECT x.ticket_id, string_agg(k.title, ', ' ORDER BY rn) AS titles, string_agg(k.policy_id, '|' ORDER BY rn) AS pids FROM (
    SELECT t.ticket_id, coalesce(rn, 0) AS rn, coalesce(policy_id, 'pol_enterprise_support') AS policy_id FROM tickets t LEFT JOIN rule_hits h ON t.ticket_id = h.ticket_id) x
  JOIN knowledge_base_docs k ON x.policy_id = k.policy_id GROUP BY 1) h ON t.ticket_id = h.ticket_id""")
def _(r):
    t = r.support()
    return S.draft_replies(t["tickets"], t["customers"], t["products"], t["service_catalog"], t["ticket_messages"],
                           t["ticket_resolutions"], t["knowledge_base_docs"], unique=True).withColumn("used_policy_ids", joined("used_policy_ids"))


# -- risk -----------------------------------------------------------------------------

_AT = "CAST(replace(replace({}, 'T', ' '), 'Z', '') AS TIMESTAMP)"
_TCOLS = ["ticket_id", "customer_id", "product_id", "service_id", "title", "description", "category", "priority", "severity", "status", "sla_status", "created_at", "updated_at", "tags"]
_RCOLS = ["risk_event_id", "account_id", "customer_id", "ticket_id", "product_id", "service_id", "event_type", "severity", "risk_score", "detected_at", "source", "summary", "evidence_refs", "recommended_action", "status"]
_ESC = "(sla_status IN ('at_risk', 'breached') OR status = 'pending_engineering' OR priority = 'p1')"
_SEV = "(severity IN ('high', 'critical'))"


def _terms(txt):
    return f"{any_term(txt, K.LOGIN_TERMS)} AS login, {any_term(txt, K.API_TERMS)} AS api, {any_term(txt, K.REFUND_TERMS)} AS refund"


SHARED["signals"] = f"""
SELECT customer_id, 'ticket' AS source_type, ticket_id AS entity_id, title, description AS summary, created_at, {_AT.format('created_at')} AS at_, _ord,
  greatest({_AT.format('created_at')}, {_AT.format('updated_at')}) AS seen, (priority = 'p1' OR severity = 'sev1' OR category = 'incident') AS critical,
  {_ESC} AS escalation, ({_ESC} OR contains(txt, 'frustrated') OR contains(txt, 'urgent') OR priority IN ('p1', 'p2')) AS negative, {_terms('txt')}
FROM (SELECT *, lower(concat_ws(' ', {', '.join(_TCOLS)})) AS txt FROM recent_tickets)
UNION ALL
SELECT customer_id, 'risk_event', risk_event_id, event_type, summary, detected_at, {_AT.format('detected_at')}, _ord, {_AT.format('detected_at')}, false,
  ({_SEV} OR event_type IN {in_list(K.ESCALATION_RISK_TYPES)}), ({_SEV} OR CAST(risk_score AS INT) >= 70 OR event_type IN {in_list(K.NEGATIVE_RISK_TYPES)}), {_terms('txt')}
FROM (SELECT *, lower(concat_ws(' ', {', '.join(_RCOLS)})) AS txt FROM risk_events)"""
SHARED["recent_signals"] = """
SELECT *, at_ >= anchor - INTERVAL 7 DAY AS week FROM (SELECT *, (SELECT max(seen) FROM signals) AS anchor FROM signals) WHERE at_ BETWEEN anchor - INTERVAL 30 DAY AND anchor"""
SHARED["features"] = """
SELECT c.customer_id, CAST(coalesce(f1, 0) AS DOUBLE) AS ticket_count_7d, CAST(coalesce(f2, 0) AS DOUBLE) AS critical_ticket_count_30d,
  CAST(coalesce(f3, 0) AS DOUBLE) AS escalation_count_30d, CAST(coalesce(f4, 0) AS DOUBLE) AS failed_login_count_7d, CAST(coalesce(f5, 0) AS DOUBLE) AS api_timeout_count_7d,
  CAST(coalesce(f6, 0) AS DOUBLE) AS refund_request_count_30d, CAST(coalesce(f7, 0) AS DOUBLE) AS negative_signal_count_30d
FROM customers c LEFT JOIN (SELECT customer_id, count(*) FILTER (source_type = 'ticket' AND week) f1, count(*) FILTER (critical) f2, count(*) FILTER (escalation) f3,
  count(*) FILTER (login AND week) f4, count(*) FILTER (api AND week) f5, count(*) FILTER (refund) f6, count(*) FILTER (negative) f7
  FROM recent_signals GROUP BY 1) s ON c.customer_id = s.customer_id"""
SHARED["baselines"] = "SELECT " + ", ".join(f"avg({f}) AS {f}_mean, max({f}) AS {f}_max" for f in K.FEATURES) + " FROM features"
_RAW = " + ".join(
    f"({f} / greatest({f}_max, 1.0) * {w} + CASE WHEN {f} > {f}_mean THEN ({f} - {f}_mean) / greatest(greatest({f}_max, 1.0) - {f}_mean, 1.0) * 3.0 ELSE 0.0 END)"
    for f, w in zip(K.FEATURES, K.FEATURE_WEIGHTS))


def _features(r):
    return RK.risk_features(r["customers"], r["recent_tickets"], r["risk_events"])


@query("risk_features", "SELECT * FROM features")
def _(r):
    return _features(r)


@query("feature_baselines", "SELECT " + ", ".join(f"round({f}_mean, 6) AS {f}_mean, {f}_max" for f in K.FEATURES) + " FROM baselines")
def _(r):
    b = RK.feature_baselines(_features(r))
    return b.select(*[x for f in K.FEATURES for x in (F.round(f"{f}_mean", 6).alias(f"{f}_mean"), f"{f}_max")])


SHARED["scored"] = f"SELECT features.*, least(100.0, greatest(0.0, {_RAW})) AS raw FROM features JOIN baselines ON true"


@query("risk_scores", """
SELECT customer_id, round(raw, 6) AS risk_score, CASE WHEN round(raw, 2) >= 80 THEN 'critical' WHEN round(raw, 2) >= 60 THEN 'high'
  WHEN round(raw, 2) >= 35 THEN 'medium' ELSE 'low' END AS risk_level FROM scored""")
def _(r):
    return RK.score_risk(_features(r)).select("customer_id", F.round("raw_score", 6).alias("risk_score"), "risk_level")


_UNPIVOT = " UNION ALL ".join(
    f"SELECT customer_id, {i} AS ix, '{f}' AS feature, {f} AS value, {w} AS weight, '{lab}' AS label, (SELECT {f}_mean FROM baselines) AS mean FROM features"
    for i, (f, w, lab) in enumerate(zip(K.FEATURES, K.FEATURE_WEIGHTS, K.FEATURE_LABELS)))
SHARED["long_features"] = _UNPIVOT


def _reason_sql(pick, text, default):
    return f"""
SELECT customer_id, position, reason FROM ({pick}) UNION ALL
SELECT customer_id, 1, '{default}' FROM features WHERE customer_id NOT IN (SELECT customer_id FROM ({pick}))""".replace("@TEXT", text)


@query("risk_reasons", _reason_sql(
    """SELECT customer_id, CAST(rn AS INT) AS position, @TEXT AS reason FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY value * weight DESC, ix) AS rn
  FROM long_features WHERE value > 0) WHERE rn <= 4""",
    "concat(label, ': ', CAST(value AS BIGINT), ' signal(s), weight ', CAST(weight AS INT))",
    "No recent risk feature signals were found for this customer."))
def _(r):
    return RK.risk_reasons(_features(r))


@query("risk_deviations", _reason_sql(
    """SELECT customer_id, CAST(rn AS INT) AS position, @TEXT AS reason FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY (value - mean) / greatest(mean, 1.0) DESC, value - mean DESC, feature DESC) AS rn FROM long_features WHERE value > 0 AND value > mean) WHERE rn <= 4""",
    "concat(label, ' is above cohort baseline: ', CAST(value AS BIGINT), ' signal(s) vs ', printf('%.2f', mean), ' average')",
    "No feature materially exceeds the synthetic cohort baseline."))
def _(r):
    return RK.deviation_reasons(_features(r))


@query("related_events", """
SELECT customer_id, source_type, entity_id, title, summary, created_at, CAST(rn AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, source_type DESC, _ord) AS rn FROM recent_signals) WHERE rn <= 12""")
def _(r):
    return RK.related_events(r["recent_tickets"], r["risk_events"])


@query("isolation_risk")
def _(r):
    return RK.isolation_risk(_features(r))


@query("context_items", """
SELECT customer_id, 'ticket' AS source_type, ticket_id AS entity_id, concat_ws('; ', concat('priority=', priority), concat('status=', status), concat('sla=', sla_status), nullif(description, '')) AS summary FROM tickets
UNION ALL SELECT customer_id, 'risk_event', risk_event_id, summary FROM risk_events""")
def _(r):
    return S.context_items(r["tickets"], r["risk_events"]).select("customer_id", "source_type", "entity_id", "summary")
