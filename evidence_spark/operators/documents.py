"""Denormalised retrieval documents built from the relational tables, set at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import (after_first, dashed, first_nonblank, line, lines, nonblank, pipe_list,
                              sval)
from .corpus import clean_text
from .relational import array_link_join, explode_ids, lookup_join, nest_text

META = ["source", "source_type", "entity_id", "title", "customer_id", "ticket_id", "product_id",
        "service_id", "policy_id", "created_at", "account_id", "path"]


def with_metadata(df: DataFrame, source_type: str, id_fields, title_fields=(), path: str = "",
                  source: str = K.SUPPORT_DOMAIN) -> DataFrame:
    """Adds the metadata struct; blank values are NULL. Messages written by a customer
    carry the author as their customer."""
    have = set(df.columns)
    rel = {f: nonblank(f) if f in have else F.lit(None).cast("string")
           for f in ["customer_id", "ticket_id", "product_id", "service_id"]}
    if {"author_type", "author_id"} <= have:
        rel["customer_id"] = F.when((F.col("author_type") == "customer") & (F.col("author_id") != ""),
                                    F.col("author_id")).otherwise(rel["customer_id"])
    ids = [c for c in id_fields if c in have]
    titles = [c for c in title_fields if c in have]
    title = F.nullif(first_nonblank(*titles), F.lit("")) if titles else F.lit(None).cast("string")
    return df.withColumn("metadata", F.struct(
        F.lit(source).alias("source"), F.lit(source_type).alias("source_type"),
        first_nonblank(*ids).alias("entity_id"), title.alias("title"),
        *[rel[f].alias(f) for f in rel], F.lit(path or None).cast("string").alias("path")))


def _meta(source: str, source_type: str, **fields) -> Column:
    values = {"source": F.lit(source), "source_type": F.lit(source_type), **fields}
    return F.struct(*[(nonblank(values[m]) if m in values else F.lit(None).cast("string")).alias(m)
                      for m in META])


def _doc(df: DataFrame, domain: str, kind: str, entity: str, text: Column, **fields) -> DataFrame:
    doc_id = F.concat(F.lit(f"{domain}::{kind}::"), sval(entity))
    return df.select(doc_id.alias("id"), text.alias("text"),
                     _meta(domain, kind, entity_id=sval(entity), **fields).alias("metadata"))


def ticket_summary() -> Column:
    return dashed("ticket_id", "title", "status", "priority")


def risk_summary() -> Column:
    return dashed("risk_event_id", "event_type", "severity", "summary")


def issue_summary() -> Column:
    return dashed("issue_id", "title", "state", "severity")


def message_summary() -> Column:
    prefix = F.concat_ws(" | ", *[nonblank(c) for c in ["created_at", "author_type", "visibility", "message_type"]])
    return F.when(prefix == "", sval("body")).otherwise(F.concat(prefix, F.lit(": "), sval("body")))


def resolution_summary() -> Column:
    return dashed("resolution_id", "resolution_type", "summary", "customer_visible_response")


def _nested(df: DataFrame, key: str, children: DataFrame, value: Column, out: str, order="_ord") -> DataFrame:
    child = nest_text(children, key, value, order, out=out).withColumnRenamed(key, "_nk")
    return df.join(child, sval(key) == F.col("_nk"), "left").drop("_nk")


def customer_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    df = lookup_join(t["customers"], t["accounts"], "account_id", "account_id",
                     {"_an": "account_name", "_as": "segment", "_ar": "risk_level", "_ah": "health_score"},
                     unique=unique)
    df = _nested(df, "customer_id", t["tickets"], ticket_summary(), "_tickets")
    df = _nested(df, "customer_id", t["risk_events"], risk_summary(), "_risks")
    text = lines(
        F.lit("Customer Profile"), line("Customer ID", "customer_id"), line("Name", "full_name"),
        line("Email", "email"), line("Role", "role"), line("Region", "region"),
        line("Support tier", "support_tier"),
        line("Preferred contact channel", "preferred_contact_channel"), line("Account ID", "account_id"),
        line("Account", "_an"), line("Account segment", "_as"), line("Account risk level", "_ar"),
        line("Account health score", "_ah"), line("Related tickets", "_tickets"), line("Risk events", "_risks"))
    return _doc(df, K.SUPPORT_DOMAIN, "customer", "customer_id", text, title=F.col("full_name"),
                customer_id=F.col("customer_id"), account_id=F.col("account_id"), created_at=F.col("created_at"))


def ticket_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    df = t["tickets"]
    df = lookup_join(df, t["customers"], "customer_id", "customer_id",
                     {"_cn": "full_name", "_cr": "role", "_ct": "support_tier"}, unique=unique)
    df = lookup_join(df, t["accounts"], "account_id", "account_id",
                     {"_an": "account_name", "_ar": "risk_level"}, unique=unique)
    df = lookup_join(df, t["products"], "product_id", "product_id",
                     {"_pn": "product_name", "_pf": "product_family"}, unique=unique)
    df = lookup_join(df, t["service_catalog"], "service_id", "service_id",
                     {"_sn": "service_name", "_so": "owner_team", "_se": "support_escalation_team"}, unique=unique)
    df = _nested(df, "ticket_id", t["ticket_messages"], message_summary(), "_messages")
    df = _nested(df, "ticket_id", t["ticket_resolutions"], resolution_summary(), "_fixes")
    issue_links = explode_ids(t["github_issues"], [issue_summary().alias("_is"), "_ord"],
                              "linked_ticket_ids", "ticket_id")
    df = _nested(df, "ticket_id", issue_links, F.col("_is"), "_issues")
    df = _nested(df, "ticket_id", t["risk_events"], risk_summary(), "_risks")
    text = lines(
        F.lit("Support Ticket"), line("Ticket ID", "ticket_id"), line("Title", "title"),
        line("Description", "description"), line("Category", "category"), line("Priority", "priority"),
        line("Severity", "severity"), line("Status", "status"), line("SLA status", "sla_status"),
        line("Created at", "created_at"), line("Updated at", "updated_at"),
        line("First response due at", "first_response_due_at"), line("Resolution due at", "resolution_due_at"),
        line("Assigned team", "assigned_team"), line("Assignee", "assignee"), line("Tags", "tags"),
        line("Customer", "_cn"), line("Customer role", "_cr"), line("Customer support tier", "_ct"),
        line("Account", "_an"), line("Account risk level", "_ar"), line("Product", "_pn"),
        line("Product family", "_pf"), line("Service", "_sn"), line("Service owner team", "_so"),
        line("Support escalation team", "_se"), line("Messages", "_messages"), line("Resolutions", "_fixes"),
        line("Related engineering issues", "_issues"), line("Risk events", "_risks"))
    return _doc(df, K.SUPPORT_DOMAIN, "ticket", "ticket_id", text, title=F.col("title"),
                **{c: F.col(c) for c in ["customer_id", "ticket_id", "product_id", "service_id",
                                         "created_at", "account_id"]})


def knowledge_base_documents(t: dict[str, DataFrame]) -> DataFrame:
    df = t["knowledge_base_docs"]
    for c in ["policy_type", "owner_team", "product_id", "service_id", "effective_date", "review_date",
              "tags", "summary", "path"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    tags = F.array_join(pipe_list("tags"), ", ")
    text = lines(
        F.lit("Knowledge Base Article"), line("Policy ID", "policy_id"), line("Title", "title"),
        line("Policy type", "policy_type"), line("Owner team", "owner_team"), line("Product ID", "product_id"),
        line("Service ID", "service_id"), line("Effective date", "effective_date"),
        line("Review date", "review_date"), line("Tags", tags), line("Summary", "summary"),
        line("Content", "content"))
    return _doc(df, K.SUPPORT_DOMAIN, "knowledge_base", "policy_id", text, title=F.col("title"),
                **{c: F.col(c) for c in ["product_id", "service_id", "policy_id", "path"]})


def service_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    df = lookup_join(t["service_catalog"], t["products"], "product_id", "product_id",
                     {"_pn": "product_name"}, unique=unique)
    df = _nested(df, "service_id", t["tickets"], ticket_summary(), "_tickets")
    df = _nested(df, "service_id", t["github_issues"], issue_summary(), "_issues")
    df = _nested(df, "service_id", t["risk_events"], risk_summary(), "_risks")
    text = lines(
        F.lit("Service Catalog Entry"), line("Service ID", "service_id"), line("Service", "service_name"),
        line("Description", "description"), line("Product", "_pn"), line("Product ID", "product_id"),
        line("Owner team", "owner_team"), line("Support escalation team", "support_escalation_team"),
        line("Tier", "tier"), line("Slack channel", "slack_channel"),
        line("Runbook policy ID", "runbook_policy_id"), line("On-call rotation", "on_call_rotation"),
        line("Repository", "repo"), line("Status", "status"), line("Related tickets", "_tickets"),
        line("Related engineering issues", "_issues"), line("Risk events", "_risks"))
    return _doc(df, K.SUPPORT_DOMAIN, "service", "service_id", text, title=F.col("service_name"),
                product_id=F.col("product_id"), service_id=F.col("service_id"),
                policy_id=F.col("runbook_policy_id"))


def issue_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    df = lookup_join(t["github_issues"], t["products"], "product_id", "product_id", {"_pn": "product_name"}, unique=unique)
    df = lookup_join(df, t["service_catalog"], "service_id", "service_id", {"_sn": "service_name"}, unique=unique)
    linked = array_link_join(df, "issue_id", pipe_list("linked_ticket_ids"), t["tickets"], "ticket_id",
                             ticket_summary(), out="_links", unique=unique)
    df = df.join(linked, "issue_id", "left").withColumn(
        "_links", F.array_join(F.coalesce("_links", F.array().cast("array<string>")), ", "))
    only = pipe_list("linked_ticket_ids")
    text = lines(
        F.lit("Engineering GitHub Issue"), line("Issue ID", "issue_id"), line("Repository", "repo"),
        line("Number", "number"), line("Title", "title"), line("State", "state"), line("Severity", "severity"),
        line("Labels", F.array_join(pipe_list("labels"), ", ")), line("Product", "_pn"), line("Service", "_sn"),
        line("Assignee team", "assignee_team"), line("Created at", "created_at"),
        line("Updated at", "updated_at"), line("Closed at", "closed_at"), line("Body", "body"),
        line("Linked tickets", "_links"), line("Resolution summary", "resolution_summary"))
    return _doc(df, K.SUPPORT_DOMAIN, "github_issue", "issue_id", text, title=F.col("title"),
                ticket_id=F.when(F.size(only) == 1, only[0]), product_id=F.col("product_id"),
                service_id=F.col("service_id"), created_at=F.col("created_at"), path=F.col("repo"))


def risk_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    df = t["risk_events"]
    df = lookup_join(df, t["customers"], "customer_id", "customer_id", {"_cn": "full_name"}, unique=unique)
    df = lookup_join(df, t["accounts"], "account_id", "account_id", {"_an": "account_name"}, unique=unique)
    df = lookup_join(df, t["products"], "product_id", "product_id", {"_pn": "product_name"}, unique=unique)
    df = lookup_join(df, t["service_catalog"], "service_id", "service_id", {"_sn": "service_name"}, unique=unique)
    tickets = t["tickets"].select("ticket_id", "_ord", ticket_summary().alias("_ts"))
    df = lookup_join(df, tickets, "ticket_id", "ticket_id", {"_tt": "_ts"}, unique=unique)
    text = lines(
        F.lit("Risk Event"), line("Risk event ID", "risk_event_id"), line("Event type", "event_type"),
        line("Severity", "severity"), line("Risk score", "risk_score"), line("Detected at", "detected_at"),
        line("Status", "status"), line("Source", "source"), line("Summary", "summary"),
        line("Recommended action", "recommended_action"), line("Evidence references", "evidence_refs"),
        line("Customer", "_cn"), line("Account", "_an"), line("Ticket", "_tt"), line("Product", "_pn"),
        line("Service", "_sn"))
    return _doc(df, K.SUPPORT_DOMAIN, "risk_event", "risk_event_id", text, title=F.col("summary"),
                created_at=F.col("detected_at"),
                **{c: F.col(c) for c in ["customer_id", "ticket_id", "product_id", "service_id", "account_id"]})


def support_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    parts = [customer_documents(t, unique), ticket_documents(t, unique), knowledge_base_documents(t),
             service_documents(t, unique), issue_documents(t, unique), risk_documents(t, unique)]
    return reduce(DataFrame.unionByName, parts)


# -- banking domain ------------------------------------------------------------------

def _transaction_summary() -> Column:
    return F.concat(sval("transaction_id"), F.lit(" - "), sval("amount_usd"), F.lit(" "), sval("currency"),
                    F.lit(" - "), sval("transaction_type"), F.lit(" - "), F.col("_mn"), F.lit(" - "),
                    sval("status"))


def banking_documents(t: dict[str, DataFrame], unique=False) -> DataFrame:
    """Seven document types of the banking domain as one UNION ALL."""
    D = K.BANKING_DOMAIN
    txn = lookup_join(t["transactions"], t["merchants"], "merchant_id", "merchant_id",
                      {"_mn": "merchant_name", "_mr": "risk_level"}, unique=unique)
    txn_text = txn.select("transaction_id", "customer_id", "_ord", _transaction_summary().alias("_txs"))

    cust = t["customers"]
    cust = _nested(cust, "customer_id", t["accounts"], dashed("account_id", "account_type", "status"), "_accounts")
    cust = _nested(cust, "customer_id", txn_text, F.col("_txs"), "_txns")
    cust = _nested(cust, "customer_id", t["fraud_alerts"], dashed("alert_id", "alert_type", "severity"), "_alerts")
    cust = _nested(cust, "customer_id", t["aml_cases"], dashed("case_id", "case_type", "status"), "_cases")
    customers = _doc(cust, D, "customer", "customer_id", lines(
        F.lit("Banking Customer"), line("Customer ID", "customer_id"), line("Name", "full_name"),
        line("Segment", "segment"), line("Region", "region"), line("Risk tier", "risk_tier"),
        line("KYC status", "kyc_status"), line("Accounts", "_accounts"), line("Recent transactions", "_txns"),
        line("Fraud alerts", "_alerts"), line("AML cases", "_cases")),
        title=F.col("full_name"), customer_id=F.col("customer_id"), created_at=F.col("created_at"))
    accounts = _doc(t["accounts"], D, "account", "account_id", lines(
        F.lit("Banking Account"), line("Account ID", "account_id"), line("Customer ID", "customer_id"),
        line("Type", "account_type"), line("Status", "status"), line("Balance USD", "balance_usd"),
        line("Online banking enabled", "online_banking_enabled")),
        title=F.col("account_id"), account_id=F.col("account_id"), customer_id=F.col("customer_id"),
        created_at=F.col("opened_at"))
    transactions = _doc(txn, D, "transaction", "transaction_id", lines(
        F.lit("Banking Transaction"), line("Transaction ID", "transaction_id"),
        line("Customer ID", "customer_id"), line("Account ID", "account_id"), line("Merchant", "_mn"),
        line("Merchant risk", "_mr"), line("Amount USD", "amount_usd"), line("Type", "transaction_type"),
        line("Channel", "channel"), line("Country", "country"), line("IP country", "ip_country"),
        line("Status", "status"), line("Created at", "created_at")),
        title=F.concat_ws(" ", sval("transaction_id"), sval("transaction_type")),
        customer_id=F.col("customer_id"), account_id=F.col("account_id"), created_at=F.col("created_at"))
    merchants = _doc(t["merchants"], D, "merchant", "merchant_id", lines(
        F.lit("Banking Merchant"), line("Merchant ID", "merchant_id"), line("Name", "merchant_name"),
        line("Category", "category"), line("Country", "country"), line("Risk level", "risk_level")),
        title=F.col("merchant_name"))
    alert = lookup_join(t["fraud_alerts"], txn_text, "transaction_id", "transaction_id", {"_tx": "_txs"}, unique=unique)
    alerts = _doc(alert, D, "fraud_alert", "alert_id", lines(
        F.lit("Fraud Alert"), line("Alert ID", "alert_id"), line("Alert type", "alert_type"),
        line("Severity", "severity"), line("Status", "status"), line("Rule", "rule_name"),
        line("Summary", "summary"), line("Recommended action", "recommended_action"), line("Transaction", "_tx")),
        title=F.col("summary"), customer_id=F.col("customer_id"), account_id=F.col("account_id"),
        created_at=F.col("created_at"))
    links = array_link_join(t["aml_cases"], "case_id", pipe_list("linked_alert_ids"), t["fraud_alerts"],
                            "alert_id", sval("summary"), out="_ls", unique=unique)
    case = t["aml_cases"].join(links, "case_id", "left")
    summaries = F.array_join(F.filter(F.coalesce("_ls", F.array().cast("array<string>")), lambda x: x != ""), ", ")
    cases = _doc(case, D, "aml_case", "case_id", lines(
        F.lit("AML Case"), line("Case ID", "case_id"), line("Customer ID", "customer_id"),
        line("Account ID", "account_id"), line("Case type", "case_type"), line("Priority", "priority"),
        line("Status", "status"), line("Summary", "summary"),
        line("Linked alerts", F.array_join(pipe_list("linked_alert_ids"), ", ")),
        line("Alert summaries", summaries), line("Recommended action", "recommended_action")),
        title=F.col("summary"), customer_id=F.col("customer_id"), account_id=F.col("account_id"),
        created_at=F.col("opened_at"))
    policies = _doc(t["policies"], D, "policy", "policy_id", lines(
        F.lit("Banking Fraud Policy"), line("Policy ID", "policy_id"), line("Title", "title"),
        line("Path", "path"), nonblank("content")),
        title=F.col("title"), policy_id=F.col("policy_id"), path=F.col("path"))
    return reduce(DataFrame.unionByName,
                  [customers, accounts, transactions, merchants, alerts, cases, policies])


def build_documents(domain: str, tables: dict[str, DataFrame], unique=False) -> DataFrame:
    builders = {K.SUPPORT_DOMAIN: support_documents, K.BANKING_DOMAIN: banking_documents}
    return builders[domain](tables, unique)


# -- raw corpus records --------------------------------------------------------------

def _pick(df: DataFrame, *names) -> Column:
    return first_nonblank(*[n for n in names if n in df.columns], F.lit(""))


def records_to_documents(df: DataFrame, kind: str) -> DataFrame:
    """Raw document or ticket records to (text, metadata) with blank-line separated parts."""
    def part(prefix, value):
        return F.concat(F.lit(prefix), F.nullif(value, F.lit("")))

    if kind == "document":
        parts = [part("Title: ", _pick(df, "title", "name", "path", "slug")),
                 part("Summary: ", _pick(df, "summary")),
                 F.nullif(_pick(df, "content", "text", "markdown", "body"), F.lit(""))]
    elif kind == "ticket":
        labels = F.array_join(F.filter(F.transform("labels", lambda x: sval(x)), lambda x: x != ""), ", ") \
            if "labels" in df.columns else F.lit("")
        parts = [part("Ticket ID: ", _pick(df, "ticket_id", "issue_number", "number", "id")),
                 part("Title: ", _pick(df, "title", "issue_title")), part("Labels: ", labels),
                 part("Body:\n", _pick(df, "body", "content", "text", "description")),
                 part("Comments:\n", _pick(df, "comments")),
                 part("Resolution:\n", _pick(df, "resolution", "answer", "accepted_answer", "closing_note"))]
    else:
        raise ValueError(f"unknown record kind: {kind}")
    doc_id = _pick(df, "doc_id", "ticket_id", "issue_number", "number", "id")
    path = first_nonblank(_pick(df, "path", "file_path"), after_first(doc_id, "::"))
    source = first_nonblank(_pick(df, "source", "repo", "origin"), F.lit(kind))
    page = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+", ""), "\\.md$", ""), "^content/", "")
    url = F.when(_pick(df, "url", "html_url", "source_url") != "", _pick(df, "url", "html_url", "source_url")) \
        .when((source == "github_docs") & (path != ""), F.concat(F.lit("https://docs.github.com/en/"), page)) \
        .otherwise("")
    return df.select(
        clean_text(F.concat_ws("\n\n", *parts)).alias("text"),
        F.struct(F.lit(kind).alias("source_type"), doc_id.alias("doc_id"),
                 _pick(df, "title", "name", "issue_title", "path").alias("title"), url.alias("url"),
                 source.alias("source"), path.alias("path")).alias("metadata"))


def rag_corpus(documents: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """Documents, plus tickets when given, without blank texts."""
    out = records_to_documents(documents, "document")
    if tickets is not None:
        out = out.unionByName(records_to_documents(tickets, "ticket"))
    return out.where(F.trim("text") != "")
