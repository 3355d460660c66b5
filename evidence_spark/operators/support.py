"""Customer summaries, ticket triage, SLA checks and drafted replies for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import contains_any, nonblank, one_of, sval
from .relational import lookup_join
from .risk import risk_flags, ticket_flags


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def customer_summaries(customers, accounts, tickets, risks, unique: bool = False) -> DataFrame:
    """Five counts and a narrative per customer, from two pre-aggregated facts."""
    t = ticket_flags(tickets).groupBy(sval("customer_id").alias("_ck")).agg(
        F.count("*").alias("ticket_count"), _count_if(F.col("is_active")).alias("active_ticket_count"))
    r = risk_flags(risks).groupBy(sval("customer_id").alias("_ck")).agg(
        F.count("*").alias("risk_event_count"),
        _count_if(F.col("is_active")).alias("active_risk_event_count"),
        _count_if(F.col("is_high")).alias("high_risk_event_count"))
    base = lookup_join(customers, accounts, "account_id", "account_id",
                       {"_acct": "account_id", "account_name": "account_name",
                        "risk_level": "risk_level", "health_score": "health_score"}, unique=unique)
    base = base.withColumn("_ck", sval("customer_id")).join(t, "_ck", "left").join(r, "_ck", "left")
    counts = ["ticket_count", "active_ticket_count", "risk_event_count", "active_risk_event_count",
              "high_risk_event_count"]
    for c in counts:
        base = base.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))

    def known(c, default):
        return F.when(F.col("_acct") == "", F.lit(default)).otherwise(F.col(c))

    text = F.concat(
        sval("full_name"), F.lit(" is a "), sval("role"), F.lit(" at "),
        known("account_name", "an unknown account"), F.lit(" with "), sval("support_tier"),
        F.lit(" support. The account risk level is "), known("risk_level", "unknown"),
        F.lit(" with health score "), known("health_score", "unknown"), F.lit(". There are "),
        F.col("active_ticket_count").cast("string"), F.lit(" active tickets and "),
        F.col("active_risk_event_count").cast("string"),
        F.lit(" active risk events in the synthetic dataset."))
    return base.select("customer_id", sval("full_name").alias("customer_name"), "account_id",
                       "account_name", text.alias("summary"), *counts)


def context_items(tickets: DataFrame, risks: DataFrame) -> DataFrame:
    """The ticket and risk items that accompany a customer summary, one row each."""
    t_sum = F.concat_ws("; ", F.concat(F.lit("priority="), sval("priority")),
                        F.concat(F.lit("status="), sval("status")),
                        F.concat(F.lit("sla="), sval("sla_status")), nonblank("description"))
    t = tickets.select(sval("customer_id").alias("customer_id"), F.lit("ticket").alias("source_type"),
                       sval("ticket_id").alias("entity_id"), sval("title").alias("title"),
                       t_sum.alias("summary"), "_ord")
    r = risks.select(sval("customer_id").alias("customer_id"), F.lit("risk_event").alias("source_type"),
                     sval("risk_event_id").alias("entity_id"), sval("event_type").alias("title"),
                     sval("summary").alias("summary"), "_ord")
    return t.unionByName(r)


def _rank(p: Column) -> Column:
    r = F.lit(0)
    for name, value in [("p4", 1), ("p3", 2), ("p2", 3), ("p1", 4)]:
        r = F.when(p == name, value).otherwise(r)
    return r


def _raise_to(current: Column, floor: str, cond: Column) -> Column:
    return F.when(cond & (_rank(current) < _rank(F.lit(floor))), floor).otherwise(current)


def triage_tickets(tickets: DataFrame, products: DataFrame | None = None,
                   services: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Recommended priority, status, escalation flag and reasons for every ticket."""
    low = {c: F.lower(sval(c)) for c in ["priority", "status", "category", "severity", "sla_status"]}
    bad_sla = one_of(low["sla_status"], K.BAD_SLA)
    top = (low["priority"] == "p1") | (low["severity"] == "sev1")
    serious = one_of(low["category"], ["incident", "security"]) | (low["severity"] == "sev2")
    priority = F.when(top, "p1").when(low["priority"] == "", "p4").otherwise(low["priority"])
    priority = _raise_to(priority, "p2", serious | bad_sla)
    df = tickets.withColumn("recommended_priority", priority)
    p = F.col("recommended_priority")
    escalate = (bad_sla | (p == "p1")
                | ((p == "p2") & one_of(low["status"], ["open", "pending_engineering"])))
    df = df.withColumn("escalation_required", escalate)
    status = F.when(F.col("escalation_required") & ~one_of(low["status"], K.CLOSED_STATUSES),
                    "pending_engineering").otherwise(low["status"])
    reasons = F.array_compact(F.array(
        F.when(top, "Ticket is already marked P1 or Sev1."),
        F.when(serious, "Incident, security, or Sev2 tickets should be at least P2."),
        F.when(bad_sla, F.concat(F.lit("SLA status is "), low["sla_status"],
                                 F.lit(", so escalation should be considered."))),
        F.when(low["status"] == "pending_engineering", "Ticket is already waiting on engineering.")))
    calm = F.array(F.lit("No high-risk signal was found; keep the current ticket handling."))
    out = df.withColumn("recommended_status", status).withColumn(
        "reasons", F.when(F.size(reasons) > 0, reasons).otherwise(calm))
    cols = ["ticket_id", F.col("priority").alias("current_priority"), "recommended_priority",
            F.col("status").alias("current_status"), "recommended_status", "escalation_required", "reasons"]
    if products is not None:
        out = lookup_join(out, products, "product_id", "product_id", {"product_name": "product_name"}, unique=unique)
        cols.append("product_name")
    if services is not None:
        out = lookup_join(out, services, "service_id", "service_id",
                          {"service_name": "service_name", "owner_team": "owner_team"}, unique=unique)
        cols += ["service_name", "owner_team"]
    return out.select(*cols)


def sla_checks(tickets: DataFrame) -> DataFrame:
    p, s, sla = (F.lower(sval(c)) for c in ["priority", "status", "sla_status"])
    open_p1 = (p == "p1") & ~one_of(s, K.CLOSED_STATUSES)
    reasons = F.array_compact(F.array(
        F.concat(F.lit("Ticket SLA status is "), F.when(sla == "", "unknown").otherwise(sla), F.lit(".")),
        F.when(open_p1, "Open P1 tickets require active escalation under the SLA policy."),
        F.when((p == "p2") & (s == "pending_engineering"),
               "P2 tickets waiting on engineering should be monitored for escalation.")))
    escalate = one_of(sla, K.BAD_SLA) | open_p1
    advice = F.when(escalate, "Escalate to the owning support and engineering teams.").otherwise(
        "No immediate SLA escalation is required based on current ticket fields.")
    return tickets.select("ticket_id", sval("priority").alias("priority"), sval("status").alias("status"),
                          sval("sla_status").alias("sla_status"),
                          sval("first_response_due_at").alias("first_response_due_at"),
                          sval("resolution_due_at").alias("resolution_due_at"),
                          escalate.alias("escalation_required"), advice.alias("recommendation"),
                          reasons.alias("reasons"))


def ticket_haystack() -> Column:
    cols = ["title", "description", "category", "priority", "severity", "sla_status", "tags",
            "product_id", "service_id"]
    return F.lower(F.concat_ws(" ", *[sval(c) for c in cols]))


def policy_ids(haystack: Column, fallback: bool = False) -> Column:
    """Ids of all keyword rules that hit a text, in rule order, as a row-local array.

    Pass a plain column: the text is tested once per keyword.
    """
    hits = [F.when(contains_any(haystack, words), pid) for pid, words in K.POLICY_RULES]
    if fallback:
        every = [w for _, words in K.POLICY_RULES for w in words]
        hits.append(F.when(~contains_any(haystack, dict.fromkeys(every)), K.FALLBACK_POLICY))
    return F.array_compact(F.array(*hits))


def draft_replies(tickets, customers, products, services, messages, resolutions, policies,
                  unique: bool = False) -> DataFrame:
    """Customer-safe reply text per ticket from its latest public message and resolution."""
    latest = (messages.where((sval("visibility") == "public") & (sval("author_type") == "customer"))
              .groupBy(sval("ticket_id").alias("_tk"))
              .agg(F.max_by(sval("body"), F.struct("_ord", sval("body"))).alias("_said")))
    fixed = (resolutions.groupBy(sval("ticket_id").alias("_tk"))
             .agg(F.min_by(sval("customer_visible_response"), "_ord").alias("_fix")))
    df = tickets.withColumn("_tk", sval("ticket_id")).withColumn("_hay", ticket_haystack()).withColumn(
        "_pids", policy_ids(F.col("_hay"), fallback=True)).drop("_hay")
    df = lookup_join(df, customers, "customer_id", "customer_id", {"_who": "full_name"}, unique=unique)
    df = lookup_join(df, products, "product_id", "product_id",
                     {"_pk": "product_id", "_product": "product_name"}, unique=unique)
    df = lookup_join(df, services, "service_id", "service_id",
                     {"_sk": "service_id", "_service": "service_name"}, unique=unique)
    flags = triage_tickets(tickets).select(sval("ticket_id").alias("_tk"),
                                           F.col("escalation_required").alias("_esc"))
    titles = (df.select("_tk", F.posexplode_outer("_pids").alias("_p", "_pid"))
              .join(policies.select(sval("policy_id").alias("_pid"), sval("title").alias("_t")), "_pid")
              .groupBy("_tk").agg(F.array_sort(F.collect_list(F.struct("_p", "_pid", "_t"))).alias("_pol")))
    df = (df.join(latest, "_tk", "left").join(fixed, "_tk", "left").join(flags, "_tk")
          .join(titles, "_tk", "left"))
    pol = F.coalesce(F.col("_pol"), F.array())
    first_name = F.when(F.split(F.col("_who"), " ")[0] == "", "there").otherwise(F.split(F.col("_who"), " ")[0])
    parts = [
        F.concat(F.lit("Hi "), first_name, F.lit(",")),
        F.concat(F.lit("Thanks for contacting us about "), sval("title"), F.lit(". We see this affects "),
                 F.when(F.col("_pk") == "", "the product").otherwise(F.col("_product")), F.lit(" and "),
                 F.when(F.col("_sk") == "", "the related service").otherwise(F.col("_service")), F.lit(".")),
        F.when(F.col("_said").isNotNull(),
               F.concat(F.lit("Based on your latest update, we are tracking: "), F.col("_said"), F.lit("."))),
        F.when(F.col("_fix").isNotNull(), nonblank("_fix"))
        .when(F.col("_esc"), F.lit("This has been flagged for escalation based on priority, status, and SLA signals."))
        .otherwise("We are continuing the investigation and will follow up with the next concrete finding."),
        F.when(F.size(pol) > 0, F.concat(F.lit("We are using the relevant support guidance: "),
                                         F.array_join(F.transform("_pol", lambda x: x["_t"]), ", "), F.lit("."))),
        F.lit("We will keep the response customer-safe and avoid exposing internal notes."),
    ]
    used = F.transform("_pol", lambda x: x["_pid"])
    return df.select("ticket_id", F.concat_ws("\n\n", *parts).alias("draft_reply"),
                     F.coalesce(used, F.array().cast("array<string>")).alias("used_policy_ids"))
