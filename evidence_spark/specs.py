"""Table and domain registry: names, keys, required columns, foreign keys and builders."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as K


@dataclass(frozen=True)
class TableSpec:
    name: str
    path: str
    key: str
    required: tuple[str, ...]
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    list_keys: tuple[tuple[str, str, str], ...] = ()
    text: str | None = None
    format: str = "csv"
    source_type: str = ""
    title_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class DomainSpec:
    name: str
    tables: tuple[TableSpec, ...]
    report_blank_fk: bool = True
    policy_ids: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> TableSpec:
        return next(t for t in self.tables if t.name == name)


def _cols(text: str) -> tuple[str, ...]:
    return tuple(text.split())


SUPPORT = DomainSpec(K.SUPPORT_DOMAIN, (
    TableSpec("customers", "crm/customers.csv", "customer_id", _cols(
        "customer_id account_id full_name email role region timezone created_at status support_tier preferred_contact_channel"),
        source_type="customer", title_fields=("full_name", "email")),
    TableSpec("accounts", "crm/accounts.csv", "account_id", _cols(
        "account_id account_name industry segment region account_owner contract_start_date contract_end_date arr_usd "
        "health_score risk_level created_at"), source_type="account", title_fields=("account_name",)),
    TableSpec("products", "crm/products.csv", "product_id", _cols(
        "product_id product_name product_family service_id plan_name lifecycle_stage support_owner_team "
        "engineering_owner_team docs_url"), source_type="product", title_fields=("product_name",)),
    TableSpec("tickets", "support/tickets.csv", "ticket_id", _cols(
        "ticket_id account_id customer_id product_id service_id title description category priority severity status channel "
        "created_at updated_at first_response_due_at resolution_due_at sla_status assigned_team assignee tags"),
        (("customer_id", "customers", "customer_id"), ("product_id", "products", "product_id")),
        source_type="ticket", title_fields=("title",)),
    TableSpec("ticket_messages", "support/ticket_messages.csv", "message_id", _cols(
        "message_id ticket_id author_type author_id created_at visibility message_type body sentiment contains_action_item"),
        (("ticket_id", "tickets", "ticket_id"),), source_type="ticket_message", title_fields=("message_type",)),
    TableSpec("ticket_resolutions", "support/ticket_resolutions.csv", "resolution_id", _cols(
        "resolution_id ticket_id resolved_at resolution_type summary root_cause linked_policy_id linked_issue_id "
        "customer_visible_response preventive_action"), (("ticket_id", "tickets", "ticket_id"),),
        source_type="ticket_resolution", title_fields=("summary", "resolution_type")),
    TableSpec("service_catalog", "engineering/service_catalog.csv", "service_id", _cols(
        "service_id service_name description product_id owner_team support_escalation_team tier slack_channel "
        "runbook_policy_id on_call_rotation repo status"), source_type="service", title_fields=("service_name",)),
    TableSpec("github_issues", "engineering/github_issues.jsonl", "issue_id", _cols(
        "issue_id repo number title body state service_id product_id created_at updated_at"),
        (("service_id", "service_catalog", "service_id"),), format="jsonl", source_type="github_issue", title_fields=("title",)),
    TableSpec("risk_events", "risk/risk_events.csv", "risk_event_id", _cols(
        "risk_event_id account_id customer_id ticket_id product_id service_id event_type severity risk_score detected_at "
        "source summary evidence_refs recommended_action status"), (("customer_id", "customers", "customer_id"),),
        source_type="risk_event", title_fields=("summary", "event_type")),
    TableSpec("knowledge_base_docs", "knowledge_base/*.md", "policy_id", ("policy_id", "title", "path", "content"),
              text="content", format="markdown", source_type="knowledge_base", title_fields=("title",)),
))

BANKING = DomainSpec(K.BANKING_DOMAIN, (
    TableSpec("customers", "customers.csv", "customer_id", _cols(
        "customer_id full_name email segment region risk_tier kyc_status created_at"), source_type="customer", title_fields=("full_name",)),
    TableSpec("accounts", "accounts.csv", "account_id", _cols(
        "account_id customer_id account_type status opened_at balance_usd online_banking_enabled"),
        (("customer_id", "customers", "customer_id"),), source_type="account"),
    TableSpec("transactions", "transactions.csv", "transaction_id", _cols(
        "transaction_id account_id customer_id merchant_id amount_usd currency transaction_type channel country created_at "
        "status device_id ip_country"), (("account_id", "accounts", "account_id"), ("customer_id", "customers", "customer_id"),
                                         ("merchant_id", "merchants", "merchant_id")), source_type="transaction"),
    TableSpec("merchants", "merchants.csv", "merchant_id", _cols("merchant_id merchant_name category country risk_level"),
              source_type="merchant", title_fields=("merchant_name",)),
    TableSpec("fraud_alerts", "fraud_alerts.csv", "alert_id", _cols(
        "alert_id transaction_id customer_id account_id alert_type severity status created_at rule_name summary recommended_action"),
        (("transaction_id", "transactions", "transaction_id"), ("customer_id", "customers", "customer_id"),
         ("account_id", "accounts", "account_id")), source_type="fraud_alert", title_fields=("summary",)),
    TableSpec("aml_cases", "aml_cases.csv", "case_id", _cols(
        "case_id customer_id account_id case_type status opened_at priority summary linked_alert_ids assigned_team recommended_action"),
        (("customer_id", "customers", "customer_id"), ("account_id", "accounts", "account_id")),
        (("linked_alert_ids", "fraud_alerts", "alert_id"),), source_type="aml_case", title_fields=("summary",)),
    TableSpec("policies", "policies/*.md", "policy_id", ("policy_id", "title", "path", "content"), text="content",
              format="markdown", source_type="policy", title_fields=("title",)),
), report_blank_fk=False,
    # fixed values: policy ids by file name
    policy_ids={"aml_policy.md": "bf_pol_aml", "card_fraud_policy.md": "bf_pol_card_fraud",
                "account_takeover_policy.md": "bf_pol_account_takeover"})

_DOMAINS = {d.name: d for d in (SUPPORT, BANKING)}


def register_domain(spec: DomainSpec) -> None:
    _DOMAINS[spec.name] = spec


def get_domain(name: str) -> DomainSpec:
    key = str(name or "").strip().lower().replace("-", "_")
    if key not in _DOMAINS:
        raise ValueError(f"unknown domain {name!r}; known: {', '.join(sorted(_DOMAINS))}")
    return _DOMAINS[key]
