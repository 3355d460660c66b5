"""Property graph: nodes, edges, bounded expansion, node search and query context."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import clip, line, lines, nonblank, pipe_list, sval, tokens
from ..session import materialise, small_side, stored_bytes
from .node_scan import leading_nodes
from .relational import substring_pairs, top_k
from .search import best_documents
from .support import policy_ids, ticket_haystack

NODE_COLS = ["node_id", "node_type", "label", "text", "properties"]

# (table, node type, id column, label, text lines) in build order
SUPPORT_NODES = [
    ("accounts", "Account", "account_id", ["account_name"],
     [("Account", "account_name"), ("Industry", "industry"), ("Segment", "segment"), ("Region", "region"),
      ("Risk level", "risk_level"), ("Health score", "health_score")]),
    ("customers", "Customer", "customer_id", ["full_name"],
     [("Customer", "full_name"), ("Role", "role"), ("Region", "region"), ("Support tier", "support_tier"),
      ("Preferred contact", "preferred_contact_channel")]),
    ("products", "Product", "product_id", ["product_name"],
     [("Product", "product_name"), ("Family", "product_family"), ("Plan", "plan_name"),
      ("Lifecycle stage", "lifecycle_stage")]),
    ("service_catalog", "Service", "service_id", ["service_name"],
     [("Service", "service_name"), ("Description", "description"), ("Tier", "tier"), ("Repository", "repo"),
      ("Status", "status")]),
    ("knowledge_base_docs", "Policy", "policy_id", ["title"],
     [("Policy", "title"), ("Type", "policy_type"), ("Summary", "summary"), ("Content", "content")]),
    ("tickets", "Ticket", "ticket_id", ["title"],
     [("Ticket", "title"), ("Description", "description"), ("Category", "category"),
      ("Priority", "priority"), ("Severity", "severity"), ("Status", "status"), ("SLA status", "sla_status"),
      ("Tags", "tags")]),
    ("ticket_messages", "TicketMessage", "message_id", ["author_type", "message_type"],
     [("Message", "body"), ("Author type", "author_type"), ("Visibility", "visibility"),
      ("Sentiment", "sentiment")]),
    ("github_issues", "GitHubIssue", "issue_id", ["title"],
     [("GitHub issue", "title"), ("Repository", "repo"), ("State", "state"), ("Severity", "severity"),
      ("Labels", "labels"), ("Body", "body"), ("Resolution", "resolution_summary")]),
    ("risk_events", "RiskEvent", "risk_event_id", ["summary"],
     [("Risk event", "summary"), ("Event type", "event_type"), ("Severity", "severity"),
      ("Risk score", "risk_score"), ("Recommended action", "recommended_action"),
      ("Evidence", "evidence_refs")]),
]
# (table, id column, owner column, edge role, node type) for team ownership
TEAM_COLUMNS = [
    ("accounts", "account_id", "account_owner", "account_owner", "Account"),
    ("products", "product_id", "support_owner_team", "support_owner_team", "Product"),
    ("products", "product_id", "engineering_owner_team", "engineering_owner_team", "Product"),
    ("service_catalog", "service_id", "owner_team", "engineering_owner", "Service"),
    ("service_catalog", "service_id", "support_escalation_team", "support_escalation_team", "Service"),
    ("knowledge_base_docs", "policy_id", "owner_team", "policy_owner", "Policy"),
    ("tickets", "ticket_id", "assigned_team", "assigned_team", "Ticket"),
    ("github_issues", "issue_id", "assignee_team", "assignee_team", "GitHubIssue"),
]
# (table, source type, source column, target type, target column, edge type)
SUPPORT_EDGES = [
    ("customers", "Customer", "customer_id", "Account", "account_id", "HAS_ACCOUNT"),
    ("service_catalog", "Product", "product_id", "Service", "service_id", "AFFECTS_SERVICE"),
    ("service_catalog", "Service", "service_id", "Policy", "runbook_policy_id", "REFERENCES_POLICY"),
    ("knowledge_base_docs", "Policy", "policy_id", "Product", "product_id", "MENTIONS_PRODUCT"),
    ("knowledge_base_docs", "Policy", "policy_id", "Service", "service_id", "AFFECTS_SERVICE"),
    ("tickets", "Customer", "customer_id", "Ticket", "ticket_id", "CREATED_TICKET"),
    ("tickets", "Ticket", "ticket_id", "Product", "product_id", "MENTIONS_PRODUCT"),
    ("tickets", "Ticket", "ticket_id", "Service", "service_id", "AFFECTS_SERVICE"),
    ("ticket_messages", "Ticket", "ticket_id", "TicketMessage", "message_id", "HAS_MESSAGE"),
    ("github_issues", "GitHubIssue", "issue_id", "Product", "product_id", "MENTIONS_PRODUCT"),
    ("github_issues", "GitHubIssue", "issue_id", "Service", "service_id", "AFFECTS_SERVICE"),
    ("risk_events", "Customer", "customer_id", "RiskEvent", "risk_event_id", "HAS_RISK_EVENT"),
    ("risk_events", "Account", "account_id", "RiskEvent", "risk_event_id", "HAS_RISK_EVENT"),
    ("risk_events", "Ticket", "ticket_id", "RiskEvent", "risk_event_id", "HAS_RISK_EVENT"),
    ("risk_events", "Product", "product_id", "RiskEvent", "risk_event_id", "HAS_RISK_EVENT"),
    ("risk_events", "Service", "service_id", "RiskEvent", "risk_event_id", "HAS_RISK_EVENT"),
    ("risk_events", "RiskEvent", "risk_event_id", "Product", "product_id", "MENTIONS_PRODUCT"),
    ("risk_events", "RiskEvent", "risk_event_id", "Service", "service_id", "AFFECTS_SERVICE"),
]
BANKING_NODES = [
    ("customers", "Customer", "customer_id", ["full_name"]), ("accounts", "Account", "account_id", ["account_id"]),
    ("merchants", "Merchant", "merchant_id", ["merchant_name"]),
    ("transactions", "Transaction", "transaction_id", ["transaction_id"]),
    ("fraud_alerts", "FraudAlert", "alert_id", ["summary"]), ("aml_cases", "AMLCase", "case_id", ["summary"]),
    ("policies", "Policy", "policy_id", ["title"]),
]
BANKING_EDGES = [
    ("accounts", "Customer", "customer_id", "Account", "account_id", "HAS_ACCOUNT"),
    ("transactions", "Account", "account_id", "Transaction", "transaction_id", "MADE_TRANSACTION"),
    ("transactions", "Customer", "customer_id", "Transaction", "transaction_id", "INITIATED_TRANSACTION"),
    ("transactions", "Transaction", "transaction_id", "Merchant", "merchant_id", "PAID_MERCHANT"),
    ("fraud_alerts", "Transaction", "transaction_id", "FraudAlert", "alert_id", "TRIGGERED_ALERT"),
    ("fraud_alerts", "Customer", "customer_id", "FraudAlert", "alert_id", "HAS_ALERT"),
    ("aml_cases", "Customer", "customer_id", "AMLCase", "case_id", "HAS_AML_CASE"),
]


def node_key(node_type: str, c) -> Column:
    return F.concat(F.lit(node_type + ":"), sval(c))


def team_key(c) -> Column:
    return F.concat(F.lit("Team:"), F.btrim(F.regexp_replace(sval(c), "[^a-zA-Z0-9_]+", "_"), F.lit("_")))


def _meta_text(df: DataFrame) -> Column | None:
    if "metadata" not in df.columns:
        return None
    return F.concat_ws(", ", *[F.concat(F.lit(f"'{f}': '"), F.col(f"metadata.{f}"), F.lit("'"))
                               for f in df.schema["metadata"].dataType.names])


def _properties(df: DataFrame) -> Column:
    pairs = []
    for c in df.columns:
        if c not in ("_ord", "metadata"):
            pairs += [F.lit(c), sval(c)]
    meta = _meta_text(df)
    if meta is not None:
        pairs += [F.lit("metadata"), meta]
    return F.create_map(*pairs)


def _text_line(label: str, column: str) -> Column:
    if (label, column) == ("Content", "content"):
        return line(label, F.substring(sval(column), 1, 1000))
    if (label, column) == ("Labels", "labels"):
        return line(label, F.array_join(pipe_list(column), ", "))
    return line(label, column)


NODE_COLUMNS = ("node_type", "label", "text", "properties")


def build_nodes(tables: dict[str, DataFrame], spec=SUPPORT_NODES, teams=TEAM_COLUMNS, columns=NODE_COLUMNS) -> DataFrame:
    """All entity and team nodes; the last definition of an id wins.

    Hashes of the ids tell which of them repeat. Only the rows of those, and one row for each team and owner column, go
    into an aggregate; all others pass as they are read. Only the ``columns`` asked for are carried.
    """
    parts = []
    for step, entry in enumerate(spec):
        table, kind, key, label_cols, *rest = entry
        if table not in tables:
            continue
        df = tables[table]
        label = F.concat_ws(" ", *[nonblank(c) for c in label_cols if c in df.columns])
        if kind == "RiskEvent":
            label = F.coalesce(F.nullif(label, F.lit("")), sval("event_type"))
        nid = node_key(kind, key)
        fallback = nid if rest else sval(key)
        text = lines(*[_text_line(n, c) for n, c in rest[0] if c in df.columns]) if rest else F.lit("")
        order = F.struct(F.lit(step).alias("step"), F.col("_ord").cast("long").alias("ord"))
        parts.append((df if rest else df.where(nonblank(key).isNotNull())).select(*_node(
            nid, kind, F.coalesce(F.nullif(label, F.lit("")), fallback), text, _properties(df), order)))
    own, owners = reduce(DataFrame.unionByName, parts), _team_nodes(tables, teams, {entry[0] for entry in spec})
    # hashes that collide only send a few rows more into the aggregate
    ids = own.select(F.xxhash64("node_id").alias("_h"))
    if owners is not None:
        owners = materialise(owners)
        ids = ids.unionByName(owners.select(F.xxhash64("node_id").alias("_h")).distinct())
    twice = small_side(ids.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    out = ["node_id", *columns]
    again = None
    if not twice.isEmpty():
        own = own.withColumn("_h", F.xxhash64("node_id"))
        again, own = own.join(twice, "_h", "left_semi").drop("_h"), own.join(twice, "_h", "left_anti").drop("_h")
    merged = [x for x in (again, owners) if x is not None]
    if not merged:
        return own.select(*out)
    # maps cannot be compared, so the row travels as a struct beside its order
    last = reduce(DataFrame.unionByName, merged).groupBy("node_id").agg(
        F.max_by(F.struct(*NODE_COLUMNS), F.struct("order", "text")).alias("_r")).select("node_id", "_r.*")
    return own.select(*out).unionByName(last.select(*out))


def _team_nodes(tables: dict[str, DataFrame], teams, seen: set[str]) -> DataFrame | None:
    """Team nodes of owner columns, one row for each spelling and column: the last."""
    parts = [tables[table].select(sval(owner).alias("_name"), F.lit(step).alias("_step"), F.col("_ord").cast("long").alias("_ord")).where("_name <> ''")
             for step, (table, _, owner, _, _) in enumerate(teams) if table in tables and table in seen and owner in tables[table].columns]
    if not parts:
        return None
    found = reduce(DataFrame.unionByName, parts).groupBy("_name", "_step").agg(F.max("_ord").alias("_ord"))
    name = F.col("_name")
    return found.select(*_node(team_key(name), "Team", name, F.concat(F.lit("Team "), name), F.create_map(F.lit("team_name"), name),
                               F.struct(F.col("_step").alias("step"), F.col("_ord").alias("ord"))))


def _node(node_id, kind, label, text, properties, order) -> list[Column]:
    return [node_id.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), text.alias("text"),
            properties.alias("properties"), order.alias("order")]


def _edge(src, dst, kind, step, props=None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"),
                    (props if props is not None else empty).alias("properties"),
                    F.struct(F.lit(step).alias("step"), F.col("_ord").cast("long").alias("ord")).alias("order"))


def rule_edges(step: int = 90) -> Column:
    """Edges from a ticket row to the policies its keyword rules name, as an array."""
    return F.transform(policy_ids(F.col("_hay")), lambda p: _edge(
        node_key("Ticket", "ticket_id"), F.concat(F.lit("Policy:"), p), "REFERENCES_POLICY", step,
        F.create_map(F.lit("reason"), F.lit("rule_based_ticket_context"))))


def _edge_rows(tables: dict[str, DataFrame], spec, teams, extra: dict[str, list[Column]]) -> DataFrame:
    """One scan per table: each row expands into all edges it implies."""
    parts = []
    for table, df in tables.items():
        have = set(df.columns)
        found = []
        for step, (t, st, sc, dt, dc, kind) in enumerate(spec):
            if t == table and {sc, dc} <= have:
                both = nonblank(sc).isNotNull() & nonblank(dc).isNotNull()
                found.append(F.when(both, _edge(node_key(st, sc), node_key(dt, dc), kind, step)))
        for step, (t, key, owner, role, kind) in enumerate(teams):
            if t == table and owner in have:
                found.append(F.when(nonblank(owner).isNotNull(), _edge(
                    node_key(kind, key), team_key(owner), "OWNED_BY_TEAM", 30 + step, F.create_map(F.lit("role"), F.lit(role)))))
        arrays = ([F.array(*found)] if found else []) + extra.get(table, [])
        if arrays:
            every = F.array_compact(F.concat(*arrays))
            parts.append(df.select(F.explode_outer(every).alias("_e")).where("_e IS NOT NULL").select("_e.*"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def build_edges(tables: dict[str, DataFrame], nodes: DataFrame | None = None, as_built: bool = False) -> DataFrame:
    """Foreign-key, ownership, issue-link, rule and resolution edges between known nodes.

    The first properties of a (src, dst, type) survive, so rule edges beat resolution
    edges. ``as_built=True`` leaves out service runbook edges, which a builder that adds
    services before policies never creates. Without ``nodes`` the known nodes are those of the
    same tables: a row's own node and its teams are known then, and only other ends are looked up.
    """
    spec = [e for e in SUPPORT_EDGES if not (as_built and e[4] == "runbook_policy_id")]
    tk, pol, iss = node_key("Ticket", "ticket_id"), node_key("Policy", "linked_policy_id"), node_key("GitHubIssue", "linked_issue_id")
    full = F.create_map(*[x for c in ["resolution_id", "resolution_type", "summary", "resolved_at"] for x in (F.lit(c), sval(c))])
    rid = F.create_map(F.lit("resolution_id"), sval("resolution_id"))
    links = {"github_issues": [F.transform(pipe_list("linked_ticket_ids"), lambda t: _edge(
        F.concat(F.lit("Ticket:"), t), node_key("GitHubIssue", "issue_id"), "RELATED_TO_ISSUE", 60))]}
    rules = {"tickets": [rule_edges()]}
    solved = [_edge(tk, pol, "HAS_RESOLUTION", 91, full), _edge(tk, pol, "REFERENCES_POLICY", 92, rid),
              _edge(tk, iss, "RELATED_TO_ISSUE", 93, rid)]
    if "tickets" in tables:
        tables = {**tables, "tickets": tables["tickets"].withColumn("_hay", ticket_haystack())}
    if nodes is not None:
        every = _edge_rows(tables, spec, TEAM_COLUMNS, links | rules | {"ticket_resolutions": [F.array(*solved)]})
        known = {"*": nodes.select("node_id")}
        return _first_edges(materialise(_known_end(_known_end(every, "src", known), "dst", known)))
    owned = {entry[0]: entry[1] for entry in SUPPORT_NODES}
    known = {kind: tables[t].select(node_key(kind, key).alias("node_id")) for t, kind, key, *_ in SUPPORT_NODES if t in tables}

    def some(end: str, kind: str, extra: dict) -> DataFrame | None:
        """Edges whose ``end``, of this kind, is not the row's own node; the rules keep their places in the list."""
        own_at, kind_at = (1, 3) if end == "dst" else (3, 1)
        mine = [e if (owned.get(e[0]), e[kind_at]) == (e[own_at], kind) else ("", *e[1:]) for e in spec]
        return _known_end(_edge_rows(tables, mine, [], extra), end, known, kind)

    parts = [_edge_rows(tables, [], TEAM_COLUMNS, {})]
    parts += [some("dst", kind, rules if kind == "Policy" else {}) for kind in ("Policy", "Product", "Service", "Account", "RiskEvent")]
    parts += [some("src", kind, links if kind == "Ticket" else {}) for kind in ("Account", "Customer", "Product", "Service", "Ticket")]
    parts += [_known_end(_known_end(_edge_rows(tables, [], [], {"ticket_resolutions": [F.array(*found)]}), "dst", known, kind), "src", known, "Ticket")
              for kind, found in (("Policy", solved[:2]), ("GitHubIssue", solved[2:]))]
    return _first_edges(materialise(reduce(DataFrame.unionByName, [p for p in parts if p is not None])))


KNOWN_BYTES = 8 << 20  # of stored node ids; more are met by a shuffle


def _known_end(edges: DataFrame | None, end: str, known: dict[str, DataFrame], kind: str = "*") -> DataFrame | None:
    """The edges whose ``end`` is a known node of its kind."""
    if edges is None or kind not in known:
        return None
    if not isinstance(known[kind], tuple):
        known[kind] = (small_side(known[kind], KNOWN_BYTES),)  # stored once for all edges of the kind
    return edges.join(known[kind][0].withColumnRenamed("node_id", end), end, "left_semi").select("src", "dst", "edge_type", "properties", "order")


def _first_edges(stored: DataFrame) -> DataFrame:
    """One row per (src, dst, type) with the first properties; only edges whose hash repeats go into an aggregate."""
    key = ["src", "dst", "edge_type"]
    hashed = stored.withColumn("_h", F.xxhash64(*key))
    twice = small_side(hashed.select("_h").groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    once = hashed.join(twice, "_h", "left_anti").select(*key, "properties")
    again = hashed.join(twice, "_h", "left_semi").groupBy(*key).agg(F.min_by("properties", "order").alias("properties"))
    return once.unionByName(again)


def banking_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Banking nodes and edges: blank ends are skipped, edges are neither checked nor merged."""
    nodes = build_nodes(tables, BANKING_NODES, [])
    links = F.transform(pipe_list("linked_alert_ids"), lambda a: F.when(nonblank("case_id").isNotNull(), _edge(
        F.concat(F.lit("FraudAlert:"), a), node_key("AMLCase", "case_id"), "LINKED_TO_CASE", 60)))
    edges = _edge_rows(tables, BANKING_EDGES, [], {"aml_cases": [links]})
    return nodes, edges.select("src", "dst", "edge_type")


# -- traversal ----------------------------------------------------------------------

def neighbors(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query_id, node_id, hop) within ``depth`` undirected hops, seeds excluded.

    Each hop keeps a (query, node) once, so a hub reached over many edges is expanded
    once. Edges are met by the stored frontier where they are read, once for each end; only
    a frontier beyond the broadcast limit puts them into an exchange.
    """
    seen = materialise(seeds.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        front = small_side(frontier.select("query_id", F.col("node_id").alias("_a")))
        step = (edges.select(F.col("src").alias("_a"), F.col("dst").alias("node_id")).join(front, "_a")
                .unionByName(edges.select(F.col("dst").alias("_a"), F.col("src").alias("node_id")).join(front, "_a"))
                .select("query_id", "node_id").distinct()
                .join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
                .withColumn("hop", F.lit(hop)))
        frontier = materialise(step) if hop < depth else step
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def ticket_links(tickets: DataFrame) -> DataFrame:
    """The columns of tickets that edges are made of, and the policies their keyword rules name (``_rules``)."""
    ends = [c for c in ("ticket_id", "customer_id", "product_id", "service_id", "assigned_team") if c in tickets.columns]
    return tickets.withColumn("_hay", ticket_haystack()).select("_ord", *ends, policy_ids(F.col("_hay")).alias("_rules"))


def edge_ends(tables: dict[str, DataFrame], as_built: bool = False) -> DataFrame:
    """(_a, node_id, _sure): the edges of ``build_edges`` from either end, as often as rows imply them and before ends are looked up.

    ``_sure`` tells that the row defines ``node_id`` itself or as its team. ``tickets`` may be given as ``ticket_links``.
    """
    owned = {entry[0]: entry[1] for entry in SUPPORT_NODES}
    if "tickets" in tables and "_rules" not in tables["tickets"].columns:
        tables = {**tables, "tickets": ticket_links(tables["tickets"])}

    def both(src, dst, src_sure: bool, dst_sure: bool) -> list[Column]:
        return [F.struct(a.alias("_a"), z.alias("node_id"), F.lit(sure).alias("_sure")) for a, z, sure in ((src, dst, dst_sure), (dst, src, src_sure))]

    def each(ids: Column, other: Column, kind: str, other_sure: bool) -> Column:
        """Edges between ``other`` and every id of an array."""
        return F.flatten(F.transform(ids, lambda x: F.array(*both(F.concat(F.lit(kind + ":"), x), other, False, other_sure))))

    parts = []
    for table, df in tables.items():
        have, found, arrays = set(df.columns), [], []
        for t, st, sc, dt, dc, _ in SUPPORT_EDGES:
            if t == table and {sc, dc} <= have and not (as_built and dc == "runbook_policy_id"):
                ok = nonblank(sc).isNotNull() & nonblank(dc).isNotNull()
                found += [F.when(ok, e) for e in both(node_key(st, sc), node_key(dt, dc), owned.get(t) == st, owned.get(t) == dt)]
        for t, key, owner, _, kind in TEAM_COLUMNS:
            if t == table and owner in have:
                found += [F.when(nonblank(owner).isNotNull(), e) for e in both(node_key(kind, key), team_key(owner), True, True)]
        if table == "tickets":
            arrays.append(each(F.col("_rules"), node_key("Ticket", "ticket_id"), "Policy", True))
        if table == "github_issues":
            arrays.append(each(pipe_list("linked_ticket_ids"), node_key("GitHubIssue", "issue_id"), "Ticket", True))
        if table == "ticket_resolutions":
            for kind, c in (("Policy", "linked_policy_id"), ("GitHubIssue", "linked_issue_id")):
                found += both(node_key("Ticket", "ticket_id"), node_key(kind, c), False, False)
        arrays += [F.array(*found)] if found else []
        if arrays:
            every = F.array_compact(F.concat(*arrays))
            parts.append(df.select(F.explode_outer(every).alias("_e")).where("_e IS NOT NULL").select("_e.*"))
    return reduce(DataFrame.unionByName, parts)


def table_neighbors(tables: dict[str, DataFrame], seeds: DataFrame, depth: int, as_built: bool = False) -> DataFrame:
    """``neighbors`` over the edges of the tables without building them.

    Each hop reads the tables and keeps the ends that the frontier meets, so that no edge is stored, repeated edges meet in
    the (query, node) they lead to, and only nodes that were reached are looked up. A frontier holds known nodes only.
    """
    if "tickets" in tables and "_rules" not in tables["tickets"].columns:
        tables = {**tables, "tickets": materialise(ticket_links(tables["tickets"]))}
    ends = edge_ends(tables, as_built)
    known = {kind: tables[t].select(node_key(kind, key).alias("node_id")) for t, kind, key, *_ in SUPPORT_NODES if t in tables}
    known["Team"] = reduce(DataFrame.unionByName, [
        tables[t].where(nonblank(owner).isNotNull()).select(team_key(owner).alias("node_id"))
        for t, _, owner, _, _ in TEAM_COLUMNS if t in tables and owner in tables[t].columns] or [ends.select("node_id").limit(0)])

    def among(rows: DataFrame, kinds) -> DataFrame:
        """The rows whose node is a known one of these kinds."""
        asked = small_side(rows.select("node_id").distinct())
        ids = reduce(DataFrame.unionByName, [known[kind] for kind in kinds if kind in known])
        return rows.join(small_side(ids.join(asked, "node_id", "left_semi").distinct()), "node_id", "left_semi")

    looked_up = ("Policy", "Product", "Service", "Account", "Customer", "Ticket", "GitHubIssue")
    seen = materialise(seeds.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0)))
    frontier = among(seen, known)
    for hop in range(1, depth + 1):
        front = small_side(frontier.select("query_id", F.col("node_id").alias("_a")))
        met = materialise(ends.join(front, "_a").groupBy("query_id", "node_id").agg(F.max("_sure").alias("_sure"))
                          .join(small_side(seen.select("query_id", "node_id")), ["query_id", "node_id"], "left_anti"))
        cols = ["query_id", "node_id", F.lit(hop).alias("hop")]
        frontier = met.where("_sure").select(*cols).unionByName(among(met.where("NOT _sure"), looked_up).select(*cols))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


# -- search -------------------------------------------------------------------------

def node_haystack() -> Column:
    props = F.concat_ws(" ", F.map_values("properties"))
    return F.lower(F.concat_ws(" ", "node_id", "node_type", "label", "text", props))


LEAD_SHARE = 256  # the nodes with the most tokens, about one in so many, are scored first
SCAN_BYTES, SCAN_CELLS = 4 << 20, 1 << 23  # of stored questions and tokens, and tokens times questions, that a task may hold


def search_nodes(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-k nodes per query by substring hits.

    +1 for every query token (repeats count) inside the node text, +5 when the whole query
    is inside it, +4 when the label equals the query. A token has only word characters, so
    it lies inside one word. While the questions fit into a task, nodes are matched where they are read and a task
    leaves only the first k nodes of each question. Else the grams of distinct words meet those of the tokens, and a
    node's words are matched by equality. A node becomes the set of its tokens, nodes with the same set are scored
    k times, and a node that can't come near a query's k-th score is not scored for it.
    """
    base = nodes.withColumn("_hay", node_haystack())
    q = materialise(queries.select("query_id", F.lower(F.btrim("query", F.lit(" \t\n\r\f\v"))).alias("_q")))
    toks = materialise(q.select("query_id", F.explode(tokens("_q", "graph")).alias("token"))
                       .groupBy("query_id", "token").agg(F.count("*").alias("w")))
    sets = _scanned(base, q, toks, k)
    if sets is not None:
        base = sets = materialise(sets)
    else:
        word_list = F.array_distinct(F.regexp_extract_all("_hay", F.lit(K.WORD_PATTERN), F.lit(0)))
        placed = base.select("node_id", "node_type", "label", word_list.alias("_ws")).repartition("node_id")
        vocab = materialise(base.select(F.explode_outer(word_list).alias("_w")).distinct())
        sets = materialise(_token_sets(placed, _word_tokens(vocab, toks.select("token").distinct())))
    order = [F.col("node_type"), F.col("label"), F.col("node_id")]
    few = materialise(top_k(sets, ["tokens"], order, k).drop("rank"))
    cut = few.agg(F.percentile_approx(F.size("tokens"), 1 - 1 / LEAD_SHARE)).first()[0]
    held = few.select(F.col("node_id").alias("doc_key"), "node_type", "label", (F.size("tokens") >= F.lit(cut or 0)).alias("lead"),
                      F.lit("w").alias("kind"), F.explode("tokens").alias("term"), F.lit(1.0).alias("n"))
    items = toks.select("query_id", F.lit("w").alias("kind"), F.col("token").alias("term"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("bonus"))
    scored = best_documents(held, items, k, [F.col("score").desc(), F.col("node_type"), F.col("label"), F.col("doc_key")], ("node_type", "label"), first=F.col("lead"))
    scored = scored.select("query_id", F.col("doc_key").alias("node_id"), "node_type", "label", F.col("score").cast("long").alias("score"))
    # the whole query can only be inside a node that holds all its tokens, the rarest among them
    df = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("_df"))
    need = toks.join(df, "token", "left").groupBy("query_id").agg(
        F.collect_set("token").alias("_need"), F.sum("w").alias("_all"), F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "token")).alias("_r"))
    need = small_side(need.where("_r.df > 0").select("query_id", "_need", "_all", F.col("_r.token").alias("token")))
    every = (sets.select("node_id", "tokens", F.explode("tokens").alias("token")).join(need, "token")
             .where(F.size(F.array_except("_need", "tokens")) == 0).select("node_id", "query_id", "_all"))
    full = (base.select("node_id", "node_type", "label", "_hay").join(small_side(every), "node_id").join(q, "query_id")
            .where(F.col("_hay").contains(F.col("_q")))
            .select("query_id", "node_id", "node_type", "label",
                    (F.col("_all") + 5 + F.when(F.lower("label") == F.col("_q"), 4).otherwise(0)).alias("score")))
    full = materialise(full)
    scored = scored.join(full.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").unionByName(full)
    # queries without a token of two characters are matched as plain substrings
    bare = materialise(q.join(toks.select("query_id").distinct(), "query_id", "left_anti").where("_q <> ''"))
    if not bare.isEmpty():
        every = nodes.withColumn("_hay", node_haystack())
        found = (substring_pairs(every, "node_id", "_hay", bare, "_q").join(bare, "_q")
                 .join(nodes.select("node_id", "node_type", "label"), "node_id")
                 .select("query_id", "node_id", "node_type", "label",
                         (F.lit(5) + F.when(F.lower("label") == F.col("_q"), 4).otherwise(0)).cast("long").alias("score")))
        scored = scored.unionByName(found)
    return top_k(scored, ["query_id"], [F.col("score").desc(), *order], k)


def _scanned(base: DataFrame, q: DataFrame, toks: DataFrame, k: int) -> DataFrame | None:
    """(node_id, node_type, label, tokens, _hay) of the nodes that can be among the first k, or None where a task can't hold the questions.

    ``q`` and ``toks`` are stored; their sizes are looked at before they are read.
    """
    if stored_bytes(q) + stored_bytes(toks) > SCAN_BYTES:
        return None
    held = toks.collect()
    ids, words = ({x: i for i, x in enumerate(dict.fromkeys(r[c] for r in held))} for c in ("query_id", "token"))
    if len(ids) * len(words) > SCAN_CELLS:
        return None
    weights = np.zeros((len(words), len(ids)), dtype=np.int64)
    for r in held:
        weights[words[r["token"]], ids[r["query_id"]]] += r["w"]
    asked = [[] for _ in ids]
    for r in q.collect():
        if r["query_id"] in ids and r["_q"]:
            asked[ids[r["query_id"]]].append(r["_q"])
    rows = base.select("node_id", "node_type", "label", F.lower("label").alias("low"), "_hay")
    return rows.mapInArrow(leading_nodes(list(words), weights, asked, k),
                           "node_id string, node_type string, label string, tokens array<string>, _hay string")


def _word_tokens(vocab: DataFrame, toks: DataFrame, n: int = 4) -> DataFrame:
    """(_w, tokens) for the words with a token inside. A token is filed under its first n-gram, a shorter one under itself."""
    filed = small_side(toks.select("token", F.substring("token", 1, n).alias("_g")))
    sizes = sorted(r[0] for r in filed.select(F.length("_g")).distinct().collect())  # at most n numbers
    none = F.array().cast("array<string>")
    grams = F.array_distinct(F.flatten(F.array(none, *[
        F.when(F.length("_w") >= m, F.transform(F.sequence(F.lit(1), F.length("_w") - m + 1), lambda p: F.substr(F.col("_w"), p, F.lit(m)))).otherwise(none)
        for m in sizes])))
    met = vocab.select("_w", F.explode_outer(grams).alias("_g")).join(filed, "_g").where(F.col("_w").contains(F.col("token")))
    return met.groupBy("_w").agg(F.collect_set("token").alias("tokens"))


def _token_sets(placed: DataFrame, known: DataFrame) -> DataFrame:
    """(node_id, node_type, label, tokens) of the nodes with any token. ``placed`` is dealt by node_id and stays so."""
    words = placed.select("node_id", "node_type", "label", F.explode_outer("_ws").alias("_w")).join(small_side(known), "_w")
    return words.groupBy("node_id").agg(F.first("node_type").alias("node_type"), F.first("label").alias("label"),
                                        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))


def graph_context(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 5, depth: int = 2,
                  matched: DataFrame | None = None) -> dict[str, DataFrame]:
    """Matched nodes, their neighbourhoods and the induced edges for every query."""
    matched = materialise(search_nodes(nodes, queries, k)) if matched is None else matched
    seeds = matched.select("query_id", "node_id")
    near = neighbors(edges, seeds, depth)
    ids = seeds.withColumn("hop", F.lit(0)).unionByName(near).groupBy("query_id", "node_id").agg(F.min("hop").alias("hop"))
    ids = small_side(ids)
    src = ids.select("query_id", F.col("node_id").alias("src"))
    dst = ids.select("query_id", F.col("node_id").alias("dst"))
    induced = edges.select("src", "dst", "edge_type").join(src, "src").join(dst, ["query_id", "dst"])
    return {"matched": matched, "nodes": ids, "edges": induced.select("query_id", "src", "dst", "edge_type")}


def render_graph_context(ctx: dict[str, DataFrame], nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """One text block per query from sections that were already joined into lines."""
    def block(df, order, text, out):
        row = F.struct(*order, text.alias("_t"))
        part = df.groupBy("query_id", F.pmod(F.xxhash64("_k"), F.lit(64)).alias("_s")).agg(
            F.array_sort(F.collect_list(row)).alias("_xs"))
        return part.groupBy("query_id").agg(F.array_join(F.transform(
            F.array_sort(F.flatten(F.collect_list("_xs"))), lambda x: x["_t"]), "\n").alias(out))

    head = lambda *cs: F.concat(F.lit("- "), *cs)
    title = [F.col("node_type"), F.lit(" "), F.col("node_id"), F.lit(": "), F.col("label")]
    m = block(ctx["matched"].withColumn("_k", F.col("node_id")), ["rank"], head(*title), "_m")
    summary = clip(F.regexp_replace("text", "\n", " "), 240)
    c = ctx["nodes"].join(nodes, "node_id").withColumn("_k", F.col("node_id"))
    c = block(c, ["node_type", "label", "node_id"], head(*title, F.lit(". "), summary), "_c")
    e = ctx["edges"].withColumn("_k", F.col("src"))
    e = block(e, ["src", "dst", "edge_type"],
              head(F.col("src"), F.lit(" -["), F.col("edge_type"), F.lit("]-> "), F.col("dst")), "_e")
    df = queries.select("query_id").join(m, "query_id", "left").join(c, "query_id", "left").join(e, "query_id", "left")
    return df.select("query_id", F.concat_ws(
        "\n", F.lit("Graph Context\n\nMatched nodes:"), F.coalesce("_m", F.lit("- No matching nodes found.")),
        F.lit("\nContext nodes:"), "_c", F.lit("\nContext edges:"), "_e").alias("context_text"))
