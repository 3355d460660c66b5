"""Queries over corpus preparation, chunking, redaction, sessions and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.redaction import redact
from ..operators import chunking as C, corpus as CP, questions as QN, risk as RK
from ..streaming import ledger as L, rollups as RU, sessions as SS
from .registry import SHARED, any_term, query, sql_list

joined = lambda c: F.array_join(c, "|")
W = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL2 = "chr(10) || chr(10)"


# -- Markdown, HTML, issues ------------------------------------------------------------------

_MD = "regexp_replace(content, '\\r\\n|\\r', chr(10), 'g')"
_MD = f"regexp_replace({_MD}, '(?s)\\A---\\n.*?\\n---\\n', '', 'g')"
for _p in ["\\{%\\s*data\\s+variables\\.[^%]+%\\}", "\\{%[^%]*%\\}", "\\{\\{[^}]*\\}\\}"]:
    _MD = f"regexp_replace({_MD}, '{_p}', ' ', 'g')"
_MD = f"trim(regexp_replace({_MD}, '\\n{{3,}}', {NL2}, 'g'), {W})"


@query("clean_markdown", f"""
SELECT concat('github_docs::', path) AS doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^[ \\t]*# (.*)$', 1), {W}), ''), replace(regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', ''), '-', ' ')) AS title,
  split_part(path, '/', 1) AS section, concat('https://docs.github.com/en/', regexp_replace(path, '\\.md$', '')) AS url, text FROM (
  SELECT path, {_MD} AS text FROM md_files WHERE starts_with(path, 'get-started') OR starts_with(path, 'authentication') OR starts_with(path, 'repositories')) WHERE length(text) >= 300""")
def _(r):
    return CP.clean_markdown_corpus(r["md_files"]).select("doc_id", "title", "section", "url", "text")


_H = "regexp_replace(html, '\\r\\n|\\r', chr(10), 'g')"
for _t in ["script", "style", "noscript", "svg"]:
    _H = f"regexp_replace({_H}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '<br>', 'g')"


def _dec(e):
    for name, code in [("&nbsp;", 160), ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#39;", 39), ("&apos;", 39), ("&amp;", 38)]:
        e = f"replace({e}, '{name}', chr({code}))"
    return e


def _el(tag):
    return f"CASE WHEN regexp_matches(h, '(?i)<{tag}\\b') THEN regexp_extract(h, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|\\z)', 1) END"


SHARED["html0"] = f"SELECT page_id, {_H} AS h FROM pages"
SHARED["html1"] = f"SELECT page_id, coalesce({_el('title')}, '') AS t, coalesce({_el('main')}, {_el('article')}, {_el('body')}, h) AS root FROM html0"


@query("html_documents", f"""
SELECT concat('gitlab_handbook::page_', page_id) AS doc_id, coalesce(nullif(trim({_dec('t')}, {W}), ''), concat('page_', page_id)) AS title, text FROM (
  SELECT page_id, t, trim(regexp_replace({_dec("regexp_replace(root, '(?s)(?:<(?:!--.*?--|/?[a-zA-Z][^>]*|![^>]*|\\?[^>]*)>)+', chr(10), 'g')")}, '\\n{{3,}}', {NL2}, 'g'), {W}) AS text FROM html1) WHERE length(text) >= 300""")
def _(r):
    pages = r["pages"].select("html", F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"))
    return CP.html_to_documents(pages).select("doc_id", "title", "text")


def _rule(rules, default):
    return "CASE " + " ".join(f"WHEN {any_term('hay', ts)} THEN '{n}'" for n, ts in rules) + f" ELSE '{default}' END"


@query("prepare_issues", f"""
SELECT id AS ticket_id, number AS issue_number, title, {_rule(K.ISSUE_CATEGORIES, 'general_issue')} AS category, {_rule(K.ISSUE_PRIORITIES, 'low')} AS priority, state AS status, text FROM (
  SELECT id, number, title, state, lower(concat(title, ' ', trim(body, {W}))) AS hay,
    trim(concat_ws({NL2}, concat('Title: ', title), concat('State: ', state), concat('Labels: ', lang, ', ', source), concat('Body:' || chr(10), nullif(trim(body, {W}), ''))), {W}) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _ord) AS rn FROM raw_issues WHERE pull_request IS NULL) WHERE rn = 1) WHERE length(text) >= 30""")
def _(r):
    raw = r["raw_issues"].withColumn("labels", F.array("lang", "source"))
    return CP.prepare_issues(raw).select("ticket_id", "issue_number", "title", "category", "priority", "status", "text")


# -- links --------------------------------------------------------------------------------

_EXT = " OR ".join(f"suffix(lower(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '{e}')" for e in K.STATIC_EXTENSIONS)
SHARED["links0"] = f"""
SELECT url AS page_url, {_dec("trim(trim(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', 1)), '\"'''), " + W + ")")} AS h FROM pages"""
SHARED["links1"] = """
SELECT page_url, regexp_replace(regexp_replace(trim(CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN regexp_extract(page_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') || h
  WHEN h LIKE '#%' OR h LIKE '?%' THEN regexp_extract(page_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*') || h
  ELSE regexp_replace(regexp_extract(page_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*'), '[^/]*$', '') || h END), '[?#].*$', ''), '/$', '') AS link FROM links0 WHERE h <> ''"""
SHARED["links_"] = f"""
SELECT page_url, link FROM links1 WHERE regexp_matches(link, '(?i)^https?://') AND NOT ({_EXT})
  AND regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) IN (SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) FROM pages)"""


@query("link_graph", "SELECT page_url, link, count(*) AS n FROM links_ GROUP BY 1, 2")
def _(r):
    return CP.link_graph(r["pages"]).groupBy("page_url", "link").agg(F.count("*").alias("n"))


@query("crawl_frontier", """
SELECT DISTINCT link AS url FROM links_ WHERE link NOT IN (SELECT regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/$', '') FROM pages) AND link NOT IN (SELECT link FROM links_ WHERE link LIKE '%.' OR link LIKE '%,')""")
def _(r):
    links = CP.link_graph(r["pages"])
    visited = r["pages"].select(CP.normalise_url("url").alias("url"))
    failed = links.where(F.col("link").endswith(".") | F.col("link").endswith(",")).select(F.col("link").alias("url"))
    return CP.crawl_frontier(links, visited, failed)


@query("page_files", """
SELECT url, concat(replace(coalesce(nullif(trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), ''), 'index'), '/', '__'), '__', substr(sha1(url), 1, 10), '.html') AS file_name, sha256(html) AS sha256 FROM pages""")
def _(r):
    return CP.page_files(r["pages"])


# -- sections and chunks ----------------------------------------------------------------------

SHARED["sec_l"] = f"""
SELECT doc_id, x.i AS i, trim(x.l, {W}) AS l FROM (SELECT doc_id, unnest(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda v, k: {{'l': v, 'i': k}})) AS x FROM md_docs)"""
SHARED["sec_f"] = """
SELECT *, coalesce(sum(CASE WHEN regexp_matches(l, '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS op FROM sec_l"""
SHARED["sec_h"] = """
SELECT *, CASE WHEN op THEN 0 ELSE length(regexp_extract(l, '^(#{1,4}) ', 1)) END AS lv FROM sec_f"""
SHARED["sec_s"] = """
SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM sec_h"""
SHARED["sec_t"] = """
SELECT doc_id, sec, max(lv) AS lv, max(CASE WHEN lv > 0 THEN trim(substr(l, lv + 1)) END) AS head, regexp_replace(trim(string_agg(l, chr(10) ORDER BY i), chr(10)), '\\n\\n+', '  ' || chr(10), 'g') AS t FROM sec_s GROUP BY 1, 2"""


@query("split_sections", """
SELECT doc_id AS origin_doc_id, CAST(ix AS INT) AS parent_index, concat('parent_', substr(md5(concat(source, '::', doc_id, '::', ix)), 1, 16)) AS parent_id, coalesce(h1, '') AS h1, t AS text FROM (
  SELECT s.doc_id, d.source, t, s.h1, row_number() OVER (PARTITION BY s.doc_id ORDER BY sec) - 1 AS ix FROM (
    SELECT doc_id, max(sec) AS sec, max(CASE WHEN lv = 1 THEN head END) AS h1own, string_agg(t, '  ' || chr(10) ORDER BY sec) AS t, max(h1) AS h1 FROM (
      SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, coalesce(starts_with(regexp_extract(lag(t) OVER w, '([^\\n]*)$', 1), '#') AND lag(dp) OVER w < dp, false) AS j FROM (
          SELECT *, CASE WHEN lv = 2 THEN (CASE WHEN h1 IS NOT NULL THEN 2 ELSE 1 END) WHEN lv = 1 THEN 1 WHEN lv = 0 THEN 0 ELSE lv END AS dp FROM (
            SELECT *, last_value(CASE WHEN lv = 1 THEN head END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS h1 FROM sec_t) WHERE t <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY sec))) GROUP BY doc_id, g) s
  JOIN md_docs d ON s.doc_id = d.doc_id)""")
def _(r):
    out = CP.split_sections(r["md_docs"])
    return out.select("origin_doc_id", "parent_index", "parent_id", F.coalesce("h1", F.lit("")).alias("h1"), "text")


@query("chunk_corpus")
def _(r):
    docs = r["corpus"].select("doc_id", "source", "source_type", "title", "path", "text")
    return C.chunk_corpus(docs).select("doc_id", "source", "chunk_index", "start_index", "chunk_id", "text")


@query("leaf_nodes")
def _(r):
    parents = r.shared("parents", lambda: CP.split_sections(r["md_docs"]))
    return C.build_leaves(parents).select("parent_id", "origin_doc_id", "leaf_id", "chunk_index", "text")


SHARED["raw_chunks"] = """
SELECT doc_id, source, x.i AS pos, x.l AS text FROM (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda v, k: {'l': v, 'i': k - 1})) AS x FROM documents)"""
SHARED["final_chunks"] = f"""
SELECT doc_id, source, text, ix AS chunk_index, length(text) AS chunk_len_chars, concat(substr(md5(CAST(doc_id AS STRING)), 1, 10), ':', ix, ':0:', substr(md5(text), 1, 8)) AS chunk_id FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS ix FROM raw_chunks
  WHERE length(trim(text, {W})) >= 80 AND len(regexp_extract_all(trim(text, {W}), '[\\p{{L}}\\p{{N}}_]')) >= 20)"""


def _final(r):
    lines = r["documents"].select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn(
        "part", F.lit(0)).withColumn("start_index", F.lit(0))
    return C.finalize_chunks(lines)


@query("finalize_chunks", "SELECT doc_id, chunk_index, chunk_len_chars, chunk_id, text FROM final_chunks")
def _(r):
    return _final(r).select("doc_id", "chunk_index", F.col("chunk_len_chars").cast("long").alias("chunk_len_chars"), "chunk_id", "text")


@query("chunk_stats", """
SELECT coalesce(d.source, 'ALL') AS source, d.documents, coalesce(chunks, 0) AS chunks, coalesce(min_chars, 0) AS min_chars, coalesce(max_chars, 0) AS max_chars, coalesce(avg_chars, 0) AS avg_chars FROM (
  SELECT source, count(*) AS documents FROM documents GROUP BY ROLLUP (source)) d LEFT JOIN (
  SELECT source, count(*) AS chunks, min(chunk_len_chars) AS min_chars, max(chunk_len_chars) AS max_chars, round(avg(chunk_len_chars), 6) AS avg_chars FROM final_chunks GROUP BY ROLLUP (source)) c
  ON d.source IS NOT DISTINCT FROM c.source""")
def _(r):
    s = C.chunk_stats(_final(r), r["documents"])
    return s.select("source", "documents", "chunks", F.col("min_chars").cast("long").alias("min_chars"), F.col("max_chars").cast("long").alias("max_chars"),
                    F.round("avg_chars", 6).alias("avg_chars"))


# -- redaction and answers ------------------------------------------------------------------

_F = "|".join(sorted(K.SENSITIVE_FIELDS, key=len, reverse=True))
_KEY = f"((?:\"|'')?(?:{_F})(?:\"|'')?\\s*:\\s*)"
_R = "regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)([^/\\s@]+@)', '\\1[REDACTED]@', 'g')"
_R = f"regexp_replace({_R}, '(?i)(\\bAuthorization\\b\\s*[:=]\\s*Bearer\\s+)(\\S+)', '\\1[REDACTED]', 'g')"
_R = f"regexp_replace({_R}, '(?i){_KEY}(\")(.*?)(\")', '\\1\\2[REDACTED]\\4', 'g')"
_R = f"regexp_replace({_R}, '(?i){_KEY}([^,\\s\\}}\\]]+)', '\\1[REDACTED]', 'g')"
_R = f"regexp_replace({_R}, '(?i)(\\b(?:{_F})\\b\\s*=\\s*)(\\S+)', '\\1[REDACTED]', 'g')"


@query("redact_documents", f"SELECT doc_id, {_R} AS text FROM documents")
def _(r):
    return redact(r["documents"], ["text"]).select("doc_id", "text")


_A = f"trim(content, {W})"
_A = f"trim(regexp_replace(regexp_replace(regexp_replace({_A}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', {NL2}, 'g'), {W})"


@query("clean_answers", f"""
SELECT session_id, turn, {_A.replace('content', "replace(text, 'Theo tài liệu được cung cấp, ', '')")} AS answer FROM (SELECT conv_id AS session_id, turn, text FROM conversations WHERE role = 'assistant')""")
def _(r):
    turns = r["conversations"].where("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), "turn", F.concat(F.lit("  Theo tài liệu được cung cấp, "), F.col("text")).alias("text"))
    return CP.clean_answers(turns).select("session_id", "turn", "answer")


# -- keyed state and roll-ups ------------------------------------------------------------------

@query("session_history", f"""
SELECT session_id, turn, role, trim(content, {W}) AS content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM session_turns WHERE trim(content, {W}) <> '') WHERE rn <= 6""")
def _(r):
    return SS.session_history(r["session_turns"]).select("session_id", "turn", "role", "content")


_N = "regexp_replace(trim({}, " + W + "), '\\s+', ' ', 'g')"
_CMP = "(?i)^(thế\\s+còn|vậy\\s+còn|còn)\\s+(.+?)\\s+thì\\s+sao\\??$"
_MARK = " OR ".join(f"contains(ql, '{m}')" for m in K.FOLLOW_UP_MARKERS)
_PRE = " OR ".join(f"starts_with(ql, '{m}')" for m in K.FOLLOW_UP_PREFIXES)
SHARED["fu0"] = f"""
SELECT session_id, turn, role, n, trim(content, {W}) AS question, {_N.format('content')} AS qn, lower({_N.format('content')}) AS ql,
  last_value(CASE WHEN role = 'user' AND trim(content, {W}) <> '' THEN {{'t': n, 'x': {_N.format('content')}}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
FROM (SELECT *, 1 + count(*) FILTER (WHERE trim(content, {W}) <> '') OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM session_turns)"""
SHARED["fu1"] = f"""
SELECT *, CASE WHEN p.t >= n - 6 THEN p.x ELSE '' END AS prev, ql <> '' AND (regexp_matches(ql, '{_CMP}') OR {_PRE} OR {_MARK} OR suffix(ql, 'thì sao?') OR suffix(ql, 'được không?')) AS fu FROM fu0 WHERE role = 'user'"""
SHARED["fu2"] = f"""
SELECT *, CASE WHEN n = 1 OR NOT fu THEN question WHEN coalesce(prev, '') = '' OR lower(prev) = ql THEN qn
  WHEN regexp_matches(qn, '{_CMP}') THEN concat(regexp_replace(prev, '[ ?.]+$', ''), ' — trường hợp ', regexp_extract(qn, '{_CMP}', 2), ' thì làm như thế nào?')
  WHEN {_MARK} THEN concat('Trong ngữ cảnh ''', prev, ''', hãy trả lời câu hỏi sau một cách cụ thể: ', qn) ELSE concat(prev, '. Câu hỏi tiếp theo liên quan: ', qn) END AS eff FROM fu1"""


@query("follow_ups", "SELECT session_id, turn, question, eff AS effective_question, eff <> question AS used_history FROM fu2")
def _(r):
    return QN.rewrite_follow_ups(r["session_turns"])


def _actions(r):
    return r["events"].select(
        F.col("event_id").alias("_ord"), F.concat(F.lit("key_"), F.col("user_id").cast("string"), F.lit("_"), F.col("props")).alias("idempotency_key"),
        F.concat(F.lit("act_"), F.col("user_id").cast("string"), F.lit("_"), F.col("props")).alias("action_id"), F.col("event_type").alias("action_name"),
        F.concat(F.lit("because "), "event_type").alias("reason"), F.when(F.col("value") > 40, "completed").otherwise("running").alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), F.lit("").alias("last_error"))


@query("action_ledger", """
SELECT concat('key_', user_id, '_', props) AS idempotency_key, concat('act_', user_id, '_', props) AS action_id, arg_min(event_type, event_id) AS action_name, arg_min(strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id) AS created_at,
  arg_max(CASE WHEN value > 40 THEN 'completed' ELSE 'running' END, event_id) AS status, arg_max(strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id) AS updated_at, count(*) AS attempt_count FROM events GROUP BY 1, 2""")
def _(r):
    return L.action_ledger(_actions(r)).select("idempotency_key", "action_id", "action_name", "created_at", "status", "updated_at", "attempt_count")


@query("metric_rollup", """
SELECT CASE event_type WHEN 'click' THEN 'counter' ELSE 'histogram' END AS kind, event_type AS name, concat_ws(',', CASE WHEN user_id % 3 > 0 THEN concat('group=', user_id % 3) END, 'source=events') AS attrs,
  count(*) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, arg_max(value, event_id) AS last FROM events GROUP BY 1, 2, 3""")
def _(r):
    attrs = F.create_map(F.lit("source"), F.lit("events"), F.lit("group"), F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 3).cast("string")).otherwise(""))
    s = r["events"].select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "counter").otherwise("histogram").alias("kind"),
                           F.col("event_type").alias("name"), attrs.alias("attributes"), "value", F.col("event_id").alias("_ord"))
    return RU.metric_rollup(s).withColumn("sum", F.round("sum", 6))


@query("request_stats", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS path, count(*) AS requests, count(*) FILTER (value >= 100) AS errors, count(*) FILTER (value < 20) AS low_confidence,
  round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM events GROUP BY 1, 2""")
def _(r):
    req = r["events"].select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.when(F.col("value") >= 100, 500).otherwise(200).alias("status_code"),
                             F.when(F.col("value") < 20, "low").otherwise("high").alias("confidence"), F.col("value").alias("duration_ms"))
    s = RU.request_stats(req)
    return s.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "path", "requests", "errors", "low_confidence",
                    F.round("avg_ms", 6).alias("avg_ms"), "max_ms")


_COUNTERS = ["critical", "escalation", "login", "api", "refund", "negative"]


def _sliding_sql(days: int) -> str:
    flags = ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in _COUNTERS)
    return f"""
SELECT strftime(d, '%Y-%m-%d') AS window_start, customer_id, count(*) FILTER (source_type = 'ticket') AS tickets, {flags}
FROM (SELECT *, date_trunc('day', at_) - to_days(CAST(unnest(range(0, {days})) AS INTEGER)) AS d FROM signals) GROUP BY 1, 2"""


def _sliding(r, days: int):
    s = RU.risk_sliding(RK.signals(r["recent_tickets"], r["risk_events"]), days)
    return s.select(F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "customer_id", "tickets", *_COUNTERS)


@query("risk_sliding", _sliding_sql(7))
def _(r):
    return _sliding(r, 7)


@query("risk_sliding_30d", _sliding_sql(30))
def _(r):
    return _sliding(r, 30)
