"""Question analysis, intents, retrieval plans, routing and follow-up rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import contains_any, entity_ids, one_of, squeeze, str_array, strip, tokens
from ..streaming.sessions import clean_turns
from .relational import ordinal, running_last


# -- keyword analysis -----------------------------------------------------------------

def term_variants(t: Column) -> Column:
    """A term with its simple -ing and plural forms."""
    n = F.length(t)
    cut3 = F.substring(t, 1, n - 3)
    cut1 = F.substring(t, 1, n - 1)
    ing = t.endswith("ing") & (n > 5)
    return F.array_distinct(F.array_compact(F.array(
        t,
        F.when(t.endswith("e") & (n > 3), F.concat(cut1, F.lit("ing"))),
        F.when(ing, cut3),
        F.when(ing & ~cut3.endswith("e"), F.concat(cut3, F.lit("e"))),
        F.when(~t.endswith("s") & (n > 3), F.concat(t, F.lit("s"))),
        F.when(t.endswith("s") & (n > 4), cut1))))


def analyze_queries(df: DataFrame, text: str = "query") -> DataFrame:
    """Keyword groups, intents and source preferences as array columns, row by row."""
    none = F.array().cast("array<string>")
    q, compact = F.col("_q"), F.replace(F.col("_q"), F.lit(" "), F.lit(""))
    base = df.withColumn("_q", squeeze(text))
    own = F.filter(tokens(text, "analyser"), lambda t: ~one_of(t, K.ANALYSER_STOPWORDS)
                   & ((F.length(t) >= 4) | one_of(t, K.SHORT_KEYWORDS)))
    added = [F.when(q.contains(key) | compact.contains(key), str_array(words)).otherwise(none)
             for key, words in K.KEYWORD_EXPANSIONS]
    by_phrase = [contains_any(q, phrases) for _, phrases, *_ in K.ANALYSER_INTENTS]
    added += [F.when(hit, str_array(rule[3])).otherwise(none) for hit, rule in zip(by_phrase, K.ANALYSER_INTENTS)]
    base = base.withColumn("all_keywords", F.array_distinct(F.flatten(F.transform(
        F.concat(own, *added), term_variants))))
    kws = F.col("all_keywords")
    plain = F.filter(kws, lambda k: ~one_of(k, K.PLATFORMS))
    strong = F.filter(plain, lambda k: ~one_of(k, K.GENERIC_KEYWORDS))
    hits = [h | (F.arrays_overlap(kws, str_array(rule[2])) if rule[2] else F.lit(False))
            for h, rule in zip(by_phrase, K.ANALYSER_INTENTS)]

    def gather(pick):
        return F.array_distinct(F.concat(*[F.when(h, str_array(pick(rule))).otherwise(none)
                                           for h, rule in zip(hits, K.ANALYSER_INTENTS)]))

    return (base.withColumn("platform_keywords", F.filter(kws, lambda k: one_of(k, K.PLATFORMS)))
            .withColumn("strong_keywords", F.when(F.size(strong) > 0, strong).otherwise(plain))
            .withColumn("weak_keywords", F.filter(plain, lambda k: one_of(k, K.GENERIC_KEYWORDS)))
            .withColumn("intent_labels", gather(lambda r: [r[0]]))
            .withColumn("preferred_sources", gather(lambda r: r[4]))
            .withColumn("penalized_sources", gather(lambda r: r[5]))
            .withColumn("phrase_keywords", gather(lambda r: r[6]))
            .drop("_q"))


# -- intents and retrieval plans ------------------------------------------------------

def query_intent(c="query") -> Column:
    toks = tokens(c, "intent")
    out = None
    for name, words in K.INTENT_RULES:
        hit = F.arrays_overlap(toks, str_array(words))
        if name == "service_owner":
            hit = hit | F.lower(F.col(c)).contains("service owner")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def _by_intent(intent: Column, table, make) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(intent == name, make(value)) if out is None else out.when(intent == name, make(value))
    return out


def plan_retrieval(df: DataFrame, base_source_types: list[str] | None = None) -> DataFrame:
    """First-attempt filters: allowed source types by intent and one id per typed field."""
    df = df.withColumn("intent", query_intent("query"))
    types = str_array(base_source_types) if base_source_types else _by_intent(F.col("intent"), K.INTENT_SOURCES, str_array)
    df = df.withColumn("source_types", types).withColumn("_ids", entity_ids("query"))
    for prefix, field in K.FILTER_FIELD_OF_PREFIX:
        df = df.withColumn(field, F.get(F.filter("_ids", lambda x: x.startswith(prefix)), F.lit(0)))
    return df.withColumn("attempt", F.lit(1)).withColumn("search_text", F.col("query")).drop("_ids")


def expand_plan(df: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """Second attempt for low-evidence rows; ``missing_source_types`` is an array column."""
    some = F.size("missing_source_types") > 0
    for _, field in K.FILTER_FIELD_OF_PREFIX:
        if field not in protected:
            df = df.withColumn(field, F.when(~some, F.col(field)))
    wider = F.array_sort(F.array_union("source_types", "missing_source_types"))
    text = F.concat_ws(
        " ", F.nullif(strip("query"), F.lit("")), _by_intent(F.col("intent"), K.INTENT_EXPANSIONS, F.lit),
        F.when(some, F.concat(F.lit("include missing source types: "), F.array_join("missing_source_types", ", "))))
    return (df.withColumn("source_types", F.when(some, wider).otherwise(F.col("source_types")))
            .withColumn("search_text", text).withColumn("attempt", F.lit(2)))


# -- routing ------------------------------------------------------------------------

def term_pattern(term: str) -> str:
    """A term with flexible inner spaces and no word character on either side."""
    body = "\\s+".join(re.escape(p) for p in term.lower().split(" "))
    return f"(?<![\\p{{L}}\\p{{N}}_]){body}(?![\\p{{L}}\\p{{N}}_])"


def matched_terms(text: Column, terms) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(term_pattern(t)), t) for t in dict.fromkeys(terms)]))


def route_questions(df: DataFrame, mode: str = "auto", text: str = "query") -> DataFrame:
    """route, reason, score and matched signals for every question."""
    raw = strip(F.coalesce(F.col(text), F.lit("")))
    mode = (mode or "auto").strip().lower()
    forced = {"answer": ("answer_from_kb", "Mode was explicitly forced to answer."),
              "search": ("retrieve_only", "Mode was explicitly forced to search.")}
    none = F.array().cast("array<string>")
    if mode in forced:
        route, reason = forced[mode]
        return df.withColumn("route", F.lit(route)).withColumn("reason", F.lit(reason)) \
            .withColumn("score", F.lit(0)).withColumn("matched_signals", none)
    signals = matched_terms(F.lower(raw), K.SOURCE_LISTING_SIGNALS)
    short = F.length(F.regexp_replace(raw, "\\s+", "")) < K.MIN_QUESTION_CHARS
    df = df.withColumn("_s", signals)
    hit = ~short & (F.size("_s") > 0)
    return (df.withColumn("route", F.when(short, "clarify").when(hit, "retrieve_only").otherwise("answer_from_kb"))
            .withColumn("reason", F.when(raw == "", "Question is empty.")
                        .when(short, "Question is too short to retrieve evidence reliably.")
                        .when(hit, "The user appears to want related sources instead of a synthesized answer.")
                        .otherwise("Defaulting to a synthesized answer from the knowledge base."))
            .withColumn("score", F.when(hit, F.size("_s")).otherwise(0))
            .withColumn("matched_signals", F.when(hit, F.col("_s")).otherwise(none)).drop("_s"))


def assign_domains(df: DataFrame, text: str = "query") -> DataFrame:
    """Ranked domains per question by distinct keyword hits, with scores and a reason."""
    low = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    entries = F.array(*[
        F.struct((-F.size(matched_terms(low, words))).alias("neg"), F.lit(prio).alias("prio"), F.lit(name).alias("name"))
        for name, prio, words in K.DOMAIN_KEYWORDS])
    df = df.withColumn("_m", F.array_sort(F.filter(entries, lambda e: e["neg"] < 0)))
    any_hit = F.size("_m") > 0
    names = F.transform("_m", lambda e: e["name"])
    return (df.withColumn("domains", F.when(any_hit, names).otherwise(str_array([K.DEFAULT_DOMAIN])))
            .withColumn("domain_scores", F.transform("_m", lambda e: -e["neg"]))
            .withColumn("domain_reason", F.when(any_hit, F.concat(F.lit("Supervisor selected agents: "), F.array_join(names, ", ")))
                        .when(low == "", "Question is empty, so no domain could be selected reliably.")
                        .otherwise("No clear domain matched; defaulting to GitHub Docs.")).drop("_m"))


def dispatch_questions(df: DataFrame, mode: str = "auto", text: str = "query") -> DataFrame:
    """Dispatch decision on top of ``assign_domains``."""
    raw = strip(F.coalesce(F.col(text), F.lit("")))
    short = F.length(F.regexp_replace(raw, "\\s+", "")) < K.MIN_QUESTION_CHARS
    mode = (mode or "auto").strip().lower()
    forced = {"search": "retrieve_only", "answer": "answer_from_kb"}.get(mode)
    if forced:
        route = F.when(raw == "", "clarify").otherwise(forced)
        why = F.when(raw == "", "Question is empty.").otherwise(
            F.concat(F.lit(f"Mode was explicitly forced to {mode}. "), "domain_reason"))
    else:
        route = F.when(short, "clarify").otherwise("answer_from_kb")
        why = F.when(raw == "", "Question is empty.").when(
            short, "Question is too short to retrieve evidence reliably.").otherwise(F.col("domain_reason"))
    return df.withColumn("response_route", route).withColumn("route_reason", why)


# -- follow-ups -----------------------------------------------------------------------

_COMPARISON = "(?iu)^(thế\\s+còn|vậy\\s+còn|còn)\\s+(.+?)\\s+thì\\s+sao\\??$"


def _norm(c) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\\s+", " ")


def is_follow_up(question: Column) -> Column:
    low = F.lower(_norm(question))
    starts = None
    for p in K.FOLLOW_UP_PREFIXES:
        starts = low.startswith(p) if starts is None else starts | low.startswith(p)
    return (low != "") & (low.rlike(_COMPARISON) | starts | contains_any(low, K.FOLLOW_UP_MARKERS)
                          | low.endswith("thì sao?") | low.endswith("được không?"))


def rewrite_question(question: Column, previous: Column) -> Column:
    q, prev = _norm(question), _norm(previous)
    stem = F.regexp_replace(prev, "[ ?.]+$", "")
    topic = strip(F.regexp_extract(q, _COMPARISON, 2))
    compared = q.rlike(_COMPARISON) & (topic != "")

    def swap(old, new):
        return F.concat(F.regexp_replace(F.regexp_replace(prev, f"(?i)\\bbằng {old}\\b", f"bằng {new}"), "[ ?.]+$", ""),
                        F.lit(f" thay vì {old}?"))

    low_prev, low_topic = F.lower(prev), F.lower(topic)
    comparison = (F.when(low_prev.contains(" bằng ssh") & (low_topic == "https"), swap("SSH", "HTTPS"))
                  .when(low_prev.contains(" bằng https") & (low_topic == "ssh"), swap("HTTPS", "SSH"))
                  .otherwise(F.concat(stem, F.lit(" — trường hợp "), topic, F.lit(" thì làm như thế nào?"))))
    pronoun = F.concat(F.lit("Trong ngữ cảnh '"), prev, F.lit("', hãy trả lời câu hỏi sau một cách cụ thể: "), q)
    plain = F.concat(prev, F.lit(". Câu hỏi tiếp theo liên quan: "), q)
    return (F.when((prev == "") | (q == "") | (F.lower(prev) == F.lower(q)) | ~is_follow_up(question), q)
            .when(compared, comparison)
            .when(contains_any(F.lower(q), K.FOLLOW_UP_MARKERS), pronoun).otherwise(plain))


def rewrite_follow_ups(turns: DataFrame, history: int = 6) -> DataFrame:
    """(session, turn, question, effective_question, used_history) for every user turn.

    The history is the last ``history`` turns that have a text, however they are numbered. A
    blank user turn has no question to rewrite and counts for nothing.
    """
    kept = ordinal(clean_turns(turns), ["session_id"], [F.floor(F.col("turn") / 65536)], ["turn"], "_n")
    said = F.when(F.col("role") == "user", F.struct(F.col("_n").alias("n"), F.col("content").alias("text")))
    df = running_last(kept, ["session_id"], "_n", said, "_p")
    near = F.when(F.col("_p.n") >= F.col("_n") - history, F.col("_p.text"))
    df = df.where("role = 'user'").withColumn("question", F.col("content")).withColumn("previous", F.coalesce(near, F.lit("")))
    blank = turns.where("session_id IS NOT NULL").where(strip("role") == "user").where(strip(F.coalesce("content", F.lit(""))) == "")
    blank = blank.select("session_id", "turn", F.lit("").alias("question"), F.lit("").alias("previous"), F.lit(1).cast("long").alias("_n"))
    df = df.select("session_id", "turn", "question", "previous", "_n").unionByName(blank)
    has_history = F.col("_n") > 1
    effective = F.when(has_history & is_follow_up(F.col("question")),
                       rewrite_question(F.col("question"), F.col("previous"))).otherwise(F.col("question"))
    return df.select("session_id", "turn", "question", effective.alias("effective_question"),
                     (effective != F.col("question")).alias("used_history"))
