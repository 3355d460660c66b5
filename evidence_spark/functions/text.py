"""Column helpers for the text and id conventions shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as K

BLANKS = " \t\n\r\f\v"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def sval(c) -> Column:
    """Missing becomes the empty string, everything else is trimmed text."""
    return F.coalesce(strip(col(c).cast("string")), F.lit(""))


def nonblank(c) -> Column:
    """NULL for missing or blank text, the trimmed text otherwise."""
    return F.nullif(sval(c), F.lit(""))


def first_nonblank(*cols) -> Column:
    return F.coalesce(*[nonblank(c) for c in cols], F.lit(""))


def line(label: str, value) -> Column:
    """``Label: value`` or NULL, so that ``concat_ws`` drops blank fields."""
    return F.concat(F.lit(label + ": "), nonblank(value))


def lines(*cols) -> Column:
    return strip(F.concat_ws("\n", *cols))


def dashed(*cols) -> Column:
    return F.concat_ws(" - ", *[nonblank(c) for c in cols])


def pipe_list(c) -> Column:
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), "\\|"), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def squeeze(c) -> Column:
    """Lower-cased text with every run of white space reduced to one blank."""
    return F.regexp_replace(F.lower(strip(F.coalesce(col(c), F.lit("")))), "\\s+", " ")


def one_of(c, values) -> Column:
    return col(c).isin(list(values))


def contains_any(c, terms) -> Column:
    return reduce(lambda a, b: a | b, [col(c).contains(t) for t in terms])


def str_array(values) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def record_text(df_columns, skip=("_ord", "metadata")) -> Column:
    """All scalar columns of a record as one lower-cased text."""
    cols = [F.col(f"`{c}`").cast("string") for c in df_columns if c not in skip]
    return F.regexp_replace(F.lower(F.concat_ws(" ", *cols)), "\\s+", " ")


# -- tokens -----------------------------------------------------------------------

def words(c, pattern: str = K.WORD_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(pattern), F.lit(0))


def tokens(c, profile: str = "retrieval") -> Column:
    """Token array for one of the six profiles used across the operators."""
    if profile == "retrieval":
        stop = str_array(K.STOPWORDS)
        kept = F.filter(words(c), lambda t: F.length(t) > 2)
        return F.array_except(F.array_distinct(kept), stop)
    if profile == "graph":
        return F.filter(words(c), lambda t: F.length(t) > 1)
    if profile == "eval":
        return F.array_distinct(words(c, K.EVAL_WORD_PATTERN))
    if profile == "sufficiency":
        return F.array_distinct(F.filter(words(c), lambda t: F.length(t) > 2))
    if profile == "intent":
        return F.array_distinct(words(c))
    if profile == "analyser":
        return F.regexp_extract_all(squeeze(c), F.lit(K.ANALYSER_WORD_PATTERN), F.lit(0))
    raise ValueError(f"unknown token profile: {profile}")


def entity_ids(c) -> Column:
    """Distinct typed ids in order of appearance, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(K.ENTITY_ID_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def slug(c, limit: int = 64) -> Column:
    text = F.regexp_replace(squeeze(c), "[^a-zA-Z0-9]+", "-")
    return F.substring(F.btrim(text, F.lit("-")), 1, limit)


def after_first(c, sep: str) -> Column:
    """Text after the first separator; the whole text when there is none."""
    pos = F.instr(col(c), sep)
    return F.when(pos > 0, F.substr(col(c), pos + len(sep))).otherwise(col(c))


def after_last(c, sep: str) -> Column:
    return F.substring_index(col(c), sep, -1)


def clip(c, limit: int, tail: str = "...") -> Column:
    """Cut to ``limit`` characters including the tail."""
    return F.when(F.length(col(c)) > limit,
                  F.concat(F.substring(col(c), 1, limit - len(tail)), F.lit(tail))).otherwise(col(c))


def uuid5_dns(c) -> Column:
    """Version-5 UUID in the DNS namespace as a pure column expression."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(col(c), "UTF-8")))
    variant = F.lower(F.hex(
        F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))
        .bitwiseOR(F.lit(0x80))))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
