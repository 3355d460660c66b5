"""URL filters: host-suffix and path-prefix expressions joined with a rule list on short hash prefixes.

Built from column functions only. A URL is expanded into every pair of a host suffix (the host and each parent domain)
and a path prefix of a length that occurs among the rules. Expressions meet rules on the first bytes of their digest,
full digests confirm the match, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import store

PREFIX_HEX = 8  # characters of the digest that are joined on


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Null or a URL without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has columns ``host``, ``path`` (begins with ``/``, or empty for the whole host) and ``verdict``. A rule
    fits its host and all subdomains when the URL's path starts with the rule's path. Precedence: the longest rule,
    then the longer host, then ``block`` before ``allow``. Rows without a fitting rule get rule null and ``default``.

    Null, empty and scheme-less URLs have empty host and path and fit no rule. Rows are kept as they are, repeats
    included; columns of ``pages`` named like an added one are replaced. An empty rule list gives every row the
    default. Rules with a null or empty host fit nothing.

    Work grows with distinct (host, path) pairs: they are expanded, joined and reduced once, and one join brings the
    verdicts back. Only the lengths of rule paths (at most the longest path) come to the driver.
    """
    rules = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(
        F.col("host").alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    lengths = sorted(row[0] for row in rules.select(F.length("r_path")).distinct().collect())
    host, path = split_url(F.col(url))
    added = ("host", "path", "rule", "verdict")
    rows = pages.select(*[c for c in pages.columns if c not in added], host.alias("host"), path.alias("path"))
    if not lengths:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    urls = rows.select("host", "path").where(F.col("host") != "").distinct()
    expressions = (
        urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .where(F.col("suffix") != "")
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", digest(F.concat("suffix", "prefix")).alias("full"))
        .select("host", "path", "full", F.substring("full", 1, PREFIX_HEX).alias("short"))
    )
    rule_full = digest(F.concat("r_host", "r_path"))
    listed = rules.select("*", rule_full.alias("r_full"), F.substring(rule_full, 1, PREFIX_HEX).alias("short"))
    precedence = F.struct(
        F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"),
        F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("b"))
    fitting = (
        expressions.join(listed, "short").where(F.col("full") == F.col("r_full"))
        .where((F.col("host") == F.col("r_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("r_host"))))
        .where(F.startswith(F.col("path"), F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), precedence).alias("hit"))
        .select("host", "path", "hit.rule", "hit.verdict")
    )
    fitting = store(fitting)  # a stored side lets the join split a URL that very many rows share
    return rows.join(fitting, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
