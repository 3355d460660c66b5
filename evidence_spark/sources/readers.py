"""Readers for the extract formats: CSV, JSON lines, Markdown with front matter, node files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .. import constants as K
from ..functions.text import BLANKS, strip, sval
from ..operators.corpus import markdown_title
from ..operators.documents import with_metadata
from ..operators.relational import keep_last
from ..specs import DomainSpec, TableSpec, get_domain

BAD = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _need(spark, path):
    if not path_exists(spark, path):
        raise FileNotFoundError(f"missing input: {path}")


def read_csv(spark: SparkSession, path: str, keep_surplus: bool = False) -> DataFrame:
    """Header CSV with every column a string; ``_ord`` is the line number of the record.

    With ``keep_surplus`` a row with more cells than the header carries its raw text in
    ``_corrupt_record``.
    """
    _need(spark, path)
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, BAD]])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path))
    df = df.withColumn("_ord", F.monotonically_increasing_id() + 2)
    return df if keep_surplus else df.drop(BAD)


def read_entity_csv(spark: SparkSession, path: str, spec: TableSpec, source: str = K.SUPPORT_DOMAIN) -> DataFrame:
    df = read_csv(spark, path)
    return with_metadata(df, spec.source_type, [spec.key], spec.title_fields, spec.path, source)


def read_entity_jsonl(spark: SparkSession, path: str, schema: StructType, on_error: str = "fail",
                      missing_ok: bool = False) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    on_error="fail" raises with the number of the first bad line, "quarantine" keeps bad
    lines with their text in ``_corrupt_record``.
    """
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("_ord", StringType())]))
    _need(spark, path)
    full = StructType([*schema.fields, StructField(BAD, StringType())])
    lines = spark.read.text(path).withColumn("_ord", F.monotonically_increasing_id() + 1).where(strip("value") != "")
    parsed = lines.withColumn("_j", F.from_json(strip("value"), full, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}))
    bad = F.coalesce(F.col(f"_j.{BAD}"), F.when(~strip("value").startswith("{"), F.col("value")))
    df = parsed.select(*[F.col(f"_j.`{f.name}`").alias(f.name) for f in schema.fields], bad.alias(BAD), "_ord")
    if on_error == "quarantine":
        return df
    first = df.where(F.col(BAD).isNotNull()).agg(F.min("_ord")).first()[0]
    if first is not None:
        raise ValueError(f"invalid JSON object in {path} at line {first}")
    return df.drop(BAD)


def front_matter(c: str = "value") -> tuple[Column, Column]:
    """(fields, content) of a Markdown text; list values are joined by ``|``."""
    text = F.regexp_replace(F.col(c), "\r\n|\r", "\n")
    block = "(?s)\\A[ \t]*---[ \t]*\n(.*?)(?:^|\n)[ \t]*---[ \t]*(?:\n|\\z)(.*)\\z"
    found = text.rlike(block)
    head = F.when(found, F.regexp_extract(text, block, 1)).otherwise("")
    rows = F.filter(F.split(head, "\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))

    def value(line):
        raw = F.btrim(F.substr(line, F.instr(line, ":") + 1), F.lit(BLANKS))
        items = F.split(F.btrim(raw, F.lit("[]")), ",")
        listed = F.array_join(F.filter(F.transform(items, lambda i: F.btrim(F.btrim(i, F.lit(BLANKS)), F.lit("\"'"))), lambda i: i != ""), "|")
        return F.when(raw.startswith("[") & raw.endswith("]"), listed).otherwise(F.btrim(raw, F.lit("\"'")))

    entries = F.filter(F.transform(rows, lambda x: F.struct(F.trim(F.split(x, ":")[0]).alias("k"), value(x).alias("v"))), lambda e: e["k"] != "")
    # a repeated key keeps its last value
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    body = F.btrim(F.when(found, F.regexp_extract(text, block, 2)).otherwise(text), F.lit(BLANKS))
    return last, body


POLICY_FIELDS = ["policy_type", "product_id", "service_id", "owner_team", "effective_date", "review_date", "tags", "summary"]


def read_markdown_corpus(spark: SparkSession, glob: str, root: str = "", ids: dict[str, str] | None = None,
                         keep_front_matter: bool = False) -> DataFrame:
    """One row per Markdown file: ids and titles from front matter, heading or file name.

    ``ids`` maps file names to fixed ids; with ``keep_front_matter`` the content is the
    whole file.
    """
    _need(spark, glob)
    raw = spark.read.text(glob, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    name = F.substring_index("_file", "/", -1)
    stem = F.regexp_replace(name, "\\.md$", "")
    fields, body = front_matter()
    df = raw.withColumn("_fm", fields).withColumn("_body", body)
    given = F.create_map(*[x for kv in (ids or {"": ""}).items() for x in map(F.lit, kv)])
    if keep_front_matter:
        content, fallback = F.col("value"), F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))
        title = F.coalesce(F.nullif(markdown_title("value"), F.lit("")), fallback)
        policy = F.coalesce(given[name], stem)
    else:
        content = F.col("_body")
        title = F.coalesce(F.nullif(sval(F.col("_fm")["title"]), F.lit("")), F.nullif(markdown_title("_body"), F.lit("")), stem)
        policy = F.coalesce(F.nullif(sval(F.col("_fm")["policy_id"]), F.lit("")), given[name], stem)
    relative = F.when(F.lit(root) == "", F.col("_file")).otherwise(F.regexp_replace("_file", "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", ""))
    out = df.select(policy.alias("policy_id"), title.alias("title"), relative.alias("path"), content.alias("content"),
                    *[sval(F.col("_fm")[c]).alias(c) for c in POLICY_FIELDS])
    return out.withColumn("_ord", F.abs(F.xxhash64("path")))


def _schema(text: str) -> StructType:
    types = {"string": StringType(), "long": LongType(), "int": IntegerType(), "array<string>": ArrayType(StringType())}
    return StructType([StructField(*(lambda n, t: (n, types[t]))(*part.split())) for part in text.split(", ")])


ISSUE_SCHEMA = _schema(
    "issue_id string, repo string, number long, title string, body string, state string, labels array<string>, service_id string, "
    "product_id string, linked_ticket_ids array<string>, severity string, created_at string, updated_at string, closed_at string, "
    "assignee_team string, resolution_summary string")


def load_table(spark: SparkSession, domain: DomainSpec, spec: TableSpec, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{spec.path}"
    if spec.format == "jsonl":
        df = read_entity_jsonl(spark, path, ISSUE_SCHEMA)
        for c in ("labels", "linked_ticket_ids"):
            df = df.withColumn(c, F.array_join(c, "|"))
        return with_metadata(df, spec.source_type, [spec.key], spec.title_fields, spec.path, domain.name)
    if spec.format == "markdown":
        banking = domain.name == K.BANKING_DOMAIN
        df = read_markdown_corpus(spark, path, root, domain.policy_ids or None, keep_front_matter=banking)
        return with_metadata(df, spec.source_type, [spec.key], spec.title_fields, "", domain.name)
    return read_entity_csv(spark, path, spec, domain.name)


def load_domain(spark: SparkSession, name: str, root: str, views: bool = False) -> dict[str, DataFrame]:
    """All tables of a registered domain, optionally as temporary views."""
    domain = get_domain(name)
    tables = {t.name: load_table(spark, domain, t, root) for t in domain.tables}
    if views:
        for t, df in tables.items():
            df.createOrReplaceTempView(f"{domain.name}_{t}")
    return tables


NODE_SCHEMA = _schema(
    "doc_id string, origin_doc_id string, parent_id string, parent_index int, parent_level string, node_type string, leaf_id string, "
    "chunk_id string, chunk_index int, start_index int, source string, source_type string, title string, path string, url string, "
    "h1 string, h2 string, h3 string, h4 string, text string")


def load_hierarchy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, parents); absent files read as empty, the last parent of an id wins."""
    leaves = read_entity_jsonl(spark, f"{folder}/leaf_nodes.jsonl", NODE_SCHEMA, missing_ok=True)
    parents = read_entity_jsonl(spark, f"{folder}/parent_nodes.jsonl", NODE_SCHEMA, missing_ok=True)
    return leaves, keep_last(parents, "parent_id", "_ord")
