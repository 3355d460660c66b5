import uuid

import pytest

from pyspark.sql import functions as F

from evidence_spark.functions.text import pipe_list, uuid5_dns
from evidence_spark.operators import quality as Q, relational as R
from evidence_spark.sources.index import read_index, upsert_index


def test_lookup_keeps_last_and_blanks_misses(spark, rows):
    dim = spark.createDataFrame([(1, "a", "old"), (2, " a ", "new"), (3, "", "no")], "_ord long, k string, v string")
    fact = spark.createDataFrame([(1, " a"), (2, "zz"), (3, "")], "id long, k string")
    assert rows(R.lookup_join(fact, dim.withColumnRenamed("k", "dk"), "k", "dk", {"v": "v"}).select("id", "v"), "id") == [
        (1, "new"), (2, ""), (3, "")]


def test_nest_children_order_across_blocks(spark):
    child = spark.range(0, 500).selectExpr("499 - id AS _ord", "'p' AS k", "cast(499 - id as string) AS v")
    got = R.nest_children(child, "k", F.col("v"), block=7).first()["items"]
    assert got == [str(i) for i in range(500)]


def test_ordinal_equals_row_number_for_a_hot_key(spark):
    df = spark.range(0, 1000).selectExpr("'hot' AS k", "id AS o")
    got = R.ordinal(df, ["k"], [F.floor(F.col("o") / 64)], [F.col("o")], "n").where("n <> o + 1").count()
    assert got == 0


def test_running_last_crosses_blocks(spark, rows):
    df = spark.createDataFrame([("s", i) for i in range(20)], "s string, t long")
    out = R.running_last(df, ["s"], "t", F.when(F.col("t").isin(1, 9), F.col("t")), "p", block=4)
    want = [None, None] + [1] * 8 + [9] * 10
    assert [r["p"] for r in out.orderBy("t").collect()] == want


def test_substring_pairs_matches_brute_force(spark):
    texts = ["customer cust_1 party", "art", "x" * 80 + "y", ""]
    needles = ["art", "cust_1", "cust_12", "x" * 70, "x" * 70 + "z", "y"]
    hay = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    nd = spark.createDataFrame([(n,) for n in needles], "n string")
    got = {(r["id"], r["n"]) for r in R.substring_pairs(hay, "id", "t", nd, "n").collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}


def test_array_links_keep_order_and_drop_misses(spark):
    df = spark.createDataFrame([("i", "b| none |a")], "id string, l string")
    dim = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "_ord long, k string, v string")
    assert R.array_link_join(df, "id", pipe_list("l"), dim, "k", F.col("v")).first()["linked"] == ["B", "A"]


def test_unique_and_fk_messages(spark, rows):
    df = spark.createDataFrame([(2, "a"), (3, "a"), (4, ""), (5, "a"), (6, "b")], "_ord long, k string")
    got = rows(Q.check_unique(df, "t.csv", "k").select("line", "message"), "line")
    assert got == [(3, "t.csv:3: duplicate k 'a' (first seen on line 2)"), (4, "t.csv:4: missing k"),
                   (5, "t.csv:5: duplicate k 'a' (first seen on line 2)")]
    dst = spark.createDataFrame([("b",)], "k string")
    assert [r[1] for r in rows(Q.check_fk(df, "t", "k", dst, "d", "k").select("line", "rule"), "line")] == [
        "dangling_fk", "dangling_fk", "blank_fk", "dangling_fk"]
    assert Q.check_fk(df, "t", "k", dst, "d", "k", report_blank=False).where("rule = 'dangling_fk'").count() == 4
    assert Q.missing_columns(df, ["k", "z"]) == ["z"]


def test_uuid5_and_index_upsert(spark, tmp_path):
    keys = ["doc::1", "é", "leaf_9"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", uuid5_dns("k").alias("u")).collect()
    assert {r["k"]: r["u"] for r in got} == {k: str(uuid.uuid5(uuid.NAMESPACE_DNS, k)) for k in keys}
    path = str(tmp_path / "ix")
    first = spark.createDataFrame([(1, "a", "x" * 60, "t"), (2, "b", "y" * 60, "t"), (3, "c", "short", "t")],
                                  "_ord long, doc_id string, text string, source_type string")
    assert upsert_index(first, path).count() == 2
    upsert_index(first.where("doc_id = 'a'").withColumn("text", F.lit("z" * 60)), path)
    assert {r["doc_id"]: r["text"][0] for r in read_index(spark, path).collect()} == {"a": "z", "b": "y"}


def test_index_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "ix")
    docs = spark.createDataFrame([(i, f"d{i}", f"{i} " + "x" * 60, "t") for i in range(200)], "_ord long, doc_id string, text string, source_type string")
    upsert_index(docs, path, buckets=16)

    def files():
        return {f.rsplit("bucket_no=", 1)[1].split("/")[0]: f for f in read_index(spark, path).inputFiles()}

    before = files()
    extra = docs.where("doc_id = 'd7'").withColumn("text", F.lit("new " * 20)).withColumn("lang", F.lit("en"))
    assert upsert_index(extra, path).count() == 200
    after = files()
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    got = {r["doc_id"]: (r["text"], r["lang"]) for r in read_index(spark, path).collect()}
    assert got["d7"] == ("new " * 20, "en") and got["d8"] == ("8 " + "x" * 60, None)
    assert read_index(spark, path, 0).where("text like 'new%'").count() == 0
    assert upsert_index(docs.limit(0), path).count() == 200


def test_index_version_is_taken_once(spark, tmp_path, monkeypatch):
    from evidence_spark.sources import index
    path = str(tmp_path / "ix")
    docs = spark.createDataFrame([(1, "a", "x" * 60), (2, "b", "y" * 60)], "_ord long, doc_id string, text string")
    upsert_index(docs, path)
    commit = index._commit

    def late(*args):
        monkeypatch.setattr(index, "_commit", commit)
        upsert_index(docs.where("doc_id = 'a'").withColumn("text", F.lit("first " * 20)), path)
        return commit(*args)

    monkeypatch.setattr(index, "_commit", late)
    with pytest.raises(index.LostRace):
        upsert_index(docs.where("doc_id = 'a'").withColumn("text", F.lit("second " * 20)), path)
    assert {r["doc_id"]: r["text"][:5] for r in read_index(spark, path).collect()} == {"a": "first", "b": "yyyyy"}
    assert index.latest_version(spark, path) == 1
