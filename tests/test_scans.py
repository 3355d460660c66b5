"""Results that must not depend on what is stored or carried on the way."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from evidence_spark.operators import evidence as EV, graph as G
from evidence_spark.session import materialise
from evidence_spark.sources.index import upsert_index


def _shuffle_files(spark) -> int:
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return sum(1 for d in dirs for f in Path(d).rglob("shuffle_*.data"))


def _settles(spark, n) -> bool:
    """Files are removed in the background."""
    return any(_shuffle_files(spark) <= n or time.sleep(0.2) for _ in range(50))


def _dealt(spark):
    return spark.range(2000).groupBy(F.hash("id").alias("h")).agg(F.max("id").alias("m"))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """F5, F6, F8 to F14: every step of a query kept its shuffle files until the driver collected garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = spark.conf.get(setting), _shuffle_files(spark)
    stored = materialise(_dealt(spark))
    assert _settles(spark, before) and stored.count() == 2000
    assert spark.conf.get(setting) == held


def test_index_writes_leave_no_shuffle_files(spark, tmp_path):
    """F15"""
    before, docs = _shuffle_files(spark), _dealt(spark).select(
        F.col("h").cast("string").alias("doc_id"), F.lit("a text of an index that is long enough to be kept in it").alias("text"), F.col("m").alias("_ord"))
    merged = upsert_index(docs, str(tmp_path / "index"), buckets=4)
    assert _settles(spark, before)
    again = upsert_index(docs.where("m < 10").withColumn("text", F.concat("text", F.lit(" again"))), str(tmp_path / "index"))
    assert _settles(spark, before) and merged.count() == again.count() == 2000 and again.where("text LIKE '% again'").count() == 10


def test_evidence_carries_what_is_read(spark):
    """F5, F6, F8 to F14: the counts are those of the whole evidence, without texts and properties that nothing reads."""
    hits = spark.createDataFrame([(1, 1, "Status: open", {"source_type": "ticket", "entity_id": "t1", "status": "open"})], "query_id long, rank int, text string, metadata map<string,string>")
    nodes = spark.createDataFrame([("Ticket:t1", "Ticket", "T", "Status: closed", {"status": "closed", "channel": "portal"}), ("Account:a", "Account", "A", "x", {"tier": "2"})],
                                  "node_id string, node_type string, label string, text string, properties map<string,string>")
    near = spark.createDataFrame([(1, "Ticket:t1"), (1, "Account:a"), (None, "Account:a")], "query_id long, node_id string")
    merge = lambda n, **kw: EV.merge_evidence(EV.evidence_from_hits(hits), EV.evidence_from_nodes(near, n), **kw)
    whole = merge(nodes)
    few = merge(nodes.withColumn("properties", F.map_filter("properties", lambda k, v: k.isin(*EV.READ_FIELDS))), numbered=False)
    assert whole.count() == few.count() == 2
    assert "pos" in whole.columns and "pos" not in few.columns
    assert not {k for r in few.collect() for k in r["metadata"]} & {"channel", "tier"}
    assert sorted(map(str, EV.contradictions(few).collect())) == sorted(map(str, EV.contradictions(whole).collect())) != []


def test_nodes_are_searched_in_one_scan_without_storing_words(spark, monkeypatch):
    """equal to scoring every pair, in one scan and, where a task can't hold the questions, by words."""
    rng = random.Random(4)
    words = ["api", "apiary", "login", "loop", "tkt_1", "tkt_12", "x_tkt_1", "ab", "b", "日本"]
    rows = [(f"n{i:03d}", rng.choice(["T", "U"]), rng.choice(["login loop", "api", "Other"]), " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, label string, text string").withColumn("properties", F.create_map(F.lit("k"), F.lit("v"))).repartition(3)
    asks = ["login loop", "api tkt_1 tkt_1 ab", "ap", "tkt_1", "nothing known", "api apiary login x_tkt_1 loop"]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id long, query string")
    want = set()
    for i, ask in enumerate(asks):
        scored = []
        for node, kind, label, text in rows:
            hay = " ".join([node, kind, label, text, "v"]).lower()
            score = sum(t in hay for t in ask.split()) + 5 * (ask in hay) + 4 * (label.lower() == ask)
            scored.append((-score, kind, label, node))
        want |= {(i, r[3], -r[0], n + 1) for n, r in enumerate(sorted(scored)[:4]) if r[0] < 0}
    stored, real = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df: (stored.append(df.columns), real(df))[1])
    found = lambda: {(r.query_id, r.node_id, r.score, r["rank"]) for r in G.search_nodes(nodes, q, 4).collect()}
    assert found() == want
    assert not [c for c in stored if "_w" in c or "_ws" in c]
    monkeypatch.setattr(G, "SCAN_CELLS", 0)
    assert found() == want
