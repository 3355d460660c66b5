import math
import random
import re
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from evidence_spark.llm.common import components, shared_folder
from evidence_spark.llm.pivot_topk import exact_topk
from evidence_spark.llm.token_rollup import TokenRollup, counted
from evidence_spark.llm.url_filter import judge_urls
from evidence_spark.llm.vector_dedup import vector_duplicates


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash") for i, v, k in rows], "vec_id long, embedding array<float>, label int, component_id string")


def cloud(seed, count=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 6, dim))
    return [(i, (centres[i % len(centres)] + rng.normal(size=dim) * 0.05 * (i % 3)).astype("f4").tolist(), i % 2) for i in range(count)]


ODD = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] + [1.0] * 15, 1), (1004, [None] * 16, 1), (1005, [], 0),
       (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [1.0] * 16, None)]


def test_vector_links_equal_brute_force(spark):
    rows = cloud(1) + ODD + [(2000 + i, cloud(1)[7][1], 1) for i in range(60)]
    got = {r["vec_id"]: r for r in vector_duplicates(vectors(spark, rows)).collect()}
    fine = {i: (np.array(v, "f8"), k) for i, v, k in rows
            if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, (a, k) in fine.items():
        for j, (b, m) in fine.items():
            if i != j and k == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i].add(j)
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - reach
            reach |= fresh
            todo += fresh
        r = got[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), min(reach), min(reach) == i), i
    assert len(got) == len(rows)
    assert vector_duplicates(vectors(spark, [])).collect() == []
    assert vector_duplicates(vectors(spark, ODD[:3])).count() == 3


def test_component_counts_across_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (1 + rng.normal(size=8) * 0.001).astype("f4").tolist(), 3) for i in range(2500)]  # all alike, more than two blocks
    got = vector_duplicates(vectors(spark, rows)).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(2499, 0, 2500)]


def test_topk_equals_brute_force(spark):
    rows = cloud(2) + ODD + [(3000, cloud(2)[0][1], 0), (3000, cloud(2)[0][1], 0), (None, cloud(2)[0][1], 0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())
    fine = [(i, np.floor(np.array(v, "f8") * 256).astype(int)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in {i: v for i, v in fine if i % 50 == 0}.items():
        scored = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert exact_topk(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    few = exact_topk(vectors(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [2.0], 1)]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + rng.randrange(400), 5000 + rng.randrange(400)) for _ in range(250)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {tuple(r) for r in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"), ("a.com", "/x", "allow"), (None, "/", "block")]


def test_url_rules(spark):
    urls = ["http://WWW.Example.ORG/es/1?q", "https://example.org/en/12#f", "https://example.org/en/2", "http://badexample.org/es/", "http://com", "http://x.a.com/xyz",
            "http://a.com?x=/x", None, "", "no scheme", "http://", "http:///path", "x://y://z.org/p", "http://example.org", "http://" + "s." * 300 + "org/" + "p" * 5000]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == sorted(
        (i, *[x or "" for x in want(u)[:3]], want(u)[3]) for i, u, _ in rows)
    none = judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "allow")}
    assert judge_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).collect() == []


IMAGE = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"before {IMAGE}, after {IMAGE}, source string")


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_rollup_deltas_and_replays(spark):
    a, b, moved = ("s1", "en", "v1", 10), ("s1", "en", "v2", 7), ("s2", None, "v1", 4)
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-test-{random.random()}")
    assert totals(rollup) == []
    assert rollup.commit("b0", changes(spark, [(None, a, "x"), (None, a, "x"), (None, moved, "x"), (None, None, "x")]))
    assert not rollup.commit("b0", changes(spark, [(None, a, "x")]))
    assert totals(rollup) == [("s1", "en", "v1", 2, 20), ("s2", None, "v1", 1, 4)]
    rollup.commit("b1", changes(spark, [(a, b, "x"), (moved, None, "x"), (None, ("s1", "en", "v1", None), "x")]))
    want = [("s1", "en", "v1", 2, 10), ("s1", "en", "v2", 1, 7)]
    assert totals(rollup) == want
    assert rollup.compact() == 1 and totals(rollup) == want
    assert not rollup.commit("b1", changes(spark, [(None, a, "x")]))
    rollup.commit("b2", changes(spark, []))
    rollup.commit("b3", changes(spark, [(b, None, "x")]))
    assert totals(rollup) == want[:1]
    assert rollup.compact() == 2 and totals(rollup) == want[:1]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a, b\n\tc"), (4, "w " * 50_000)], "doc_id long, text string").selectExpr("*", "'s' source", "null lang", "1 tokens")
    got = {r["doc_id"]: dict(r["tokens"]) for r in counted(docs, "words@1", "pieces@2").collect()}
    assert got == {1: {"words@1": 0, "pieces@2": 0}, 2: {"words@1": 0, "pieces@2": 0}, 3: {"words@1": 3, "pieces@2": 4}, 4: {"words@1": 50_000, "pieces@2": 50_000}}


def test_pipeline_stages(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.dtypes == docs.dtypes, name
        assert 0 < kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.run(spark, sf_dir).count() >= 100


def test_hub_of_a_star_keeps_its_links(spark):
    """5,000 noisy copies around one vector link with it and not with each other; so do 300 around a second hub."""
    rng, dim, rows = np.random.default_rng(5), 64, []
    for label, count in (("a", 5000), ("a", 300)):
        hub = rng.normal(size=dim)
        hub /= np.linalg.norm(hub)
        side = rng.normal(size=(count, dim))
        side -= np.outer(side @ hub, hub)
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        leaves = 0.981 * hub + np.sqrt(1 - 0.981 ** 2) * side
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate([hub, *leaves])]
    got = {r["vec_id"]: r for r in vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert [got[i]["n_links"] for i in range(len(rows))] == want.tolist()
    assert {got[i]["component_id"] for i in range(5001)} == {0} and {got[i]["component_id"] for i in range(5001, 5302)} == {5001}


def test_cosines_of_double_columns_are_double(spark):
    a = np.zeros(4)
    a[0] = 1.0
    near = [0.98 + 1e-12, math.sqrt(1 - (0.98 + 1e-12) ** 2), 0.0, 0.0]
    far = [0.98 - 1e-12, 0.0, math.sqrt(1 - (0.98 - 1e-12) ** 2), 0.0]
    rows = [(1, a.tolist(), 0), (2, near, 0), (3, far, 0)]
    got = {r["vec_id"]: r["n_links"] for r in vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_batch_committed_during_compaction_counts_once(spark):
    after = "named_struct('source', 's', 'lang', 'en', 'tokenizer', 't', 'n_tokens', 6L) as after"
    change = spark.range(1).selectExpr("cast(null as struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>) as before", after)

    class Racing(TokenRollup):
        def _sums(self, version, folders):
            if not getattr(self, "raced", False):
                self.raced = True
                TokenRollup(spark, self.path).commit("late", change)
            return super()._sums(version, folders)

    path = f"{shared_folder(spark)}/rollup-race-{random.random()}"
    rollup = Racing(spark, path)
    rollup.commit("early", change)
    rollup.compact()
    assert [tuple(r) for r in TokenRollup(spark, path).totals().collect()] == [("s", "en", "t", 2, 12)]
