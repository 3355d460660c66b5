"""Source divergence, language identification and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from evidence_spark.llm import language_id, periodic_runs, source_divergence
from evidence_spark.llm.queries import QUERIES

WORDS = r"[^\x20\x09-\x0d]+"
FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5, 6) for r in rows], "doc_id long, text string, lang string, source string, score string, rank int, period int")


def some_documents():
    rng = random.Random(31)
    words = ["Alpha", "beta", "gamma", "délta", "Épsilon", "zeta", "x", "naïve", "中文", "ÉPSILON", "omega", "BETA"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "7", "-b"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None]),
             rng.choice(["a", "b", "c", "É", None])) for i in range(80)]
    rows += [(90, None, "en", "a"), (91, "", "fr", "a"), (92, "only two", "fr", "b"), (93, "only two", "fr", "b"), (94, "one", "xx", "lone"), (None, "beta " * 4000, "en", "b")]
    return rows + rows[:5]


def plain_divergence(rows, top):
    texts = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
             for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        docs = Counter(t for *_, terms in own for t in set(terms))
        kept = {t for t, n in docs.items() if n >= 3}
        counts = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)
        every = sum(counts.values(), Counter())
        prob = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in [*counts.items(), (None, every)]}
        for s in counts:
            pair = [(sum((prob[s][t] - prob[o][t]) ** 2 // prob[o][t] for t in kept), o) for o in counts if o != s]
            term = [((prob[s][t] - prob[None][t]) ** 2 // prob[None][t], t) for t in kept if counts[s][t] and prob[s][t] > prob[None][t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, top", [(16384, 200), (2, 3)])
def test_divergence_equals_plain_version(spark, block, top):
    rows = some_documents()
    got = source_divergence.source_divergence(documents(spark, rows), top, block)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, top)
    assert source_divergence.source_divergence(documents(spark, rows[:0])).collect() == []


def test_galloping_finds_all_shared_values():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 3000), rng.integers(0, 400))) for _ in range(2))
        i, j = source_divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        at = 0
        while at + q < len(words):
            to = at
            while to + q < len(words) and words[to] == words[to + q]:
                to += 1
            if to - at + q >= max(24, 3 * q):
                found.setdefault((at, to - at + q), q)
            at = max(to, at + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(9)
    out = [None, "", " \n\t ", "one", "same " * 3000, "a b " * 700 + "c " + "b a " * 60, "x " * 23, "x " * 24]
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(1, 700):
            unit = [rng.choice("abcÉ") for _ in range(rng.randrange(1, 50))]
            words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 300)]
            words += [str(rng.randrange(10**6)) for _ in range(rng.choice([0, 0, 3, 40]))]
        out.append(rng.choice(["", " "]) + rng.choice([" ", "\n", " \x0b "]).join(words))
    return out


@pytest.mark.parametrize("tile, limit", [(8192, 65536), (64, 0), (128, 900)])
def test_periodic_runs_equal_plain_version(spark, tile, limit):
    texts = periodic_texts()
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(3, texts[9], "en", "a"), (None, texts[10], "en", "a"), (10, texts[10], "en", "a")]
    got = periodic_runs.periodic_runs(documents(spark, rows), tile, limit).collect()
    want = []
    for i, t, *_ in rows:
        words = re.findall(WORDS, t or "")
        runs = plain_runs(words)
        want.append((str(i), len(words), runs, collapsed(words, runs)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)
    assert {(r["score"], r["period"]) for r in got} == {("clash", 6)}
    assert periodic_runs.periodic_runs(documents(spark, rows[:0])).collect() == []


def test_periodic_query_on_given_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    assert len(rows) == len(got)
    for doc, text in rows:
        words = re.findall(WORDS, text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue  # slow in the plain version
        runs, r = plain_runs(words), got[doc]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_language_of_held_out_documents(spark):
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    got = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) >= 0.98 * len(held) > 0


def test_language_edges_and_independence(spark):
    rng = random.Random(2)
    stems = {"aa": ["kalu", "mita", "sola"], "bb": ["grund", "werk", "schul"], "cc": ["мир", "дом", "лес"]}
    rows = [(i, " ".join(rng.choice(stems[k]) + rng.choice(["", "x", "en"]) for _ in range(rng.randint(1, 40))), k, "a") for i, k in enumerate(rng.choices(list(stems), k=400))]
    rows += [(500, "kalu mita", None, None), (501, None, "aa", "a"), (502, "", "aa", "a"), (503, "12 -- 7!", "bb", "a"), (None, "werk", "bb", "a"), (504, "ДОМ", "aa", "a"), (505, "kalu " * 30_000, "bb", "b")]
    rows += rows[:3]
    table = documents(spark, rows)
    model = language_id.train(table)
    assert model.languages == ["aa", "bb", "cc"] and language_id.Model.load(model.dump()).languages == model.languages
    got = language_id.identify(table, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and sum(by[i]["lang_pred"] == k for i, _, k, _ in rows[:400]) >= 398
    assert [by[i]["lang_pred"] for i in (500, 501, 502, 503, None, 505)] == ["aa", "und", "und", "und", "bb", "aa"]
    assert all((r["lang_pred"] != "und") == (r["score"] > 0) for r in got) and {r["period"] for r in got} == {6}
    # only the text counts, however rows are dealt
    other = documents(spark, [(i, t, "zz", "q") for i, t, *_ in rows]).repartition(7)
    again = {(str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identify(other, model).collect()}
    assert again == {(str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identify(table, model).collect()}
    assert language_id.train(documents(spark, rows[:0])) is None
    assert [r["lang_pred"] for r in language_id.identify(table.limit(2), None).collect()] == ["und", "und"]


def test_rejection_of_what_cant_be_told():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["count", "common"] if rng.random() < 0.5 else [f"{k}ord{rng.randrange(9)}"]) for _ in range(20)) for k in "ab" * 150]
    model = language_id.fit(texts, list("ab" * 150))
    data = "count|common count|aord1 aord2 aord3 aord4|bord5 bord2 bord1 bord0".encode()
    bounds = np.array([0, *[i for i, c in enumerate(data) if c == ord("|")], len(data)])
    _, score = language_id._predict(model, np.frombuffer(data, np.uint8), bounds)
    assert (score >= model.threshold).tolist() == [False, False, True, True] and 0.5 < model.threshold < 1
