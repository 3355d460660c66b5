import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidence_spark.llm import bpe, fast_bpe, html_extract, line_dedup, packing, toxicity
from evidence_spark.llm.jaccard_join import jaccard_components

WORDS = r"[^\x20\x09-\x0d]+"


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared passages, odd texts and repeated rows."""
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(3, 200)) for _ in range(40)]
    passage = sentence(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)]
    for i in range(12):
        words = base[i].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{sentence(rng, 30)} {passage}\n{sentence(rng, 20)}") for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "One"), (404, "one"), (405, "same " * 3000), (406, "x" * 70_000), (None, base[3]), (5, base[5])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], "doc_id long, text string, component_id string, score string, n_removed int")


def shingles(text):
    w = re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_jaccard_components_equal_brute_force(spark, corpus):
    got = sorted(map(tuple, jaccard_components(frame(spark, corpus)).collect()), key=str)
    sets = [(i, shingles(t)) for i, t in corpus]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = [(i, len(s), root(i) if i is not None else 3) for i, s in sets]
    assert got == sorted(want, key=str)


def test_jaccard_of_nothing(spark):
    assert jaccard_components(frame(spark, [])).collect() == []


def test_line_dedup_keeps_first_runs_only(spark, corpus):
    got = line_dedup.remove_repeats(frame(spark, corpus)).select("doc_id", "text", "n_removed", "score").collect()
    assert len(got) == len(corpus)
    texts = {r["doc_id"]: r for r in got}
    seen: set = set()
    rows = dict((i, t) for i, t in corpus if i is not None)
    for i in sorted(rows):
        w, gone = re.findall(WORDS, rows[i] or ""), set()
        own = [tuple(w[k:k + 50]) for k in range(len(w) - 49)]
        for k, run in enumerate(own):
            if run in seen:
                gone |= set(range(k, k + 50))
        seen |= set(own)
        assert re.findall(WORDS, texts[i]["text"] or "") == [x for k, x in enumerate(w) if k not in gone], i
        assert texts[i]["n_removed"] == len(gone)
        if not gone:
            assert texts[i]["text"] == rows[i]
    assert next(r for r in got if r["doc_id"] is None)["text"] == dict((i, t) for i, t in corpus)[3]
    assert {r["score"] for r in got} == {"clash"}
    assert line_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_line_dedup_finds_runs_behind_shorter_ones(spark):
    """An earlier document, or an earlier place of the first one, has only 30 to 49 words of the passage."""
    rng = random.Random(17)
    rows, want = [], {}
    for k in range(12):
        passage = sentence(rng, 50 + 3 * k, 10**9).split()
        piece = " ".join(passage[2:2 + rng.randint(30, 49)])
        part, rest = sentence(rng, 20, 10**9), sentence(rng, 25, 10**9)
        rows.append((10 * k, f"{part} {piece} {rest}"))
        first = f"{piece} {sentence(rng, 9, 10**9)} {' '.join(passage)} {sentence(rng, 30, 10**9)}"
        rows += [(10 * k + 1, first), (10 * k + 2, f"{part[:40]} {' '.join(passage)} {rest[:40]}"), (10 * k + 2, f"twin {' '.join(passage)}")]
        want |= {(10 * k, 0): 1, (10 * k + 1, 0): 1, (10 * k + 2, len(passage)): 2}
    got = [(r["doc_id"], r["n_removed"], r["text"]) for r in line_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert {(i, n): sum(g[:2] == (i, n) for g in got) for i, n, _ in got} == want
    assert sum(t.strip() == "twin" for _, _, t in got) == 12


def test_winnowing_guarantee():
    rng = random.Random(1)
    shared = sentence(rng, 50)
    texts = [f"{sentence(rng, 90)} {shared} {sentence(rng, 40)}", f"{sentence(rng, 11)}\n{shared}"]
    found = []
    with np.errstate(over="ignore"):
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            words = line_dedup.words_of(data, np.array([0, len(data)]), lower=False)
            grams, _ = line_dedup.gram_hashes(words, line_dedup.LINE)
            found.append({int(grams[p]) for p in line_dedup.selected(words, line_dedup.LINE, 50)})
    assert found[0] & found[1]


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_round_trip_equals_library(spark, corpus):
    odd = [(500, "naïve 中文 😀 \u0301 <|endoftext|>tail"), (501, "'s 'S it's\u00a0 a  b \n\n c\x0b"), (502, "ab1!" * 20_000), (503, " " * 40_000 + "x"), (504, "é" * 40_000)]
    rows = corpus + odd
    encoded = bpe.encode_documents(frame(spark, rows), PATH)
    got = bpe.decode_documents(encoded, PATH).collect()
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["text"]) for r in got) == sorted((str(i), *want(t)) for i, t in rows)


def test_tree_concatenation_of_unsplit_text():
    enc, rng = fast_bpe.encoder(PATH, "byte"), random.Random(11)
    for k in range(300):
        letters = rng.choice(["aaab'", "!'s", "abcdefghé", "中文字符", "'''s!!", "0123a", "😀é"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(40, 300)))
        spans = bpe.leaves(text, rng.choice([16, 24, 40]), 4)
        parts = [bpe.encode_part(enc, text, a, b) for a, b, _ in spans]
        if all(hard for *_, hard in spans[:-1]):
            assert bpe.join_tree(enc, text, parts).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_packing_places_every_id_once(spark, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in corpus if i is not None and i != 5] + [(600, "<|startoftext|> İstanbul CAFÉ\u0301")]
    got = packing.pack_documents(frame(spark, rows), path, window=256).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    placed: dict = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] <= 256 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        placed.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, own in placed.items():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) == len(ids[i])
    assert set(placed) == set(ids)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 256
    assert packing.pack_documents(frame(spark, []), path).collect() == []


def test_packing_plan_wastes_little():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.gamma(2, 300, 60_000).astype(int).clip(1, 2048), minlength=2049)
    planned = packing.plan(counts, 2048)
    used = np.zeros(2049, np.int64)
    for lengths, many in planned:
        assert sum(lengths) <= 2048
        for v in lengths:
            used[v] += many
    assert (used == counts).all()
    total = int((counts * np.arange(2049)).sum())
    assert sum(m for _, m in planned) * 2048 < total * 1.002
    assert packing.plan(np.zeros(2049, np.int64), 2048) == []


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 5, 3])
    emit, moves = np.exp(rng.normal(size=9)), rng.normal(size=(2, 2))
    odds = toxicity.odds_pass(np.array([0, 1, 6]), lengths, emit, moves)
    at = 0
    for n in lengths:
        weight = np.zeros((2, n))
        for code in range(2 ** n):
            states = [(code >> k) & 1 for k in range(n)]
            w = np.prod([emit[at + k] if s else 1.0 for k, s in enumerate(states)]) * np.exp(sum(moves[a, b] for a, b in zip(states, states[1:])))
            for k, s in enumerate(states):
                weight[s, k] += w
        assert np.allclose(weight[1] / weight[0], odds[at:at + n])
        at += n


def test_toxicity_finds_spans_and_leaves_clean_texts(spark):
    rng = random.Random(8)
    stems = ["grobian", "schuft", "lump"]
    rows, labels = [], []
    for i in range(600):
        words = sentence(rng, rng.randint(20, 60), 800).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "en", "ig"]))
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 11 == 3 else int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "grobian " * 5), (9002, "w1 " * 5000), (9003, "Lump")]
    table = spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(frame(spark, rows), table)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(rows) and got[0]["component_id"] == "clash"
    for i in range(600):
        held = zlib.crc32(str(i).encode()) % 5 == 0
        assert got[i]["held_out"] == held and got[i]["predicted"] == (i % 5 == 0), i
        for a, b in got[i]["spans"]:
            assert any(s in rows[i][1][a:b] for s in stems)
    assert [got[i]["predicted"] for i in (9000, 9001, None, 9002)] == [0, 0, 1, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    unlabelled = toxicity.score_toxicity(frame(spark, rows[:2]), table.where("toxic = 0")).collect()
    assert [r["score"] for r in unlabelled] == [0.0, 0.0]
    assert toxicity.score_toxicity(frame(spark, []), table).collect() == []


def page(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, text string")


def test_html_structure_and_host_repeats(spark):
    article = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home<li>News</ul></nav><div class='ad'>Buy now</div><article>" \
              "<h1>Head &amp; title</h1><p>One <b>two</b>\n three<br>four<p>Caf&#233; &lt;x&gt;</article><section id='comments'><p>me too</p></section>" \
              "<form>name</form><script>if (a<b) document.write('<p>no</p>')</script><!-- <p>no</p> --><footer>&copy; us</foot"
    common = "all the news that is fit to print every single day of the week"
    rows = [(1, "http://a.org/1", article), (2, None, None), (3, "http://a.org/3", ""),
            (4, "http://b.org/1", f"<p>{common}</p><p>first page only words here</p>"), (5, "http://b.org/2", f"<p>{common}<div>second page tells another tale</div>"),
            (6, "http://c.org/1", f"<p>{common}</p>"), (6, "http://c.org/1", f"<p>{common}</p>"), (7, "http://d.org/", "<p></p>" * 100_000 + "deep"),
            (8, "http://e.org/", "a < b &amp c <" ), (9, "http://f.org/", "<div>" * 5000 + "x"), (10, "http://g.org/", "<p title=\"a>b\">quoted</p><p x='open>rest</p>")]
    got = [(r["page_id"], r["text"]) for r in html_extract.extract_pages(page(spark, rows)).collect()]
    assert sorted(got) == [
        (1, "Head & title\nOne two three four\nCafé <x>"), (2, ""), (3, ""), (4, "first page only words here"), (5, "second page tells another tale"),
        (6, common), (6, common), (7, "deep"), (8, "a < b & c <"), (9, "x"), (10, "quoted\nrest")]
    assert html_extract.extract_pages(page(spark, [])).collect() == []


def test_html_names_do_not_drop_article_text():
    page = "<main><h2 id='notices'>Notices</h2><section id='discussion'>One</section><section id='related-work'>Two</section><section aria-label='Search'>Three" \
           "</section><div class='no-ads'>Four</div><div class='ad slot-3'>Buy</div><ol class='comments-list'><li>me too</ol><p hidden>no</p></main>"
    assert [t for z, t in html_extract.blocks(page) if z == "c"] == ["Notices", "One", "Two", "Three", "Four"]
    assert html_extract.blocks("<article class='post has-sidebar'>Text</article>") == [("c", "Text")]
    assert html_extract.blocks("<div class='layout with-sidebar'>Text<div class='sidebar'>side</div><div id='site-footer'>us</div></div>") == [
        ("o", "Text"), ("b", "side"), ("b", "us")]
    assert html_extract.blocks("<article class='comment'>me too</article>") == [("b", "me too")]


def test_html_copies_are_no_boilerplate(spark):
    copy, bar = "<p>ten words that stand on two copies of one page</p>", "<p>one two three four five six seven eight nine</p>"
    rows = [(1, "http://a.org/1", copy), (2, "http://a.org/2", copy), (3, "http://b.org/3", bar + "<p>third</p>"), (4, "http://b.org/4", bar + "<p>fourth</p>")]
    got = sorted((r["page_id"], r["text"]) for r in html_extract.extract_pages(page(spark, rows)).collect())
    assert got == [(1, copy[3:-4]), (2, copy[3:-4]), (3, "third"), (4, "fourth")]


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    from corpus_pipeline import drop_near_duplicates

    rng = random.Random(8)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(2, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (7, b, "x"), (7, c, "x"), (None, a, "x")], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["text"]) for r in drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(2, a), (5, b), (7, c), (None, a)], key=str)


def test_line_dedup_keeps_columns_of_any_name(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, "a", 1, 2, 3, 4.0), (2, "own words " + passage, "b", 5, 6, 7, 8.0), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, wins int, _slot int, _word int, `odd name` double")
    out = line_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    want = [(1, passage, "a", 1, 2, 3, 4.0, 0), (2, "own words", "b", 5, 6, 7, 8.0, 60), (None, None, None, None, None, None, None, 0)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_html_crawls_of_one_page_keep_their_own_text(spark):
    lone = " ".join(f"w{i}" for i in range(13))
    shared = " ".join(f"s{i}" for i in range(13))
    rows = [(1, "http://h.org/a", f"<div>{shared}</div><div>{lone}</div>"), (1, "http://h.org/a", f"<div>{lone} again</div><div>first</div>"),
            (2, "http://h.org/b", f"<div>{shared}</div><div>other</div>")]
    got = sorted(r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted([lone, lone + " again\nfirst", "other"])


def test_html_stray_closing_tags_take_linear_time():
    import time
    start = time.perf_counter()
    assert html_extract.blocks("<div>" * 50000 + "text" + "</span>" * 50000 + "</section>" * 50000 + "</div>" * 50000) == [("o", "text")]
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "near_duplicates"])
def test_pipeline_stages_keep_columns_of_any_name(spark, stage, tmp_path):
    import corpus_pipeline
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"clean words number {i} stand here alone", 40, f"x{i}", 0.5, i, i) for i in range(1, 30)]
    rows += [(30, "awful vile words", 16, "x30", 0.5, 30, 30), (31, None, None, "x31", None, 31, 31), (32, "", 0, "x32", 0.5, 32, 32),
             (40, passage, len(passage), "x40", 0.5, 40, 40), (41, passage, len(passage), "x41", 0.5, 41, 41), (41, passage, len(passage), "x41", 0.5, 41, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string, score double, _key long, n_removed long")
    labels = spark.createDataFrame([(i, int(i == 30), 1) for i in range(1, 33)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert all(r["_key"] == r["n_removed"] == r["doc_id"] and r["spans"] == f"x{r['doc_id']}" for r in got)
    ids = sorted(r["doc_id"] for r in got)
    if stage == "line_dedup":
        assert ids == [*range(1, 33), 40]
    if stage == "near_duplicates":
        assert ids == [*range(1, 33), 40]
    empty = dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), str(tmp_path))
    assert empty.dtypes == docs.dtypes and empty.count() == 0
