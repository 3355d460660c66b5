"""Toxic spans and document scores by a linear-chain conditional random field.

Documents carry labels, tokens don't. Tokens of labelled documents are labelled first: a token is toxic where it lies in
a document labelled toxic and has a feature (the word, or its first letters) that is tied to toxic documents far beyond
chance, counted over distinct contexts so that copies of a document count once. A two-state chain is then fitted to the
labelled tokens. Scoring runs forward-backward over every whole text; marginals give spans and a document score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import store
from .fast_bpe import small_batches
from .wordstream import mix

SAMPLE = 4_000  # labelled documents of either label that the model is fitted on (smallest hashes of their ids)
SEQUENCE = 256  # tokens of a training sequence
STARTS = (3, 4, 5, 6, 7)  # lengths of the word beginnings used as features
MIN_CONTEXTS = 4  # distinct contexts in toxic documents that a feature needs
MIN_RATIO = 6.0  # how much more often than in clean documents
MIN_EVIDENCE = 30.0  # likelihood-ratio statistic
STEPS = 150
CACHE_WORDS = 100_000
BATCH = 2_048  # texts whose chains run side by side

_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    word = word.lower()
    return ["=" + word, *[word[:k] for k in STARTS if len(word) >= k]]


@dataclass
class Chain:
    """Log-odds weights of features, transition weights (from clean, from toxic) and the weights of the document score."""

    weights: dict[str, float]
    bias: float
    moves: np.ndarray  # [[clean->clean, clean->toxic], [toxic->clean, toxic->toxic]]
    document: np.ndarray  # intercept and weights of the two document features


def odds_pass(start: np.ndarray, length: np.ndarray, emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginal odds toxic : clean of every token of many sequences laid end to end in ``emit`` (odds of emission).

    Forward and backward messages of a two-state chain are one ratio each, so a step is one rational function, applied
    to all sequences that are still running.
    """
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    (a, b), (c, d) = np.exp(moves)  # a: 0->0, b: 0->1, c: 1->0, d: 1->1
    fore = emit.copy()
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # sequences with more than t tokens
    x = emit[s[: active[0]]] if len(active) else None
    for t in range(1, len(active)):
        at = s[: active[t]] + t
        x = x[: active[t]]
        x = emit[at] * (b + d * x) / (a + c * x)
        fore[at] = x
    back = np.ones(len(emit))
    # backward from each sequence's end: the same sweep over reversed positions
    last = s + n - 1
    y = np.ones(active[0]) if len(active) else None
    for t in range(1, len(active)):
        at = last[: active[t]] - t
        z = emit[at + 1] * y[: active[t]]
        y = (c + d * z) / (a + b * z)
        back[at] = y
    return fore * back


def evidence(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Likelihood-ratio statistic of one feature's counts against equal rates."""
    both, total = toxic + clean, all_toxic + all_clean
    e1, e0 = both * all_toxic / total, both * all_clean / total
    return 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / e1) + clean * np.log(np.maximum(clean, 1e-9) / e0))


def toxic_features(docs: list[np.ndarray], toxic: np.ndarray, names: list[str]) -> dict[str, float]:
    """Features tied to toxic documents, by distinct (word before, word, word after); ``docs`` hold positions in ``names``."""
    per_word = []
    for label in (False, True):
        own = [np.concatenate([[-1], d]) for d, t in zip(docs, toxic) if bool(t) == label]
        flat = np.concatenate([*own, [-1]]).astype(np.int64)
        code = flat.astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix(mix(code[:-2] * np.uint64(3)) + code[1:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(code[2:] * np.uint64(7) + np.uint64(1)))
        middle = flat[1:-1]
        _, at = np.unique(key[middle >= 0], return_index=True)
        per_word.append(np.bincount(middle[middle >= 0][at], minlength=len(names)))
    counts: dict[str, list[int]] = {}
    for w in np.flatnonzero(per_word[1]):
        for f in features(names[w]):
            counts.setdefault(f, [0, 0])[1] += int(per_word[1][w])
    for w in np.flatnonzero(per_word[0]):
        for f in features(names[w]):
            if f in counts:
                counts[f][0] += int(per_word[0][w])
    known = [f for f, (_, one) in counts.items() if one >= MIN_CONTEXTS]
    if not known:
        return {}
    clean, bad = (np.array([counts[f][i] for f in known], float) for i in (0, 1))
    all_bad, all_clean = float(per_word[1].sum()), max(float(per_word[0].sum()), 1.0)
    ratio = ((bad + 0.5) / (all_bad + 1)) / ((clean + 0.5) / (all_clean + 1))
    strong = (ratio >= MIN_RATIO) & (evidence(bad, clean, all_bad, all_clean) >= MIN_EVIDENCE)
    return {f: float(np.log(r)) for f, r, ok in zip(known, ratio, strong) if ok}


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Chain | None:
    """``share``: part of toxic documents among all labelled ones, for the prior of the document score."""
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t.lower())], np.int64) for t in texts]
    if toxic.all() or not toxic.any():
        return None
    spelled = list(vocabulary)
    strong = toxic_features(docs, toxic, spelled)
    if not strong:
        return None
    names = sorted(strong)
    index = {f: i for i, f in enumerate(names)}
    hits = {i: own for i, w in enumerate(spelled) if (own := [index[f] for f in features(w) if f in index])}
    marked = np.zeros(len(spelled), bool)
    marked[list(hits)] = True
    lengths = np.array([n for d in docs for n in [SEQUENCE] * (len(d) // SEQUENCE) + [len(d) % SEQUENCE] * (len(d) % SEQUENCE > 0)], np.int64)
    flat = np.concatenate(docs)
    bad = np.repeat(toxic, [len(d) for d in docs])
    start = np.cumsum(lengths) - lengths
    # sequences without any feature differ by their length only: a tenth of them stays, with ten times the weight
    touched = np.add.reduceat(marked[flat], start) > 0
    use = touched.copy()
    use[np.flatnonzero(~touched)[::10]] = True
    inside = np.repeat(use, lengths)
    token_weight = np.repeat(np.where(touched, 1.0, 10.0), lengths)[inside]
    flat, bad, lengths = flat[inside], bad[inside], lengths[use]
    start, at, total = np.cumsum(lengths) - lengths, len(flat), token_weight.sum()
    where = np.flatnonzero(marked[flat])
    rows = np.repeat(where, [len(hits[w]) for w in flat[where]])
    cols = np.array([i for w in flat[where] for i in hits[w]], np.int64)
    truth = marked[flat] & bad
    gold = np.flatnonzero(truth)
    follows = np.ones(at, bool)
    follows[start] = False
    pairs = np.flatnonzero(follows)
    seen = np.bincount(2 * truth[pairs - 1] + truth[pairs], weights=token_weight[pairs], minlength=4).reshape(2, 2) + 0.5
    moves = np.log(seen / seen.sum(axis=1, keepdims=True))  # transitions of the labelled chain
    w, bias = np.zeros(len(names)), 0.0
    momentum, scale = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        score = np.full(at, bias)
        np.add.at(score, rows, w[cols])
        odds = odds_pass(start, lengths, np.exp(np.clip(score, -30, 30)), moves)
        miss = (truth - odds / (1 + odds)) * token_weight
        grad = np.append(np.bincount(cols, weights=miss[rows], minlength=len(names)) - 0.05 * w, miss.sum() / total * len(gold))
        momentum = 0.9 * momentum + 0.1 * grad
        scale = 0.99 * scale + 0.01 * grad ** 2
        move = 0.15 * (momentum / (1 - 0.9 ** step)) / (np.sqrt(scale / (1 - 0.99 ** step)) + 1e-8)
        w, bias = w + move[:-1], float(np.clip(bias + move[-1], -12, 6))
    chain = Chain(dict(zip(names, w.tolist())), bias, moves, np.zeros(3))
    scorer = Scorer(chain)
    x = np.concatenate([scorer.summaries(texts[i:i + BATCH])[0] for i in range(0, len(texts), BATCH)])
    y = toxic.astype(float)
    prior = np.where(toxic, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    design = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(3)
    for _ in range(50):  # damped Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        h = (design * (prior * p * (1 - p))[:, None]).T @ design + 0.05 * np.diag([0.001, 1, 1]) + 1e-9 * np.eye(3)
        step = np.linalg.solve(h, design.T @ (prior * (y - p)) - 0.05 * np.array([0.001, 1, 1]) * theta)
        theta = theta + step / max(1.0, np.abs(step).max() / 2)
    chain.document = theta
    return chain


class Scorer:
    def __init__(self, chain: Chain):
        self.chain, self.cache = chain, {}

    def emission(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            score = self.chain.bias + sum(self.chain.weights.get(f, 0.0) for f in features(word))
            found = self.cache[word] = float(np.exp(np.clip(score, -30, 30)))
        return found

    def summaries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document features (log expected toxic tokens, log odds of any); marginals laid end to end; token counts."""
        words = [_WORD.findall(t) for t in texts]
        length = np.array([len(w) for w in words], np.int64)
        emit = np.fromiter((self.emission(w) for own in words for w in own), float, int(length.sum()))
        start = np.cumsum(length) - length
        some = length > 0
        odds = odds_pass(start[some], length[some], emit, self.chain.moves) if some.any() else np.empty(0)
        p = odds / (1 + odds)
        ends = np.concatenate([[0], np.cumsum(p)])
        none = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
        count = ends[start + length] - ends[start]
        missed = none[start + length] - none[start]
        any_odds = np.log(np.maximum(-np.expm1(missed), 1e-9)) - missed
        return np.column_stack([np.log(np.maximum(count, 0) + 1e-3), any_odds.clip(-20, 20)]), p, length

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        x, p, length = self.summaries(texts)
        scores = 1 / (1 + np.exp(-np.clip(self.chain.document[0] + x @ self.chain.document[1:], -30, 30)))
        spans, at = [], 0
        for text, n in zip(texts, length):
            hot = np.flatnonzero(p[at:at + n] >= 0.5)
            own: list[list[int]] = []
            if len(hot):
                places = [m.span() for m in _WORD.finditer(text)]
                for i, before in zip(hot, np.append([-2], hot[:-1])):
                    if i == before + 1:
                        own[-1][1] = places[i][1]
                    else:
                        own.append([*places[i]])
            spans.append([tuple(s) for s in own])
            at += n
        return scores, spans


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """A chain fitted on at most ``sample`` labelled documents of either label outside the held-out fifth.

    None if either label is missing or no feature tells them apart. The sample is fitted in one task; the driver gets the
    features that were kept.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    counts = dict(known.groupBy("is_toxic").count().collect())
    if len(counts) < 2:
        return None
    parts = [known.where(F.col("is_toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (True, False)]
    chosen = store(parts[0].unionByName(parts[1]))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # 2 * sample rows
    share = counts[True] / (counts[True] + counts[False])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "is_toxic": []}), *batches]).sort_values(["doc_id", "text"])
        chain = fit(rows["text"].tolist(), rows["is_toxic"].to_numpy(bool), share) if len(rows) else None
        if chain is not None:
            yield pd.DataFrame({"kind": "feature", "name": list(chain.weights), "value": list(chain.weights.values())})
            rest = [("bias", chain.bias), *[("move", v) for v in chain.moves.ravel()], *[("document", v) for v in chain.document]]
            yield pd.DataFrame({"kind": [k for k, _ in rest], "name": [str(i) for i in range(len(rest))], "value": [float(v) for _, v in rest]})

    rows = texts.repartition(1).mapInPandas(run, "kind string, name string, value double").collect()
    if not rows:
        return None
    rest = {k: [r["value"] for r in sorted((r for r in rows if r["kind"] == k), key=lambda r: int(r["name"]))] for k in ("bias", "move", "document")}
    weights = {r["name"]: r["value"] for r in rows if r["kind"] == "feature"}
    return Chain(weights, rest["bias"][0], np.array(rest["move"]).reshape(2, 2), np.array(rest["document"]))


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``documents`` with ``held_out``, ``score``, ``predicted`` and ``spans`` (start and end characters of toxic runs).

    Every whole text is scored from its words alone. Null and empty texts are scored as texts without words. Without a
    model (see ``train``) scores are 0 and spans empty. Rows and other columns are kept as they are, except columns named
    like an added one, which are replaced; a null id is not held out. An empty table gives no rows.
    """
    chain = train(documents, labels, sample)
    added = ["score", "spans"]
    base = documents.select(*[c for c in documents.columns if c not in ("held_out", "predicted", *added)])
    names = base.columns
    if chain is None:
        scored = base.withColumn("score", F.lit(0.0)).withColumn("spans", F.array().cast("array<struct<start:int,end:int>>"))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(chain)
            for batch in small_batches(batches, BATCH, 2 << 20):
                scores, spans = scorer.score([t or "" for t in batch.column("text").to_pylist()])
                found = pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), found], [*names, *added])

        fields = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
        scored = base.mapInArrow(run, f"{fields}, score double, spans array<struct<start:int,end:int>>")
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
