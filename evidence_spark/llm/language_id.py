"""Language of texts by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its n-grams of code points, marked at the word's ends, and the whole word; each is hashed to a row of
an embedding table. A text is the mean of all its subwords' rows, and a linear softmax over it gives the languages. Table
and softmax are trained together by stochastic gradient descent on segments of a bounded sample; a temperature makes the
softmax a probability, and a threshold on it rejects texts that it can't tell, both fitted on documents kept out of training.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import store
from .terms import term_counts
from .wordstream import mix, text_chunks

BUCKETS = 1 << 16  # rows of the embedding table
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)  # code points of an n-gram
SAMPLE_DOCUMENTS = 600  # of each language, at most, that the model is fitted on (smallest hashes of their ids)
SAMPLE_BYTES = 1_000_000  # of each language; documents are taken in that order until they reach it
LONG_BYTES = 100_000  # longer documents are taken last
SEGMENTS = (1, 2, 4, 8, 16, 32, 64)  # words of training segments
EPOCHS = 4
BATCH = 64  # segments of a step
RATE = 0.4  # of the first step, falling to 0
KEPT_OUT = 5  # each so manieth sampled document fits temperature and threshold
TARGET = 0.99  # accuracy that accepted predictions of segments kept out reach
UNKNOWN = "und"

_PART = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    softmax: np.ndarray  # (languages, DIMENSIONS)
    temperature: float
    threshold: float

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array("\0".join(self.languages)), table=self.table, softmax=self.softmax, rest=np.array([self.temperature, self.threshold]))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> "Model":
        got = np.load(io.BytesIO(raw), allow_pickle=False)
        return Model(str(got["languages"]).split("\0"), got["table"], got["softmax"], *map(float, got["rest"]))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of words of letters, laid end to end, and the n + 1 offsets of the words."""
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(points == ord("<")) - 1
    keys, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            h = mix(h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(n)) if len(points) >= n else h[:0]
            if n in GRAMS and len(h):
                inside = word[: len(h)] == word[n - 1:]
                if n == 1:
                    inside &= (points != ord("<")) & (points != ord(">"))
                keys.append(h[inside])
                owners.append(word[: len(h)][inside])
        first = np.flatnonzero(points == ord("<"))
        place = (np.arange(len(points)) - first[word]).astype(np.uint64)
        whole = np.add.reduceat(mix(points * np.uint64(0xD1342543DE82EF95) + place), first)
        keys.append(mix(whole))
        owners.append(np.arange(len(words)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (key[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))


def _expand(offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen words' subwords, and how many each has."""
    size = offsets[chosen + 1] - offsets[chosen]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[chosen] - ends + size, size), size


def _logits(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each word's subwords, and their numbers."""
    bucket, offsets = subwords(words)
    size = np.diff(offsets)
    if not len(words):
        return np.zeros((0, len(model.languages))), size
    rows = (model.table @ model.softmax.T)[bucket] if len(model.languages) <= DIMENSIONS else model.table[bucket]
    sums = np.add.reduceat(rows.astype(np.float64), offsets[:-1], axis=0)  # every word has subwords
    return (sums if len(model.languages) <= DIMENSIONS else sums @ model.softmax.T.astype(np.float64)), size


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """A model of the languages of ``texts``, in that order; None without any word."""
    names = sorted(set(languages))
    index = {n: i for i, n in enumerate(names)}
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _PART.findall(t.lower())], np.int64) for t in texts]
    if not vocabulary:
        return None
    bucket, offsets = subwords(list(vocabulary))
    rng = np.random.Generator(np.random.PCG64(20))
    train: list[tuple[np.ndarray, int]] = []
    checks: list[tuple[np.ndarray, int]] = []
    for k, (words, name) in enumerate(zip(docs, languages)):
        out, at = checks if k % KEPT_OUT == 0 and len(docs) > KEPT_OUT else train, 0
        while at < len(words):
            n = int(rng.choice(SEGMENTS))
            out.append((words[at:at + n], index[name]))
            at += n
    table = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) * (2 / DIMENSIONS)).astype(np.float32)
    softmax = np.zeros((len(names), DIMENSIONS), np.float32)

    def means(segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.concatenate([s for s, _ in segments])
        at, size = _expand(offsets, words)
        first = np.concatenate([[0], np.cumsum([len(s) for s, _ in segments])[:-1]])
        total = np.add.reduceat(size, first)
        used = bucket[at]
        return np.add.reduceat(table[used], np.concatenate([[0], np.cumsum(total)[:-1]]), axis=0) / total[:, None], used, total

    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for at in range(0, len(order), BATCH):
            batch = [train[i] for i in order[at:at + BATCH]]
            x, used, total = means(batch)
            miss = _softmax(x @ softmax.T)
            miss[np.arange(len(batch)), [c for _, c in batch]] -= 1
            rate = RATE * (1 - done / steps)
            pull = (miss @ softmax / total[:, None] * rate).astype(np.float32)
            softmax -= (rate * miss.T @ x).astype(np.float32)
            where = np.argsort(used, kind="stable")
            hit, start = np.unique(used[where], return_index=True)
            table[hit] -= np.add.reduceat(np.repeat(pull, total, axis=0)[where], start, axis=0)
            done += 1
    model = Model(names, table, softmax, 1.0, 0.0)
    if checks:
        parts = [(means(checks[i:i + 512])[0] @ softmax.T).astype(np.float64) for i in range(0, len(checks), 512)]
        x, truth = np.concatenate(parts), np.array([c for _, c in checks])
        heats = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        loss = [-np.log(np.maximum(_softmax(x / h)[np.arange(len(x)), truth], 1e-12)).mean() for h in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
        p = _softmax(x / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        down = np.argsort(-best, kind="stable")
        accuracy = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
        enough = np.flatnonzero(accuracy >= TARGET)
        model.threshold = float(best[down][enough[-1]]) if len(enough) else 1.0
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, documents_each: int = SAMPLE_DOCUMENTS, bytes_each: int = SAMPLE_BYTES) -> Model | None:
    """A model fitted on documents outside the held-out third that have an id, a text and a language; None if there are none.

    Of each language at most ``documents_each`` documents, taken until they reach ``bytes_each`` bytes; one task fits them.
    The driver gets the model, whose size is fixed by its parameters and the number of languages.
    """
    known = documents.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    size = F.octet_length("text")
    # of a large language only a share by hash, many times the sample, is ranked
    share = known.groupBy("lang").agg((F.lit(16.0 * documents_each) / F.count("*")).alias("share"))
    known = known.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share")
    order = Window.partitionBy("lang").orderBy(F.col("size") > LONG_BYTES, F.xxhash64("doc_id", "lang"), "doc_id", "size", "digest")
    ranked = known.select("doc_id", "lang", size.alias("size"), F.xxhash64("text").alias("digest")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= documents_each)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = store(ranked.withColumn("before", before).where(F.col("before") < bytes_each).select("doc_id", "lang", "digest").distinct())
    texts = known.withColumn("digest", F.xxhash64("text")).join(chosen, ["doc_id", "lang", "digest"]).select("doc_id", "lang", "text").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "lang": [], "text": []}), *batches]).sort_values(["lang", "doc_id", "text"])
        model = fit(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else None
        if model is not None:
            yield pd.DataFrame({"model": [model.dump()]})

    rows = texts.repartition(1).mapInPandas(run, "model binary").collect()
    return Model.load(bytes(rows[0]["model"])) if rows else None


def _predict(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely language (-1: no letter) and its probability of every text."""
    found, rows = term_counts(data, bounds), len(bounds) - 1
    parts, owner = [], []
    for k, term in enumerate(found.terms.to_pylist()):
        own = _PART.findall(term.lower())
        parts += own
        owner += [k] * len(own)
    logits, size = _logits(model, parts)
    sums = np.zeros((len(found.terms), len(model.languages) + 1))
    np.add.at(sums, np.array(owner, np.int64), np.column_stack([logits, size]))
    total = np.zeros((rows, sums.shape[1]))
    if len(found.row):
        first = np.flatnonzero(np.diff(found.row, prepend=-1))
        for at in range(0, len(first), 4096):  # a bounded number of texts' terms at once
            own = first[at:at + 4096]
            end = first[at + 4096] if at + 4096 < len(first) else len(found.row)
            total[found.row[own]] = np.add.reduceat(sums[found.term[own[0]:end]] * found.count[own[0]:end, None], own - own[0], axis=0)
    n = total[:, -1]
    p = _softmax(total[:, :-1] / np.maximum(n, 1)[:, None] / model.temperature)
    return np.where(n > 0, p.argmax(axis=1), -1), np.where(n > 0, p.max(axis=1), 0.0)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``accepted``; nothing but ``text`` is looked at.

    ``lang_pred`` is the most likely of the learned languages, ``score`` its calibrated probability, and ``accepted`` is true
    where that reaches the fitted threshold. Null texts, texts without a letter and, without a model, all texts are ``und``
    with score 0, not accepted. Whole texts are scored. Rows and other columns stay, repeated ones too; columns named like an
    added one are replaced. An empty table gives no rows.
    """
    names = [c for c in documents.columns if c not in ("lang_pred", "score", "accepted")]
    rows = documents.select(*names)
    if model is None:
        return rows.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0)).withColumn("accepted", F.lit(False))
    shipped = documents.sparkSession.sparkContext.broadcast(model.dump())  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(shipped.value)
        labels = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            for at, data, bounds in text_chunks(batch.column("text")):
                best, score = _predict(own, data, bounds)
                part = batch.slice(at, len(best))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(labels[best], pa.string()), pa.array(score), pa.array((best >= 0) & (score >= own.threshold))], [*names, "lang_pred", "score", "accepted"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")
