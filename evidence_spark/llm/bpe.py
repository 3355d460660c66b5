"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is cut into leaves that different tasks encode. Where a leaf ends in front of white space the cut is a
pre-token boundary for certain, and ids are simply laid end to end. In long unsplit text a leaf ends anywhere: halves
are joined pairwise up a tree, re-encoding a growing window around each join until its first tokens agree with the
left half and its last ones with the right half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fast_bpe import Encoder, decoder, encoder, small_batches

LEAF = 32_768  # characters of a leaf; shorter texts are encoded whole
REACH = 2_048  # characters after a leaf's end that are searched for white space
AGREE = 2  # tokens that must agree on either side of a join

_CUT = re.compile(r"[!-~À-ÖØ-öø-ÿ](?=[ \n\r\t])")
_SPECIAL = re.compile(r"<\|\w+\|>")


def leaves(text: str, leaf: int = LEAF, reach: int = REACH) -> list[tuple[int, int, bool]]:
    """(start, end, hard): spans of the leaves; hard where the end isn't known to be a boundary of pre-tokens."""
    out, at = [], 0
    while len(text) - at > leaf:
        found = _CUT.search(text, at + leaf - 1, min(len(text), at + leaf + reach))
        if found:
            end, hard = found.end(), False
        else:
            end, hard = at + leaf, True
            for special in _SPECIAL.finditer(text, max(at, end - 64), min(len(text), end + 64)):
                if special.start() < end < special.end():
                    end = special.end()
        out.append((at, end, hard and end < len(text)))
        at = end
    if at < len(text) or not out:
        out.append((at, len(text), False))
    return out


@dataclass
class Part:
    """Encoded text from ``start`` to ``end`` (characters of the document)."""

    start: int
    end: int
    ids: np.ndarray
    spans: np.ndarray  # characters of each token
    begins: np.ndarray  # whether a token starts a pre-token


def encode_part(enc: Encoder, text: str, start: int, end: int) -> Part:
    ids, spans, begins = enc.spans(text[start:end])
    return Part(start, end, ids, spans + start, begins)


def _clean(p: Part, i: int) -> bool:
    """Whether no character is shared by the tokens before and from i."""
    return i == 0 or i == len(p.ids) or p.spans[i - 1, 1] <= p.spans[i, 0]


def _glue(a: Part, b: Part) -> Part:
    return Part(a.start, b.end, np.concatenate([a.ids, b.ids]), np.concatenate([a.spans, b.spans]), np.concatenate([a.begins, b.begins]))


def _slice(p: Part, i: int, j: int, start: int, end: int) -> Part:
    return Part(start, end, p.ids[i:j], p.spans[i:j], p.begins[i:j])


def join_parts(enc: Encoder, text: str, left: Part, right: Part, width: int = 64) -> Part:
    """Tokens of the text that two adjacent parts cover."""
    while True:
        i = int(np.searchsorted(left.spans[:, 0], left.end - width, side="right")) - 1
        while i > 0 and not _clean(left, i):
            i -= 1
        j = int(np.searchsorted(right.spans[:, 1], right.start + width, side="left")) + 1
        while j < len(right.ids) and not _clean(right, j):
            j += 1
        i, j = max(i, 0), min(j, len(right.ids))
        a = left.start if i == 0 else int(left.spans[i, 0])
        b = right.end if j == len(right.ids) else int(right.spans[j, 0])
        window = encode_part(enc, text, a, b)
        ok_left = a == left.start or _same(window, 0, left, i, AGREE)
        ok_right = b == right.end or _same(window, len(window.ids) - AGREE, right, j - AGREE, AGREE)
        if ok_left and ok_right:
            head = _slice(left, 0, i, left.start, a) if a > left.start else None
            tail = _slice(right, j, len(right.ids), b, right.end) if b < right.end else None
            if head is not None:
                window.begins[0] = left.begins[i]
                window = _glue(head, window)
            return window if tail is None else _glue(window, tail)
        width *= 2


def _same(p: Part, i: int, q: Part, j: int, n: int) -> bool:
    if i < 0 or j < 0 or i + n > len(p.ids) or j + n > len(q.ids):
        return False
    return bool((p.ids[i:i + n] == q.ids[j:j + n]).all() and (p.spans[i:i + n] == q.spans[j:j + n]).all()
                and (p.begins[i + 1:i + n] == q.begins[j + 1:j + n]).all())


def join_tree(enc: Encoder, text: str, parts: list[Part]) -> np.ndarray:
    """Ids of a run of parts whose inner cuts are all hard: neighbours are joined pairwise until one part is left."""
    while len(parts) > 1:
        pairs = [join_parts(enc, text, a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(parts) - len(parts) % 2:]
    return parts[0].ids


def _frame(pdf: pd.DataFrame, path: str) -> bytes:
    """Ids of one document from its leaves."""
    enc, ids, run, text = encoder(path, "byte"), [], [], ""
    for row in pdf.itertuples():
        if not run and not row.hard:
            ids.append(np.frombuffer(row.ids, "<u4"))
            continue
        shift = len(text)
        text += row.text
        own = np.frombuffer(row.ids, "<u4")
        spans = np.frombuffer(row.spans, "<i8").reshape(-1, 2) + shift
        run.append(Part(shift, len(text), own, spans, np.frombuffer(row.begins, "?").copy()))
        if not row.hard:
            ids.append(join_tree(enc, text, run))
            run, text = [], ""
    return np.concatenate(ids).astype("<u4").tobytes()


def encode_documents(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit integers in one binary.

    Equal to the library's encode(text, add_special_tokens=False) without truncation or padding. Null and empty texts
    have no ids (an empty binary). One row comes out for each row; repeated ids and null ids stay as they are. Other
    columns are ignored. ``path`` names a byte-level tokenizer file that every executor can read.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    long = F.length("text") > leaf

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte")
        for batch in small_batches(batches):
            ids = [enc.raw(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                hard_before = False
                for k, (a, b, hard) in enumerate(leaves(text, leaf)):
                    yield pd.DataFrame({"doc_id": [doc], "mark": [hash_text(text)], "leaf": [k], "hard": [hard], "joined": [hard or hard_before], "text": [text[a:b]]})
                    hard_before = hard

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, "byte")
        for pdf in batches:
            ids, spans, begins = [], [], []
            for text, joined in zip(pdf["text"], pdf["joined"]):
                if joined:
                    own, sp, bg = enc.spans(text)
                    ids.append(own.astype("<u4").tobytes())
                    spans.append(sp.astype("<i8").tobytes())
                    begins.append(bg.tobytes())
                else:
                    ids.append(enc.raw(text))
                    spans.append(b"")
                    begins.append(b"")
            yield pdf.assign(ids=ids, spans=spans, begins=begins, text=[t if j else "" for t, j in zip(pdf["text"], pdf["joined"])])[LEAVES]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable")
        copies = int((pdf["leaf"] == 0).sum())  # rows that repeat id and text
        ids = _frame(pdf.drop_duplicates("leaf"), path)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]] * copies, "ids": [ids] * copies})

    LEAVES = ["doc_id", "mark", "leaf", "hard", "text", "ids", "spans", "begins"]
    short = rows.where(~long).mapInArrow(whole, f"doc_id {id_type}, ids binary")
    pieces = rows.where(long).mapInPandas(cut, f"doc_id {id_type}, mark string, leaf int, hard boolean, joined boolean, text string")
    encoded = pieces.repartition(F.xxhash64("doc_id", "mark", "leaf")).mapInPandas(
        encode, f"doc_id {id_type}, mark string, leaf int, hard boolean, text string, ids binary, spans binary, begins binary")
    trees = encoded.groupBy("doc_id", "mark").applyInPandas(joined, f"doc_id {id_type}, ids binary")
    return short.unionByName(trees)


def hash_text(text: str) -> str:
    import hashlib
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to rows with ``ids``, as the library's decode(ids, skip_special_tokens=False); null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(path)
        for batch in small_batches(batches):
            texts = [dec.text(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes if n != "text")
    return encoded.select(*[c for c in encoded.columns if c != "text"]).mapInArrow(run, f"{fields}, text string")
