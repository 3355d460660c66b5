"""One scan of node texts that leaves the nodes a question's first k can be among."""

from __future__ import annotations

import re
from bisect import insort

import numpy as np
import pyarrow as pa

from .. import constants as K

CACHED = 1 << 17  # words, and token sets, that a task remembers


def leading_nodes(tokens: list[str], weights: np.ndarray, asked: list[list[str]], k: int):
    """A ``mapInArrow`` function: rows (node_id, node_type, label, low, _hay) in, the first k of each question in its task out, with tokens.

    ``weights`` holds a token's weight in a question, by token and question, ``asked`` the whole texts of each question. Scores
    are those of ``search_nodes``, whole questions and equal labels with them, so no node that the result needs is left out.
    """
    index = {t: i for i, t in enumerate(tokens)}
    starts, lengths, whole = {t[:2] for t in tokens}, {}, weights.sum(axis=0)
    for t in tokens:
        if len(t) > 2:
            lengths.setdefault(t[:3], set()).add(len(t))
    find = re.compile(K.WORD_PATTERN).findall

    def inside(word: str) -> tuple:
        found = []
        for p in range(len(word) - 1):
            if word[p:p + 2] in starts:
                if word[p:p + 2] in index:
                    found.append(index[word[p:p + 2]])
                for n in lengths.get(word[p:p + 3], ()):
                    if (i := index.get(word[p:p + n])) is not None:
                        found.append(i)
        return tuple(found)

    def scored(held: frozenset, floors: np.ndarray) -> list:
        """(question, score, whether all its tokens are there) where the score may reach the floor, with the bonus of a whole question."""
        sums = weights[list(held)].sum(axis=0)
        full = sums == whole
        near = np.flatnonzero((sums > 0) & (sums + 9 * full >= floors))
        return list(zip(near.tolist(), sums[near].tolist(), full[near].tolist()))

    def run(batches):
        known, dull, sets, floors, first = {}, set(), {}, np.zeros(len(asked), np.int64), [[] for _ in asked]
        floor = floors.tolist()
        for batch in batches:
            lows = batch.column("low")
            for at, (hay, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_hay", "node_type", "label", "node_id")))):
                hits = set()
                for word in set(find(hay)).difference(dull):
                    got = known.get(word)
                    if got is None:
                        got = inside(word)
                        if len(known) + len(dull) >= CACHED:
                            known.clear()
                            dull.clear()
                        if not got:
                            dull.add(word)
                            continue
                        known[word] = got
                    hits.update(got)
                if not hits:
                    continue
                held = frozenset(hits)
                likely, last = sets.get(held, (None, None))
                if likely is None:
                    if len(sets) >= CACHED:
                        sets.clear()
                    likely = scored(held, floors)
                name = tuple((x is not None, x or "") for x in row)
                if last is not None and name >= last:
                    continue
                left, last = [], ()  # ``last``: only a name before it can still be among the first k of a question of the set
                for item in likely:
                    q, score, full = item
                    if score + 9 * full < floor[q]:  # floors only rise
                        continue
                    left.append(item)
                    best = first[q]
                    if full and (mine := [t for t in asked[q] if t in hay]):
                        score += 9 if lows[at].as_py() in mine else 5
                    if len(best) < k or (-score, name) < best[-1][0]:
                        insort(best, ((-score, name), (*row, held, hay)), key=lambda x: x[0])
                        del best[k:]
                        floors[q] = floor[q] = -best[-1][0][0] if len(best) == k else 0
                    if last is not None:
                        last = None if full or len(best) < k or score > floor[q] else max(last, best[-1][0][1])
                sets[held] = left, last
        kept = list({row[:3]: row for best in first for _, row in best}.values())
        columns = [pa.array([row[i] for row in kept], pa.string()) for i in (2, 0, 1)]
        columns += [pa.array([sorted(tokens[i] for i in row[3]) for row in kept], pa.list_(pa.string())), pa.array([row[4] for row in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["node_id", "node_type", "label", "tokens", "_hay"])

    return run
