"""Evaluation texts in documents: shared character q-grams in overlapping diagonal bands, then banded alignment.

Texts are compared as their words joined by single blanks. A passage is a run of n_words words of an item; a passage of `length`
characters may have one edit for each `per_edit` characters, and one at least. A passage that is found in a document with at most `edits`
edits shares at least length + 1 - q * (edits + 1) q-grams with it, all within a band of edits + 1
diagonals (the q-gram lemma). Bands of twice as many diagonals (for the largest budget) that overlap by half hold any such band as a whole, so
no region that meets the least bound of an item's passages is lost. The regions kept are aligned in a band around their diagonals, and
where no run is held exactly, the runs themselves are looked for with the edits of their length.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrid.llm.words import mix, words
from trigrid.runtime import materialize

#: Words of a passage, characters for each of which it may have an edit, characters of a q-gram at most (fewer where a passage is too short for the bound).
WORDS, PER_EDIT, Q = 12, 30, 12
#: Evaluation texts sent to all tasks at once: at most so many characters; more are taken in packs.
ITEM_CHARS = 4_000_000
#: Documents' characters looked at together, regions aligned together.
CHUNK, REGIONS = 1_000_000, 4096
_BITS = 22


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position of codes."""
    m = len(codes) - q + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(q):
        h *= np.uint64(0x100000001B3)
        h += codes[i : i + m]
    return mix(h)


class Index:
    """The q-grams of the evaluation texts, sorted by hash, with a bit table in front."""

    def __init__(self, ids: np.ndarray, texts: list[str], n_words: int, per_edit: int, q: int) -> None:
        self.ids, self.per_edit = ids, per_edit
        self.runs: list[dict[str, int]] = []  # the passages of each text and where they start in it, the last of equal ones
        for t in texts:
            w = t.split(" ")
            at = np.cumsum([0, *(len(x) + 1 for x in w)]).tolist()
            self.runs.append({" ".join(w[i : i + n_words]): at[i] for i in range(len(w) - n_words + 1)})
        length = np.array([len(x) for r in self.runs for x in r])
        budget = self.budget(length)
        owner = np.repeat(np.arange(len(self.runs)), [len(r) for r in self.runs])
        self.edits = int(budget.max(initial=1))
        self.q = q = min(q, int((length // (budget + 1)).min(initial=q)))
        self.need, self.least = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(self.need, owner, length + 1 - q * (budget + 1))
        np.minimum.at(self.least, owner, length - 3 * budget)
        self.codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        h = _grams(self.codes, q)
        at = np.arange(len(h))
        item = np.searchsorted(self.start, at, "right") - 1
        whole = at + q < self.start[item + 1] if len(at) else np.zeros(0, bool)
        order = np.argsort(h[whole], kind="stable")
        self.hash, self.at, self.item = h[whole][order], at[whole][order], item[whole][order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def budget(self, length):
        """Edits that a passage may have."""
        return np.maximum(1, length // self.per_edit) if self.per_edit else length * 0

    def possible(self, item: int, found: np.ndarray) -> list[str]:
        """Passages of an item that have enough of their q-grams among those found (positions in self.codes) to be there with their edits."""
        begin = self.start[item]
        held = np.zeros(self.start[item + 1] - begin + 1, np.int64)
        held[found - begin + 1] = 1
        before = np.cumsum(held)
        out = []
        for run, at in self.runs[item].items():
            need = len(run) + 1 - self.q * (int(self.budget(len(run))) + 1)
            if before[at + len(run) - self.q + 1] - before[at] >= need:
                out.append(run)
        return out

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in codes, position in self.at) of all equal q-grams."""
        h = _grams(codes, self.q)
        pos = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(pos):
            return pos, pos
        lo = np.searchsorted(self.hash, h[pos], "left")
        n = np.searchsorted(self.hash, h[pos], "right") - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pos, n), np.repeat(lo, n) + each


def regions(doc: np.ndarray, pos: np.ndarray, item: np.ndarray, at: np.ndarray, q: int, need: np.ndarray, edits: int) -> tuple[np.ndarray, ...]:
    """(document, item, lowest diagonal, first and last position in the document) of the bands that meet the bound; need: hits by item.

    Within a band, hits further apart than the gap that the edits can leave start a new region.
    """
    width = 2 * (edits + 1)
    diag = pos - at
    docs, items, lows, firsts, lasts = [], [], [], [], []
    for shift in (0, edits + 1):
        band = (diag + shift) // width
        order = np.lexsort((pos, band, item, doc))
        d, i, b, p = doc[order], item[order], band[order], pos[order]
        new = np.ones(len(d), bool)
        # two hits of one passage, with at most `edits` edits between them, are at most this far apart
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (p[1:] - p[:-1] > (edits + 1) * q + edits)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        keep = last - first + 1 >= need[i[first]]
        first, last = first[keep], last[keep]
        docs.append(d[first])
        items.append(i[first])
        lows.append(b[first] * width - shift)
        firsts.append(p[first])
        lasts.append(p[last] + q)
    return tuple(np.concatenate(x) for x in (docs, items, lows, firsts, lasts))


def aligned(codes: np.ndarray, other: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, top: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Best local alignment score of each region within its band: +1 a match, -2 a mismatch or gap. All regions at once.

    codes, other: characters of the documents and of the items; start, end: the region in codes; low: its lowest diagonal
    (position in codes minus position in other); least, top: bounds of the item in other.
    """
    n = len(start)
    score, best = np.zeros((n, width + 2), np.int32), np.zeros(n, np.int32)
    k = np.arange(width)
    for step in range(int((end - start).max(initial=0))):
        i = start + step
        live = i < end
        j = i[:, None] - low[:, None] - k[None, :]
        inside = live[:, None] & (j >= least[:, None]) & (j < top[:, None])
        same = inside & (codes[np.minimum(i, len(codes) - 1)][:, None] == other[np.clip(j, 0, len(other) - 1)])
        # diagonal k at row i: from the same diagonal (both advance), from k - 1 (the document advances)
        new = np.maximum(score[:, 1:-1] + np.where(same, 1, -2), score[:, :-2] - 2)
        new = np.maximum(np.where(inside, new, 0), 0)
        for c in range(width - 2, -1, -1):  # from k + 1 in the same row (the item advances)
            np.maximum(new[:, c], new[:, c + 1] - 2, out=new[:, c])
        score[:, 1:-1] = new
        np.maximum(best, new.max(1), out=best)
    return best


def near(doc: str, run: str, edits: int) -> bool:
    """Whether run is a part of doc but for at most `edits` edits of characters: of edits + 1 pieces of it one is there unchanged."""
    cut = [len(run) * i // (edits + 1) for i in range(edits + 2)]
    tried: set[int] = set()  # diagonals
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = doc.find(run[a:b])
        while at >= 0:
            low = at - a - edits
            if low in tried:
                at = doc.find(run[a:b], at + 1)
                continue
            tried.add(low)
            row = [0 if 0 <= low + c <= len(doc) else edits + 1 for c in range(2 * edits + 1)]  # by diagonal; the run may begin on any
            for i, x in enumerate(run):
                new = []
                for c in range(2 * edits + 1):
                    p = low + c + i  # the character of doc on this diagonal
                    least = row[c] + (doc[p] != x) if 0 <= p < len(doc) else edits + 1
                    if c + 1 < len(row) and 0 <= p + 1 <= len(doc):
                        least = min(least, row[c + 1] + 1)
                    if c and 0 <= p < len(doc):
                        least = min(least, new[c - 1] + 1)
                    new.append(least)
                row = new
                if min(row) > edits:
                    break
            else:
                return True
            at = doc.find(run[a:b], at + 1)
    return False


_INDEXES: dict[str, Index] = {}


def _index(name: str, pack: tuple[np.ndarray, list[str]], *how: int) -> Index:
    """Built once in each Python worker; one pack is held at a time."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(*pack, *how)
    return _INDEXES[name]


def _search(name: str, pack, n_words: int, per_edit: int, most_q: int):
    """pack: a broadcast variable. Texts of the documents are normalised words joined by blanks if they have the column `joined`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, pack.value, n_words, per_edit, most_q)
        q, runs, edits = index.q, index.runs, index.edits

        def look(doc_ids: list, docs: list[str]) -> pa.RecordBatch:
            codes = np.frombuffer("".join(x + "\r" for x in docs).encode("utf-32-le"), np.uint32).astype(np.uint64)
            begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in docs])])
            pos, k = index.hits(codes)
            out: list[tuple] = []
            if len(pos):
                doc = np.searchsorted(begin, pos, "right") - 1
                pair = doc * len(index.ids) + index.item[k]
                enough = np.unique(pair, return_inverse=True, return_counts=True)
                inside = (pos + q < begin[doc + 1]) & (enough[2][enough[1]] >= index.need[index.item[k]])
                pos, k, doc, pair = pos[inside], k[inside], doc[inside], pair[inside]
                by_pair = np.argsort(pair, kind="stable")
                d, i, low, first, last = regions(doc, pos, index.item[k], index.at[k], q, index.need, edits)
                score = np.zeros(len(d), np.int64)
                order = np.argsort(last - first, kind="stable")
                slack = edits * (q + 1) + 1  # before the first and after the last hit there is room for an edit and less than q characters, for each edit
                for c in range(0, len(order), REGIONS):
                    r = order[c : c + REGIONS]
                    start = np.maximum(first[r] - slack, begin[d[r]])
                    end = np.minimum(last[r] + slack, begin[d[r] + 1] - 1)
                    score[r] = aligned(codes, index.codes, start, end, low[r], index.start[i[r] + 1] - 1, index.start[i[r]], 2 * (edits + 1))
                best: dict[tuple, int] = {}
                for a, b, s, least in zip(d.tolist(), i.tolist(), score.tolist(), index.least[i].tolist(), strict=True):
                    if s >= least:
                        best[a, b] = max(s, best.get((a, b), 0))
                split: dict[int, list[str]] = {}
                sorted_pairs, at = pair[by_pair], index.at[k[by_pair]]
                for (a, b), s in sorted(best.items()):
                    if a not in split:
                        w = docs[a].split(" ")
                        split[a] = [" ".join(w[x : x + n_words]) for x in range(len(w) - n_words + 1)]
                    shared = sum(x in runs[b] for x in split[a])
                    held = at[np.searchsorted(sorted_pairs, a * len(index.ids) + b, "left") : np.searchsorted(sorted_pairs, a * len(index.ids) + b, "right")]
                    almost = bool(shared) or any(near(docs[a], x, int(index.budget(len(x)))) for x in index.possible(b, held))
                    out.append((doc_ids[a], int(index.ids[b]), s, shared, almost))
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64() if c < 4 else pa.bool_()) for c in range(5)], names=["doc_id", "item_id", "score", "shared_runs", "near"])

        doc_ids: list = []
        docs: list[str] = []
        size = 0
        for b in batches:
            done = "joined" in b.schema.names
            for x, t in zip(b.column("doc_id").to_pylist(), b.column("joined" if done else "text").to_pylist(), strict=True):
                doc_ids.append(x)
                docs.append(t if done else " ".join(words(t)))
                size += len(docs[-1])
                if size > CHUNK:
                    yield look(doc_ids, docs)
                    doc_ids, docs, size = [], [], 0
        if docs:
            yield look(doc_ids, docs)

    return run


def pack_items(items: DataFrame, item_id: str, text: str, n_words: int, most: int = ITEM_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The evaluation texts as normalised strings, in packs of at most `most` characters (one longer text is a pack)."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).distinct().toLocalIterator():
        w = words(r[1])
        if len(w) < n_words:
            continue
        t = " ".join(w)
        if size and size + len(t) > most:
            yield np.array(ids), texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(t)
        size += len(t)
    if ids:
        yield np.array(ids), texts


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([" ".join(words(t)) for t in b.column("text").to_pylist()], pa.string())], names=["doc_id", "joined"])


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n_words: int = WORDS, per_edit: int = PER_EDIT, q: int = Q) -> DataFrame:
    """(doc_id, item_id, score, shared_runs, near): documents with a passage of an item, exact or with edits.

    score is that of the best alignment: the characters in common, less 2 for each edit. shared_runs is the number of windows of n_words words that are
    exactly in both: 0 where the passage is only nearly the same. near: a whole run of n_words words is there with at most one edit of a character for each
    per_edit of its characters (one at least; per_edit=0: none). An item of fewer words has no passage. Null and empty texts share nothing; copies of a row
    come out once each, an item_id with several texts is one item for each. Documents are never shuffled. The items are broadcast in packs of bounded size,
    each indexed once in every Python worker; if there are several packs, the documents' words are written once and each pack reads those.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score long, shared_runs long, near boolean"
    packs = (spark.sparkContext.broadcast(p) for p in pack_items(items, item_id, text, n_words))
    sent = list(itertools.islice(packs, 2))
    if len(sent) > 1:
        rows, _ = materialize(rows.mapInArrow(_joined, "doc_id long, joined string"), "joined")
    parts = [rows.mapInArrow(_search(uuid.uuid4().hex, pack, n_words, per_edit, q), schema) for pack in itertools.chain(sent, packs)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
