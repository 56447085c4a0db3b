"""Periodic runs of words in each text, and the texts without the repeats.

Method: difference-cover LCE. Of the suffixes of a text only those at positions of a
difference cover are sorted: by blocks of words first, then by doubling along each residue
class. The common prefixes of neighbours in that order fill a sparse table for range
minima. How far two places agree (LCE) is then a comparison of a few words, until both
places meet the cover at once, and one look into the table. Runs are enumerated on the
harmonic grid: for each period q only every 2q-th place is paired with the one q later, as
a run of four periods holds such a place; LCE forwards, and backwards on the reversed text,
gives the whole run.

Each text is worked on within its task, in slices of about one megabyte; a longer text
makes a slice of its own, whose grid is walked in chunks. Nothing is shuffled.

Defined results: null and empty texts and those of too few words have no runs and, collapsed,
their words; equal rows give equal rows; null ids stay null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import slices, spread

# Shortest runs: in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Words per block of the difference cover.
COVER = 64
# Places of the grid that are compared at a time.
PAIRS_AT_ONCE = 1 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class SampledSuffixes:
    """LCE of any two places of a sequence of numbers from 0. The sequence must hold, behind
    each text, a number that occurs nowhere else."""

    def __init__(self, sequence: np.ndarray, cover: int = COVER):
        self.cover = cover
        self.sequence = np.concatenate([sequence, np.zeros(2 * cover, sequence.dtype)])
        n = len(sequence)
        root = int(np.ceil(np.sqrt(cover)))
        residues = np.unique([*range(root), *range(0, cover, root)])  # any difference is one of these less another
        self._shift = np.zeros(cover, np.int64)  # by difference: the residue of the earlier place where both meet the cover
        for x in residues:
            self._shift[(residues - x) % cover] = x
        sizes = np.array([len(range(d, n, cover)) for d in residues])
        self._first = np.full(cover, -1, np.int64)
        self._first[residues] = np.cumsum(sizes) - sizes
        group, step = spread(sizes)
        self._places = residues[group] + step * cover
        self._ends = np.cumsum(sizes)[group]  # of each sample's residue class
        levels = self._sorted()
        self.rank = levels[-1]
        self._table = self._minima(levels)

    def _index(self, places: np.ndarray) -> np.ndarray:
        return self._first[places % self.cover] + places // self.cover

    def _sorted(self) -> list[np.ndarray]:
        """Ranks of the samples by their first block, two blocks, four ... until all differ."""
        bits = max(1, int(self.sequence.max()).bit_length())
        at_once = max(1, 62 // bits)
        order = np.arange(len(self._places))
        differ = np.zeros(max(0, len(order) - 1), bool)
        keys = []
        for a in reversed(range(0, self.cover, at_once)):
            key = np.zeros(len(order), np.int64)
            for k in range(a, min(a + at_once, self.cover)):
                key = (key << bits) | self.sequence[self._places + k]
            keys.append(key)
            order = order[np.argsort(key[order], kind="stable")]
        for key in keys:
            differ |= np.diff(key[order]) != 0
        del keys
        levels, width = [self._ranks(order, differ)], 1
        while len(order) and levels[-1][order[-1]] < len(order) - 1:
            rank = levels[-1].astype(np.int64)
            later = np.arange(len(rank)) + width
            inside = later < self._ends
            key = rank * (len(rank) + 1)
            key[inside] += rank[later[inside]] + 1
            order = np.argsort(key, kind="stable")
            levels.append(self._ranks(order, np.diff(key[order]) != 0))
            width *= 2
        return levels

    @staticmethod
    def _ranks(order: np.ndarray, differ: np.ndarray) -> np.ndarray:
        found = np.zeros(len(order), np.int32)
        found[order[1:]] = np.cumsum(differ)
        return found

    def _minima(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """The sparse table over the common prefixes of neighbours in the sorted order."""
        order = np.argsort(self.rank)
        one, two = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(one), np.int64)
        for k in reversed(range(len(levels) - 1)):
            inside = (one < self._ends[order[:-1]]) & (two < self._ends[order[1:]])
            equal = np.flatnonzero(inside)
            equal = equal[levels[k][one[equal]] == levels[k][two[equal]]]
            one[equal] += 1 << k
            two[equal] += 1 << k
            common[equal] += self.cover << k
        inside = np.flatnonzero((one < self._ends[order[:-1]]) & (two < self._ends[order[1:]]))
        most = np.full(len(inside), self.cover)
        common[inside] += self._compared(self._places[one[inside]], self._places[two[inside]], most)
        table = [common.astype(np.int32 if len(self.sequence) < 2**31 else np.int64)]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _compared(self, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree, of the first ``most``, word by word."""
        found = np.zeros(len(one), np.int64)
        alive = np.flatnonzero(most > 0)
        for k in range(self.cover):
            alive = alive[(most[alive] > k)]
            alive = alive[self.sequence[one[alive] + k] == self.sequence[two[alive] + k]]
            if not len(alive):
                break
            found[alive] = k + 1
        return found

    def lce(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many words agree from each two different places on."""
        shift = (self._shift[(two - one) % self.cover] - one) % self.cover
        found = self._compared(one, two, shift)
        met = np.flatnonzero(found == shift)
        if len(met):
            a, b = (self.rank[self._index(x[met] + shift[met])] for x in (one, two))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.zeros(len(met), np.int64)
            for k in np.unique(level):
                own = np.flatnonzero(level == k)
                least[own] = np.minimum(self._table[k][low[own]], self._table[k][high[own] - (1 << int(k))])
            found[met] += least
        return found


def _grid(sizes: np.ndarray, pairs_at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The harmonic grid of texts of the given sizes, in chunks: text, period, place."""
    periods = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    text, q = spread(periods)
    q = q + 1
    steps = (sizes[text] - q - _needed(q)) // (2 * q) + 1
    ends = np.cumsum(steps)
    first = 0
    while first < len(steps):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + pairs_at_once, "right"))
        last = max(first + 1, last)
        combination, step = spread(steps[first:last])
        combination += first
        yield text[combination], q[combination], 2 * q[combination] * step
        first = last


def _needed(q: np.ndarray) -> np.ndarray:
    """How many words agree at least at the first place of the grid within a run."""
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * q) - 3 * q + 1


def _alike(
    sequence: np.ndarray, bases: np.ndarray, sizes: np.ndarray, pairs_at_once: int, most: int = COVER
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of the grid where enough words agree, as far as ``most`` words tell."""
    for text, q, place in _grid(sizes, pairs_at_once):
        at = bases[text] + place
        alive = np.flatnonzero(sequence[at] == sequence[at + q])
        needed = _needed(q[alive])
        passed = []
        for k in range(1, most):
            done = needed <= k
            passed.append(alive[done])
            alive, needed = alive[~done], needed[~done]
            if not len(alive):
                break
            same = sequence[at[alive] + k] == sequence[at[alive] + q[alive] + k]
            alive, needed = alive[same], needed[same]
        alive = np.concatenate([*passed, alive])
        if len(alive):
            yield text[alive], q[alive], place[alive]


def runs_of(
    texts: list[np.ndarray], cover: int = COVER, pairs_at_once: int = PAIRS_AT_ONCE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts that are given as word numbers: text, start, length, period, by
    text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    flat = np.concatenate([*texts, none]).astype(np.int64)
    bases = np.cumsum(sizes) - sizes
    marked = np.zeros(len(texts), bool)
    for text, _, _ in _alike(flat, bases, sizes, pairs_at_once):
        marked[text] = True
    chosen = np.flatnonzero(marked)
    if not len(chosen):
        return none, none, none, none
    last = int(flat.max()) + 1
    parts, back = [], []
    for k, t in enumerate(chosen):  # a text may take some place on its own, so that sorting stays within memory
        parts += [texts[t], [last + k]]
        back += [texts[t][::-1], [last + k]]
    forward = SampledSuffixes(np.concatenate(parts).astype(np.int64), cover)
    backward = SampledSuffixes(np.concatenate(back).astype(np.int64), cover)
    n = sizes[chosen]
    bases = np.cumsum(n + 1) - n - 1
    found = []
    for text, q, place in _alike(forward.sequence, bases, n, pairs_at_once):
        at = bases[text] + place
        after = forward.lce(at, at + q)
        enough = after >= _needed(q)
        text, q, place, after = text[enough], q[enough], place[enough], after[enough]
        turned = bases[text] + n[text] - place
        before = backward.lce(turned - q, turned)
        start, length = place - before, before + q + after
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.unique(np.stack([x[long] for x in (text, start, length, q)]), axis=1))
    rows = np.concatenate([*found, np.zeros((4, 0), np.int64)], axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    # a longer period over the same stretch is a multiple of the smallest
    smallest = np.ones(rows.shape[1], bool)
    smallest[1:] = (np.diff(rows[:3]) != 0).any(axis=0)
    text, start, length, period = rows[:, smallest]
    order = np.lexsort([period, start, text])
    return chosen[text[order]], start[order], length[order], period[order]


def collapsed(
    docs: DataFrame, rewrite: Rewrite | None = None, cover: int = COVER, pairs_at_once: int = PAIRS_AT_ONCE
) -> DataFrame:
    """Per document its runs, by start and period, and its text without the words that some
    run holds after its first period; words are joined by one space. ``rewrite`` may change the
    words of a document before."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            if rewrite:
                split = [rewrite(k, w) for k, w in zip(batch.column("doc_id").to_pylist(), split)]
            number = defaultdict(count().__next__)
            numbers = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split]
            text, start, length, period = runs_of(numbers, cover, pairs_at_once)
            bounds = np.searchsorted(text, np.arange(len(split) + 1))
            kept = []
            for words, a, b in zip(split, bounds, bounds[1:]):
                if a < b:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, start[a:b] + period[a:b], 1)
                    np.add.at(edges, start[a:b] + length[a:b], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                kept.append(b" ".join(words))
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)
            columns = [batch.column("doc_id"), lists, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in every tenth document by the checksum of its id, as
    the query's definition asks; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the one with the greatest exponent, and digests of
    all runs and of the collapsed text, after ``planted``."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a),
    )
    return collapsed(docs, planted).select("*", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
