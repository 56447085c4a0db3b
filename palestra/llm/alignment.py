"""The tokens of two tokenizers over the same texts, aligned, and how well pairs of ids
agree across the corpus.

Method: ``pandas.merge_asof`` per batch, keyed by document. Each token start of one side
finds the token of the other side that covers it; the union of both directions holds all
overlaps. Where two overlapping tokens end at the same byte, the text is cut into groups.
All tokens of one side in a group are linked with all of the other side there.

The pairs of ids linked in a document are stored once, distinct and with their number, and
counted by documents with partial aggregation. Counts go back to the documents in two ways
that do not depend on luck: pairs that a millionth of all stored pairs or more share are at
most 2^20, however large the corpus is, and are broadcast; the others have no hot key left
and are joined by shuffle. The highest count of each id of the first side has at most as many
rows as its vocabulary.

Defined results: null and empty texts, and texts that one side cannot give back byte by
byte, have no tokens; repeated rows and null ids are documents of their own; an empty table
gives an empty result; extra columns are ignored. A document's distinct pairs are held in one
task; the rows that carry them have at most ``PAIRS_PER_ROW`` each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import slices, spread
from palestra.llm.packing import _encoder
from palestra.llm.scratch import Scratch

# Pairs that at least one in so many stored pairs equals are broadcast: at most so many rows.
HEAVY = 1 << 20
PAIRS_PER_ROW = 1 << 16
# Pairs of tokens expanded at a time.
PAIRS_AT_ONCE = 1 << 21

_tables: dict[str, tuple] = {}
_written: dict[int, list[str]] = {}


def _first_side(ranks_file: str):
    """Ids of a text by the byte-level vocabulary, in which special tokens are plain text, and
    the bytes of each id."""
    if ranks_file not in _tables:
        plain, full, spaces, *_ = _encoder(ranks_file)
        with open(ranks_file, "rb") as file:
            content = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
        table = [content.get(k, b"") for k in range(max(content) + 1)]
        encode = lambda text: (full if spaces.search(text) else plain).encode_ordinary(text)
        _tables[ranks_file] = encode, table, np.array([len(x) for x in table])
    return _tables[ranks_file]


def _second_side(model_file: str):
    """The same for a model of pieces, which sets a space before each text itself."""
    if model_file not in _tables:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        table = [
            bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(pieces)
        ]
        _tables[model_file] = model.encode, table, np.array([len(x) for x in table])
    return _tables[model_file]


def _cuts(a_size: np.ndarray, b_size: np.ndarray, a_row: np.ndarray, b_row: np.ndarray):
    """The group of each token of either side, numbered over the batch. Both sides hold the
    same bytes of the same documents."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a = pd.DataFrame({"document": a_row, "start": a_end - a_size, "a": np.arange(len(a_size))})
    b = pd.DataFrame({"document": b_row, "start": b_end - b_size, "b": np.arange(len(b_size))})
    overlaps = pd.concat([
        pd.merge_asof(a, b, on="start", by="document")[["a", "b"]],
        pd.merge_asof(b, a, on="start", by="document")[["a", "b"]],
    ]).to_numpy(np.int64)
    closes = overlaps[a_end[overlaps[:, 0]] == b_end[overlaps[:, 1]]]
    groups = []
    for size, own in ((len(a_size), closes[:, 0]), (len(b_size), closes[:, 1])):
        last = np.zeros(size, np.int64)
        last[own] = 1
        groups.append(np.cumsum(last) - last)
    return groups


class Aligned:
    """The tokens of some texts and their groups, as flat arrays."""

    def __init__(self, texts: list[str | None], ranks_file: str, model_file: str):
        encode_a, table_a, sizes_a = _first_side(ranks_file)
        encode_b, table_b, sizes_b = _second_side(model_file)
        found_a = [encode_a(" " + t) if t else [] for t in texts]
        found_b = encode_b([t or "" for t in texts], num_threads=1)
        for k, text in enumerate(texts):
            if text:
                content = b" " + text.encode()
                if any(b"".join([table[i] for i in ids]) != content
                       for table, ids in ((table_a, found_a[k]), (table_b, found_b[k]))):
                    text = None
            if not text:
                found_a[k] = found_b[k] = []
        self.vocabulary = max(len(table_a), len(table_b))
        self.n_a, self.n_b = (np.array([len(x) for x in found], np.int64) for found in (found_a, found_b))
        self.a, self.b = (np.array([i for x in found for i in x], np.int64) for found in (found_a, found_b))
        self.rows_a, self.rows_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        self.group_a, self.group_b = _cuts(sizes_a[self.a], sizes_b[self.b], self.rows_a, self.rows_b)
        groups = int(self.group_a[-1]) + 1 if len(self.a) else 0
        self.in_a, self.in_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        self.rows = self.rows_a[np.cumsum(self.in_a) - self.in_a]  # of each group
        self.n_groups = np.bincount(self.rows, minlength=len(texts))
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.rows, self.in_a * self.in_b)

    def written(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        last = np.zeros(len(self.a), np.int64)
        last[np.cumsum(self.in_a) - 1] = 1
        sequence = np.zeros(len(self.a) + len(self.b), np.int64)
        before_b, until_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        sequence[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + self.vocabulary * last
        last = np.zeros(len(self.b), np.int64)
        last[np.cumsum(self.in_b) - 1] = 2
        sequence[np.arange(len(self.b)) + until_a[self.group_b]] = self.b + self.vocabulary * last
        if self.vocabulary not in _written:
            _written[self.vocabulary] = [f"{k}{mark}" for mark in ",|;" for k in range(self.vocabulary)]
        written = _written[self.vocabulary]
        ends = np.cumsum(self.n_a + self.n_b)
        codes = sequence.tolist()
        return ["".join([written[c] for c in codes[a:b]])[:-1] for a, b in zip(ends - self.n_a - self.n_b, ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, distinct pair of ids linked there, and how often."""
        one, two = ([np.stack(x) for x in (self._distinct(self.group_a, self.a), self._distinct(self.group_b, self.b))])
        sizes = [np.bincount(x[0], minlength=len(self.rows)) for x in (one, two)]
        firsts = [np.cumsum(n) - n for n in sizes]
        ends = np.cumsum(sizes[0] * sizes[1])
        none = np.zeros(0, np.int64)
        found, first = (none, none, none), 0
        while first < len(ends):
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS_AT_ONCE, "right"))
            last = max(first + 1, last)
            group, place = spread((sizes[0] * sizes[1])[first:last])
            group += first
            left, right = firsts[0][group] + place // sizes[1][group], firsts[1][group] + place % sizes[1][group]
            more = self.rows[group], (one[1][left] << 32) | two[1][right], one[2][left] * two[2][right]
            found = _summed(*(np.concatenate(x) for x in zip(found, more)))
            first = last
        return found

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, times = np.unique((group << 32) | ids, return_counts=True)
        return keys >> 32, keys & 0xFFFFFFFF, times


def _summed(row: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort([pair, row])
    row, pair, times = row[order], pair[order], times[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(pair) != 0)
    at = np.flatnonzero(new)
    return row[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def groups(docs: DataFrame, ranks_file: str, model_file: str) -> DataFrame:
    """Per group of aligned tokens: doc_id, its number in the document, the ids of both sides."""
    ids = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("group", T.LongType()), T.StructField("a", ids), T.StructField("b", ids)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Aligned(batch.column("text").to_pylist(), ranks_file, model_file)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int64()))
                for n, ids in ((found.in_a, found.a), (found.in_b, found.b))
            ]
            number = spread(found.n_groups)[1]
            columns = [batch.column("doc_id").take(pa.array(found.rows)), pa.array(number, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def links(docs: DataFrame, ranks_file: str, model_file: str) -> DataFrame:
    """Per document its numbers of tokens, groups and links, the digest of its groups, and its
    distinct linked pairs (the first side's id in the upper 32 bits) with how often each occurs.
    ``row`` tells documents of one id apart; where a document has very many pairs, further rows
    of it hold the pairs alone."""
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType(
        [T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("first", T.BooleanType()),
         *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("groups_sha256", T.StringType()),
         T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            found = Aligned(batch.column("text").to_pylist(), ranks_file, model_file)
            owner, pair, times = found.pairs()
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            parts = np.maximum(1, -(-np.diff(bounds) // PAIRS_PER_ROW))
            row, part = spread(parts)
            starts = np.append(bounds[row] + part * PAIRS_PER_ROW, bounds[-1])
            content = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int64())], ["pair", "times"])
            hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.written()]
            values = [found.n_a, found.n_b, found.n_groups, found.n_links, np.array(hashes, object)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + row, pa.int64()), batch.column("doc_id").take(at), pa.array(part == 0),
                 *(pa.array(v, pa.int64() if v.dtype != object else pa.string()).take(at) for v in values),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), content)],
                names=schema.names,
            )
            number += batch.num_rows

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def counted(found: DataFrame) -> DataFrame:
    """How many documents hold each pair, and whether no pair of its first id is in more."""
    # a document's pairs are distinct, also over its rows
    counts = found.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.select("pair", "n", F.shiftright("pair", 32).cast("int").alias("a"))


def scored(
    docs: DataFrame, ranks_file: str, model_file: str, heavy: int = HEAVY, scratch: Scratch | None = None
) -> DataFrame:
    """Per document the digest of its alignment, how many links are the most common for their
    first id, and the sum of the links' counts."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(links(docs, ranks_file, model_file), "links")
    counts = scratch.table(counted(found), "counts")
    n_pairs, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # no more rows than the vocabulary has
    counts = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    single = found.select("row", F.inline("pairs"))
    if n_pairs <= heavy:
        known = single.join(F.broadcast(counts), "pair")
    else:
        # pairs with n * heavy >= total: no more than ``heavy`` of them can be
        common = F.col("n") * heavy >= total
        marked = single.join(F.broadcast(counts.where(common)), "pair", "left")
        rare = marked.where(F.col("n").isNull()).select("pair", "row", "times")
        known = marked.where(F.col("n").isNotNull()).unionByName(rare.join(counts.where(~common).hint("shuffle_merge"), "pair"))
    sums = known.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    return found.where("first").drop("pairs", "first").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
