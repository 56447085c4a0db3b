"""Recurring passages removed from all places but their first.

Method: repeated-phrase automata. Windows of words are gathered in cells, the runs of
neighbouring windows that share their smallest five-word hash, so equal windows meet under
that hash, their anchor. Cells of anchors seen once go, and equal cells are one class with
its first place; the other members repeat it as a whole. A cell that follows itself again and
again, as in a run of one word, is one row with the number of times. Where an anchor has several
classes, these may share some windows. There the windows of one member of each class are
counted by their words, and those that occur in several classes are the confirmed phrases.
Sharded by anchor, they are compiled into Aho-Corasick automata over words, the members are
streamed through them, and each occurrence that is not the first one is marked.

Counts are pre-aggregated per task. An anchor with many classes is cut into shards by the
hash of the phrase; a member goes to the shards of its own windows, of which a cell has at most
16, so the rows grow with the classes and not with their square. An automaton holds some
``WINDOWS_PER_AUTOMATON`` phrases of 20 words, members pass it one after the other, and it is
gone before the next is built.

Defined results: a null or empty text has no words; rows that repeat a doc_id, or have none,
are one document, so that they do not repeat each other at the same place; null ids come
last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import Hasher, SequenceHasher, joined, signed, slices, windows, words
from palestra.llm.scratch import Scratch
from palestra.llm.suffixes import apply_runs, bitmap_of, counted, first_places, keyed, passing, runs_removed, series

WINDOW = 20
GRAM = 5
CLASSES_PER_SHARD = 1000
WINDOWS_PER_AUTOMATON = 16_000
# Bytes of text whose cells a task finds at a time; arrays take some 60 times as much.
CELL_BYTES = 1 << 18
# Bytes of lines that a task cuts into windows at a time.
LINE_BYTES = 1 << 17


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest of each ``width`` neighbours; width is a power of 2."""
    place = np.arange(len(values))
    step = 1
    while step < width:
        left, right = place[:-step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        step *= 2
    return place


def cells(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: the text, the first word within it, the number of
    windows, the anchor's hash, the hash of all words of the cell, and how many times in a row
    the cell stands there."""
    starts, ends, first = words(data, offsets)
    hashes = Hasher(data)(starts, ends)
    grams = windows(hashes, GRAM)
    place = _first_smallest(grams, WINDOW - GRAM + 1)[: max(0, len(starts) - WINDOW + 1)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(place)
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 : WINDOW - 1 + n])
    if len(at) == 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    opens = np.flatnonzero(new)
    sizes = np.diff(np.append(opens, len(at)))
    begin = at[opens]
    cell = SequenceHasher(hashes)(begin, begin + sizes + WINDOW - 1)
    row, anchor = text[begin], grams[place[begin]]
    one, times = series(row, begin, sizes, anchor, cell)
    return row[one], (begin - first[row])[one], sizes[one], anchor[one], cell[one], times


def _recurring_anchors(docs: DataFrame) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CELL_BYTES):
            *_, anchor, _, times = cells(*joined(batch.column("text")))
            values, counts = counted(anchor, times)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["anchor", "n"])

    counts = docs.select("text").mapInArrow(rows, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return bitmap_of(counts.where("n > 1"), "anchor")


def recurring_cells(docs: DataFrame) -> DataFrame:
    """Where the cells of recurring anchors are."""
    recurring = docs.sparkSession.sparkContext.broadcast(_recurring_anchors(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CELL_BYTES):
            text, start, sizes, anchor, cell, times = cells(*joined(batch.column("text")))
            keep = passing(anchor, recurring.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor[keep])), pa.array(signed(cell[keep])),
                 *(batch.column(c).take(pa.array(text[keep])) for c in ("doc", "copy")),
                 pa.array(start[keep]), pa.array(sizes[keep]), pa.array(times[keep])],
                names=["anchor", "cell", "doc", "copy", "start", "size", "times"],
            )

    return keyed(docs).select("doc", "copy", "text").mapInArrow(
        rows, "anchor long, cell long, doc long, copy long, start long, size long, times long"
    )


def _lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The words of the first member of each class."""
    is_first = first_places(classes, "cell")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CELL_BYTES):
            text, start, sizes, anchor, cell, _ = cells(*joined(batch.column("text")))
            keep = np.flatnonzero(is_first(cell, batch.column("doc").to_numpy()[text], start))
            lines, row, split = [], -1, []
            for r, a, n in zip(text[keep].tolist(), start[keep].tolist(), sizes[keep].tolist()):
                if r != row:
                    row, split = r, batch.column("text")[r].as_py().encode().split()
                lines.append(b" ".join(split[a : a + n + WINDOW - 1]).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor[keep])), pa.array(signed(cell[keep])),
                 batch.column("doc").take(pa.array(text[keep])), pa.array(start[keep]), pa.array(lines, pa.string())],
                names=["anchor", "cell", "doc", "start", "words"],
            )

    found = keyed(docs).select("doc", "text").mapInArrow(rows, "anchor long, cell long, doc long, start long, words string")
    key = ["anchor", "cell", "doc", "start"]
    # rows that repeat a doc_id give the same cell at the same place
    return found.join(classes.select(*key), key, "left_semi").dropDuplicates(key)


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each line: its words, and where it is."""
    for batch in slices(batches, "words", LINE_BYTES):
        owner, step, text = [], [], []
        for row, line in enumerate(batch.column("words").to_pylist()):
            split = line.split(" ")
            for k in range(len(split) - WINDOW + 1):
                owner.append(row)
                step.append(k)
                text.append(" ".join(split[k : k + WINDOW]))
        at = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in ("anchor", "cell", "doc", "start")]
            + [pa.array(step, pa.int64()), pa.array(text, pa.string())],
            names=["anchor", "cell", "doc", "start", "step", "window"],
        )


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases and lines come sorted by automaton, phrases first. For each line the windows
    that have an earlier place than their own in it."""
    import ahocorasick

    ids: dict[str, int] = {}
    automaton, current, made = None, None, False
    for batch in slices(batches, "words"):
        columns = ("automaton", "words", "doc", "start", "anchor", "cell", "steps")
        found: list[tuple] = []
        for number, line, doc, start, anchor, cell, steps in zip(*(batch.column(c).to_pylist() for c in columns)):
            if number != current:
                automaton, ids = None, {}  # freed before the next one is built
                automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                current, made = number, False
            if steps is not None:
                numbers = tuple(ids.setdefault(w, len(ids) + 1) for w in line.split(" "))
                for k in steps:
                    automaton.add_word(numbers[k : k + WINDOW], (doc, start + k))
            elif len(automaton):
                if not made:
                    automaton.make_automaton()
                    made = True
                hits = automaton.iter(tuple(ids.get(w, 0) for w in line.split(" ")))  # 0 is in no phrase
                at = ((end - WINDOW + 1, place) for end, place in hits)
                again = [k for k, place in at if place != (doc, start + k)]
                if again:
                    found.append((anchor, cell, again))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))],
            names=["anchor", "cell", "again"],
        )


def located(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Per class the windows of its first member that have an earlier place in another class.
    ``lines`` are the first members with the number of ``parts`` of their anchor."""

    def windows_of(some: DataFrame) -> DataFrame:
        schema = "anchor long, cell long, doc long, start long, step long, window string"
        return some.select("anchor", "cell", "doc", "start", "words").mapInArrow(_windows_of, schema).select(
            "anchor", "cell", "doc", (F.col("start") + F.col("step")).alias("at"), "step",
            F.xxhash64("window").alias("h"), F.xxhash64("window", F.lit(1)).alias("g"),
        )

    parts = lines.select("anchor", "parts").distinct()
    # confirmed phrases: the same words in several classes, with their first place
    confirmed = scratch.table(
        windows_of(lines).groupBy("anchor", "h", "g").agg(F.min(F.struct("doc", "at", "step", "cell")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").join(parts, "anchor")
        .select("anchor", F.col("first.cell").alias("cell"), F.col("first.step").alias("step"), F.pmod("h", "parts").alias("part")),
        "confirmed",
    )
    total = confirmed.count()
    automata = F.lit(max(1, -(-total // WINDOWS_PER_AUTOMATON)))
    automaton = F.pmod(F.xxhash64("anchor", "part"), automata).alias("automaton")
    text = ["anchor", "cell", "words", "doc", "start"]
    phrases = lines.select(*text).join(
        confirmed.groupBy("anchor", "cell", "part").agg(F.collect_list("step").alias("steps")),  # of one cell: at most 16
        ["anchor", "cell"],
    )
    # a line goes to the parts of its windows: mostly there is one part
    cut = lines.where("parts > 1")
    several = windows_of(cut).join(parts, "anchor").select("anchor", "cell", F.pmod("h", "parts").alias("part")).distinct()
    nothing = F.lit(None).cast("array<long>").alias("steps")
    streams = lines.where("parts = 1").select(*text, F.lit(0).cast("long").alias("part")).unionByName(
        cut.select(*text).join(several, ["anchor", "cell"])
    )
    sharded = phrases.unionByName(streams.select("*", nothing)).select("*", automaton).repartition("automaton")
    found = sharded.sortWithinPartitions("automaton", F.col("steps").isNull()).mapInArrow(
        _located, "anchor long, cell long, again array<long>"
    )
    return found.groupBy("anchor", "cell").agg(F.flatten(F.collect_list("again")).alias("again"))  # at most 16


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document runs of starts of windows whose words also start earlier."""
    found = scratch.table(recurring_cells(docs), "cells")
    key = ["anchor", "cell", "size"]
    classes = scratch.table(
        found.groupBy(*key).agg(F.min(F.struct("doc", "start")).alias("first")).select(*key, "first.doc", "first.start"),
        "classes",
    )
    several = scratch.table(
        classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
        .select("anchor", F.ceil(F.col("n") / CLASSES_PER_SHARD).cast("long").alias("parts")),
        "several",
    )
    compared = scratch.table(classes.join(several, "anchor", "left_semi"), "compared")
    lines = scratch.table(_lines(docs, compared).join(several, "anchor"), "lines")
    return runs_removed(found, classes.join(located(lines, scratch), ["anchor", "cell"], "left"), key)


def deduplicated(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per document the number of words, of removed ones, and the words that are left, as
    one text with single spaces."""
    scratch = scratch or Scratch(docs.sparkSession)
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
         T.StructField("text", T.StringType())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs")):
                split = (text or "").encode().split()
                marked = np.zeros(len(split) + 1, np.int64)
                if found.is_valid:
                    start = found.values.field("start").to_numpy()
                    np.add.at(marked, start, 1)
                    np.add.at(marked, start + found.values.field("n").to_numpy() + WINDOW - 1, -1)
                gone = np.cumsum(marked[:-1]) > 0
                total.append(len(split))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(split, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=schema.names,
            )

    return apply_runs(docs, repeated_windows(docs, scratch), rows, schema, scratch)


def digests(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``deduplicated`` with a digest in place of the text."""
    return deduplicated(docs, scratch).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
