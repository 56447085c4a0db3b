"""Repeated byte strings removed from all places but their first.

Method: prefix-free parsing. A rolling hash sets triggers: of all short byte strings within
a span, the one with the smallest hash. Triggers cut the corpus into phrases; a phrase with
the bytes after it that its strings reach makes a dictionary entry, so no entry is cut off
where another one goes on. The dictionary is the set of different entries; the parse is
where they occur. Strings of the wanted length that are equal have the same trigger at the
same distance, so the corpus order is built trigger by trigger: a suffix array of the
dictionary, by doubling of ranks over the bytes up to the wanted length, and the parse
ordered by entry and place. Together they give, for neighbours whose common prefix has the
whole length, the first place in the corpus. The parse needs no order beyond one phrase,
since an entry holds all bytes that its strings reach. An entry that is alone at its trigger
needs no suffixes at all: its first occurrence stays, the others repeat it. That is why
copies cost a row per phrase only. A phrase that follows itself again and again, as in a run
of one letter, is one row of the parse with the number of times.

Counts and first places are pre-aggregated per task; nothing is grouped beyond one string
or a bounded number of entries.

Defined results: a null text is empty; rows that repeat a doc_id, or have none, are one
document, so that they do not repeat each other at the same place; null ids come last; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import Hasher, joined, mixed, signed, slices, spread
from palestra.llm.scratch import Scratch

LENGTH = 100
# Long enough that other text hardly shares a trigger, short enough that a string has two or more.
TRIGGER = 32
FILTER_BITS = 26
# Bytes of text whose entries a task finds at a time: arrays of so many numbers stay in the cache.
ENTRY_BYTES = 1 << 17
# Entries of one trigger whose suffixes a task puts in order together.
ENTRIES_AT_ONCE = 10_000
# Entries of all triggers that share a sort, so that its arrays stay in the cache.
ENTRIES_PER_SORT = 1000
LAST = 2**63 - 1


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest of each ``width`` neighbours, by the upper 32 bits."""
    # the place in the lower bits breaks ties and comes along
    keys = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    if width > step:
        rest = width - step
        keys = np.minimum(keys[: len(keys) - rest], keys[rest:])
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Entries:
    """The phrases of a slice of texts: the row, the first byte of its strings, how many
    strings begin in it, its trigger's hash, the hash of the whole entry, and how many times
    in a row it stands there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, none = data, np.zeros(0, np.int64)
        self.row = self.start = self.size = self.begin = self.times = none
        self.trigger = self.entry = none.view(np.uint64)
        if len(data) < LENGTH:
            return
        hasher = Hasher(data)
        grams = hasher.windows(TRIGGER)
        place = _first_smallest(grams, LENGTH - TRIGGER + 1)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = np.flatnonzero(row[: len(place)] == row[LENGTH - 1 : LENGTH - 1 + len(place)])
        if len(whole) == 0:
            return
        new = np.ones(len(whole), bool)
        new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (whole[1:] != whole[:-1] + 1)
        opens = np.flatnonzero(new)
        self.size = np.diff(np.append(opens, len(whole)))
        self.begin = whole[opens]
        self.row = row[self.begin]
        self.start = self.begin - offsets[self.row]
        self.trigger = grams[place[self.begin]]
        # the distance to the trigger is part of what makes entries equal
        self.entry = hasher(self.begin, self.begin + self.size + LENGTH - 1)
        first, self.times = series(self.row, self.begin, self.size, self.trigger, self.entry)
        for name in ("row", "start", "size", "begin", "trigger", "entry"):
            setattr(self, name, getattr(self, name)[first])


def series(row, begin, size, *content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each series of neighbours with equal content, each of which begins where
    the one before ends, and their numbers."""
    again = np.zeros(len(begin), bool)
    again[1:] = (row[1:] == row[:-1]) & (size[1:] == size[:-1]) & (begin[1:] == begin[:-1] + size[:-1])
    for values in content:
        again[1:] &= values[1:] == values[:-1]
    first = np.flatnonzero(~again)
    return first, np.diff(np.append(first, len(begin)))


def counted(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values and how often they occur."""
    found, place = np.unique(values, return_inverse=True)
    return found, np.bincount(place, times, len(found)).astype(np.int64)


def passing(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    low = (values & np.uint64(2**FILTER_BITS - 1)).astype(np.int64)
    return (bitmap[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) > 0


def bitmap_of(found: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size that all values of the column pass."""
    mask = 2**FILTER_BITS - 1
    words = found.groupBy(F.shiftright(F.col(column).bitwiseAND(mask), 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(({column} & {mask}) & 63 AS INT))")).alias("bits")
    )
    bitmap = np.zeros(2 ** (FILTER_BITS - 6), np.int64)
    for word, bits in words.toLocalIterator():
        bitmap[word] = bits
    return bitmap.view(np.uint64)


def _place_hash(content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of a content at a place."""
    place = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.int64).view(np.uint64)
    return mixed(content.view(np.uint64) ^ mixed(place))


def first_places(classes: DataFrame, content: str):
    """A test for the places of the classes' first members, by a bitmap of fixed size: of the
    members of a class hardly another one passes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _place_hash(*(batch.column(c).to_numpy() for c in (content, "doc", "start")))
            yield pa.RecordBatch.from_arrays([pa.array(signed(found))], names=["h"])

    places = classes.select(content, "doc", "start").mapInArrow(rows, "h long")
    bitmap = classes.sparkSession.sparkContext.broadcast(bitmap_of(places, "h"))
    return lambda contents, doc, start: passing(_place_hash(contents, doc, start), bitmap.value)


def _recurring_triggers(docs: DataFrame) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=ENTRY_BYTES):
            e = Entries(*joined(batch.column("text")))
            values, counts = counted(e.trigger, e.times)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["trigger", "n"])

    counts = docs.select("text").mapInArrow(rows, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    return bitmap_of(counts.where("n > 1"), "trigger")


def parse(docs: DataFrame) -> DataFrame:
    """Where the entries of recurring triggers occur."""
    recurring = docs.sparkSession.sparkContext.broadcast(_recurring_triggers(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=ENTRY_BYTES):
            e = Entries(*joined(batch.column("text")))
            keep = passing(e.trigger, recurring.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(e.trigger[keep])), pa.array(signed(e.entry[keep])),
                 *(batch.column(c).take(pa.array(e.row[keep])) for c in ("doc", "copy")),
                 pa.array(e.start[keep]), pa.array(e.size[keep]), pa.array(e.times[keep])],
                names=["trigger", "entry", "doc", "copy", "start", "size", "times"],
            )

    return keyed(docs).select("doc", "copy", "text").mapInArrow(
        rows, "trigger long, entry long, doc long, copy long, start long, size long, times long"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """With ``doc`` to order by, and ``copy`` to tell texts of one doc_id apart."""
    return docs.select("doc_id", "text").withColumns(
        {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "copy": F.xxhash64("text")}
    )


def _suffixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The truncated suffixes of the entries of a batch: the bytes of all entries, and of each
    suffix the row, the step and where it begins."""
    data, offsets = joined(batch.column("content"))
    sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    owner, step = spread(sizes)
    return data, owner, step, offsets[:-1][owner] + step


def suffix_ranks(data: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The rank of ``length`` bytes from each place among all of them, in the order of bytes;
    equal ones have one rank. Ranks of strings of twice the width come from two ranks."""

    def ranked(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].astype(np.uint64)

    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    width = min(8, length)
    keys = np.zeros(len(data), np.uint64)
    for k in range(width):
        keys = (keys << np.uint64(8)) | padded[k : k + len(data)]
    if width == length:
        return ranked(keys[begin])
    rank = ranked(keys)
    while True:
        step = min(width, length - width)
        # places whose string ends behind the data are not asked for
        after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.uint64)])
        keys = rank << np.uint64(32) | after
        if 2 * width >= length:
            return ranked(keys[begin])
        rank, width = ranked(keys), 2 * width


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per suffix, with its bytes."""
    for batch in slices(batches, "content", ENTRY_BYTES):
        data, owner, step, begin = _suffixes(batch)
        columns = [batch.column(c).take(pa.array(owner)) for c in ("trigger", "entry", "doc", "start")]
        content = pa.py_buffer(np.ascontiguousarray(data[begin[:, None] + np.arange(LENGTH)]))
        places = pa.py_buffer((np.arange(len(begin) + 1) * LENGTH).astype(np.int32))
        suffix = pa.Array.from_buffers(pa.binary(), len(begin), [None, places, content])
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(step), suffix], names=["trigger", "entry", "doc", "start", "step", "suffix"]
        )


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by trigger. Their suffixes are put in order, and of neighbours that
    share the whole length the first in the corpus goes to its entry."""

    def sorted_out(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        data, owner, step, begin = _suffixes(batch)
        rank = suffix_ranks(data, begin)
        trigger, doc, start = (batch.column(c).to_numpy()[owner] for c in ("trigger", "doc", "start"))
        order = np.lexsort((start + step, doc, rank, trigger))
        new = np.ones(len(order), bool)
        new[1:] = (trigger[order[1:]] != trigger[order[:-1]]) | (rank[order[1:]] != rank[order[:-1]])
        firsts = np.sort(order[new])
        places = np.searchsorted(owner[firsts], np.arange(batch.num_rows + 1)).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(places), pa.array(step[firsts]))
        return pa.RecordBatch.from_arrays([batch.column("trigger"), batch.column("entry"), own], names=["trigger", "entry", "own"])

    kept, rows = [], 0
    for batch in slices(batches, "content", ENTRY_BYTES):
        trigger = batch.column("trigger").to_numpy()
        cuts = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
        if rows + batch.num_rows > ENTRIES_PER_SORT and rows and kept[-1].column("trigger")[-1].as_py() != trigger[0]:
            yield sorted_out(kept)
            kept, rows = [], 0
        elif rows + batch.num_rows > ENTRIES_PER_SORT and len(cuts):
            yield sorted_out([*kept, batch.slice(0, cuts[-1])])
            kept, rows, batch = [], 0, batch.slice(cuts[-1])
        kept.append(batch)
        rows += batch.num_rows
    if rows:
        yield sorted_out(kept)


def _contents(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The bytes of the dictionary entries, where they occur first."""
    is_first = first_places(dictionary, "entry")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=ENTRY_BYTES):
            e = Entries(*joined(batch.column("text")))
            keep = np.flatnonzero(is_first(e.entry, batch.column("doc").to_numpy()[e.row], e.start))
            raw = e.data.tobytes()
            ends = e.begin[keep] + e.size[keep] + LENGTH - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(e.trigger[keep])), pa.array(signed(e.entry[keep])),
                 batch.column("doc").take(pa.array(e.row[keep])), pa.array(e.start[keep]),
                 pa.array([raw[a:b] for a, b in zip(e.begin[keep].tolist(), ends.tolist())], pa.binary())],
                names=["trigger", "entry", "doc", "start", "content"],
            )

    found = keyed(docs).select("doc", "text").mapInArrow(
        contents, "trigger long, entry long, doc long, start long, content binary"
    )
    first = found.join(dictionary.select("trigger", "entry", "doc", "start"), ["trigger", "entry", "doc", "start"], "left_semi")
    # rows that repeat a doc_id give the same entry at the same place
    return first.dropDuplicates(["trigger", "entry", "doc", "start"])


def _own_suffixes(contents: DataFrame, several: DataFrame) -> DataFrame:
    """Per entry the steps of the suffixes that no earlier place of the corpus has. The entries
    of a trigger are ordered together; those of a trigger with many are ordered by Spark, one
    row per suffix with its bytes, pre-aggregated, so that no trigger is a hot task."""
    usual = contents.join(several.where(F.col("n") <= ENTRIES_AT_ONCE), "trigger", "left_semi")
    ordered = usual.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(
        _ordered, "trigger long, entry long, own array<long>"
    )
    place = F.struct("doc", (F.col("start") + F.col("step")).alias("at"), "entry", "step")
    listed = contents.join(several.where(F.col("n") > ENTRIES_AT_ONCE), "trigger", "left_semi").mapInArrow(
        _listed, "trigger long, entry long, doc long, start long, step long, suffix binary"
    )
    firsts = listed.groupBy("trigger", "suffix").agg(F.min(place).alias("first"))
    return ordered.unionByName(
        firsts.groupBy("trigger", F.col("first.entry").alias("entry")).agg(F.collect_set("first.step").alias("own"))
    )


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document runs of starts of strings that also start earlier."""
    found = scratch.table(parse(docs), "parse")
    key = ["trigger", "entry", "size"]
    dictionary = scratch.table(
        found.groupBy(*key).agg(F.min(F.struct("doc", "start")).alias("first")).select(*key, "first.doc", "first.start"),
        "dictionary",
    )
    several = scratch.table(dictionary.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1"), "several")
    compared = scratch.table(dictionary.join(several, "trigger", "left_semi"), "compared")
    contents = scratch.table(_contents(docs, compared), "contents")
    own = scratch.table(_own_suffixes(contents, several), "own")
    scratch.drop(contents)
    known = compared.join(own, ["trigger", "entry"], "left").select(
        *key, "doc", "start",
        F.array_except(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), F.coalesce("own", F.array().cast("array<long>"))).alias("again"),
    )
    alone = dictionary.join(several, "trigger", "left_anti").select(
        *key, "doc", "start", F.lit(None).cast("array<long>").alias("again")
    )
    return runs_removed(found, known.unionByName(alone), key)


def runs_removed(found: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Members of a class but its first repeat it as a whole, and so do those that follow the
    first in a series. The first, whose place the class has, repeats others at the steps in
    ``again``, if any."""
    firsts = classes.select(
        *key, F.col("doc").alias("first_doc"), F.col("start").alias("first_start"),
        F.coalesce("again", F.array().cast("array<long>")).alias("again"),
    )
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))

    def run(start: Column, n: Column) -> Column:
        return F.struct(start.alias("start"), n.cast("long").alias("n"))

    start, size, times = F.col("start"), F.col("size"), F.col("times")
    some = F.transform("again", lambda k: run(start + k, F.lit(1)))
    rest = F.filter(F.array(run(start + size, size * (times - 1))), lambda r: r["n"] > 0)
    whole = F.array(run(start, size * times))
    return (
        found.join(firsts, key)
        .select("doc", "copy", F.when(is_first, F.concat(some, rest)).otherwise(whole).alias("runs"))
        .where("size(runs) > 0")
    )


def apply_runs(docs: DataFrame, runs: DataFrame, remove, schema: T.StructType, scratch: Scratch) -> DataFrame:
    """``remove`` over doc_id, text and the document's runs. Only documents that may have runs,
    by a bitmap of fixed size, are joined with theirs; the texts of the others stay in place."""
    # rows that repeat a document have the same runs, which count once
    of_doc = runs.groupBy("doc", "copy").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    stored = scratch.table(of_doc.withColumn("h", F.xxhash64("doc", "copy")), "runs")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(stored, "h"))
    hashed = keyed(docs).withColumn("h", F.xxhash64("doc", "copy"))

    def has_runs(batch: pa.RecordBatch) -> np.ndarray:
        return passing(batch.column("h").to_numpy().view(np.uint64), bitmap.value)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_runs(batch)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one step with ``remove``, so that a task needs one Python worker."""

        def given():
            for batch in batches:
                rest = batch.filter(pa.array(~has_runs(batch)))
                nothing = pa.nulls(rest.num_rows, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [rest.column("doc_id"), rest.column("text"), nothing], names=["doc_id", "text", "runs"]
                )

        return remove(given())

    found = hashed.mapInArrow(chosen, hashed.schema).join(stored.select("doc", "copy", "runs"), ["doc", "copy"], "left")
    marked = found.select("doc_id", "text", "runs").mapInArrow(remove, schema)
    return marked.unionByName(hashed.mapInArrow(others, schema))


def deduplicated(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per document its bytes without the repeated strings, and how much was removed."""
    scratch = scratch or Scratch(docs.sparkSession)
    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
         T.StructField("kept", T.BinaryType())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, kept = [], []
            data, offsets = joined(batch.column("text"))
            for row, found in enumerate(batch.column("runs")):
                own = data[offsets[row] : offsets[row + 1]]
                marked = np.zeros(len(own) + 1, np.int64)
                if found.is_valid:
                    start = found.values.field("start").to_numpy()
                    np.add.at(marked, start, 1)
                    np.add.at(marked, start + found.values.field("n").to_numpy() + LENGTH - 1, -1)
                gone = np.cumsum(marked[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                counts.append((len(own), int(gone.sum()), spans))
                kept.append(own[~gone].tobytes())
            columns = list(zip(*counts)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.binary())],
                names=schema.names,
            )

    return apply_runs(docs, repeated(docs, scratch), rows, schema, scratch)


def digests(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``deduplicated`` with a digest in place of the bytes."""
    return deduplicated(docs, scratch).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
