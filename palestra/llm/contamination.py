"""Benchmark questions inside documents, also with other numbers, names and units.

Method: texts become sequences of canonical words, in which numbers, names and units are
typed placeholders. Windows of the benchmark's canonical words are hash-joined with those
of all documents. Matches of one document and item that lie on one alignment are put
together; their slots must map each value of the item to one value of the document, else
only windows without slots count. So a re-parameterised question is caught and a text that
merely has the same shape is not. An item that is shorter than a window is one window, its
whole canonical sequence. Capitals that open a sentence may begin a name or not, so windows
that hold one are made both ways, in items and documents alike. Windows of the words as they
stand, in lower case, are joined too. So a verbatim copy is found however many slots it has.

Document windows are tested against a bitmap of the benchmark's windows before the join.
Its size is fixed, so what is sent to the executors is bounded; what passes by chance is
removed by the join.

Defined results: null and empty texts have no windows; windows of which less than a quarter
is literal and items of three words are found as they stand only, items of one or two words
only where they are the whole text; each
text is judged by itself, also those that share a doc_id or have none, and ``clean`` drops
only the texts that hold an item; ``matches`` gives one row for each doc_id and item, of the
best text, and null ids form one group there; empty tables give no rows; extra columns are
ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import LOWER, Hasher, joined, mixed, runs, signed, slices, windows
from palestra.llm.scratch import Scratch

WIDTH = 8
SHORTEST = 4
# Words of an item that is found as it stands inside a text; shorter ones must be the text.
SHORTEST_INSIDE = 3
# Words of an item that must be found on one alignment, or this share of a shorter item.
COVERED = 13
SHARE = 0.8
BITMAP_BITS = 24

# fixed values: words that stand for a number, and units
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit "
    "kmh mph volt volts watt watts joule joules newton newtons meter meters metre metres"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_WORD = _DIGIT.copy()
_WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?:;\n\""]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(n) for n in (1, 2, 3))
# Tells words as they stand from canonical ones.
_AS_IS = np.uint64(0x9E3779B97F4A7C15)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters of two bytes."""
    found = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    found[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return found


def _hashes_of(listed: Sequence[str]) -> np.ndarray:
    data, offsets = joined(pa.array(listed, pa.string()))
    return np.sort(Hasher(data)(offsets[:-1], offsets[1:]))


_NUMBER_WORDS, _UNIT_WORDS = _hashes_of(NUMBERS), _hashes_of(UNITS)


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per word its canonical hash; for a slot the hash of its value, else 0; the hash of the
    word itself; and whether it opens a sentence and else were a name. Then the first word of
    each text, with the number of words last."""
    none = np.zeros(0, np.uint64)
    if len(data) == 0:
        return none, none, none, np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    digit = _DIGIT[data]
    inside = _WORD[data]
    point = (data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)  # within a number
    inside[1:-1] |= point & digit[:-2] & digit[2:]
    starts, ends, first = runs(inside, offsets)
    if len(starts) == 0:
        return none, none, none, np.zeros(0, bool), first
    value = Hasher(_lowered(data))(starts, ends)
    number = digit[starts] | _among(value, _NUMBER_WORDS)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & _among(value[1:], _UNIT_WORDS)
    second = data[np.minimum(starts + 1, len(data) - 1)]
    upper = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_BREAK[data], out=breaks[1:])
    opens = np.ones(len(starts), bool)
    opens[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    # words in capitals are no names
    title = upper & ~_UPPER[second] & ~number & ~unit
    name = title & ~opens
    words = value.copy()
    for kind, marked in ((_NUMBER, number), (_NAME, name), (_UNIT, unit)):
        words[marked] = kind
    return words, np.where(number | name | unit, mixed(value), np.uint64(0)), value, title & opens, first


def _windows_of(words, slots, first, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and texts of the windows that lie in one text, with a quarter of literals
    at least. Words without slots all are literals."""
    found = windows(words, width)
    n = len(found)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    filled = np.zeros(len(slots) + 1, np.int64)
    np.cumsum(slots != 0, out=filled[1:])
    literal = width - (filled[width : width + n] - filled[:n])
    at = np.flatnonzero((text[:n] == text[width - 1 : width - 1 + n]) & (4 * literal >= width))
    return at, found[at] + np.uint64(width), text[at]


def _window_rows(keys: Sequence[T.StructField], widths: Sequence[int], bitmap, whole: bool):
    """A mapInArrow function: canonical windows, and those of the words as they stand, with
    keys, position and slots. ``whole`` takes a text that is shorter than the widest window as
    one window."""
    names = ["hash", *(k.name for k in keys), "at", "width", "n_words", "slots"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = None if bitmap is None else bitmap.value
        for batch in slices(batches):
            words, slots, value, title, first = canonical(*joined(batch.column("text")))
            sizes = np.diff(first)
            # capitals that open a sentence as names
            named, filled = words.copy(), slots.copy()
            named[title], filled[title] = _NAME, mixed(value[title])
            titles = np.zeros(len(words) + 1, np.int64)
            np.cumsum(title, out=titles[1:])
            forms = [(words, slots), (mixed(value ^ _AS_IS), np.zeros_like(slots)), (named, filled)]
            for width, (kind, form) in product(widths, enumerate(forms)):
                if width < SHORTEST and kind != 1:
                    continue
                words, slots = form
                at, hashes, text = _windows_of(words, slots, first, width)
                keep = np.ones(len(at), bool)
                if kind == 2:  # without such a word the windows are those of the first form
                    keep = titles[at + width] > titles[at]
                if whole and width < max(widths) or width < SHORTEST_INSIDE:
                    keep &= sizes[text] == width
                if not whole:
                    low = (hashes & np.uint64(2**BITMAP_BITS - 1)).astype(np.int64)
                    keep &= (passing[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) > 0
                at, hashes, text = at[keep], hashes[keep], text[keep]
                if len(at) == 0:
                    continue
                values = slots[at[:, None] + np.arange(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(hashes)), *(batch.column(k.name).take(pa.array(text)) for k in keys),
                     pa.array(at - first[text]), pa.array(np.full(len(at), width, np.int64)),
                     pa.array(sizes[text].astype(np.int64)),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(signed(values.ravel()))
                     )],
                    names=names,
                )

    schema = T.StructType(
        [T.StructField("hash", T.LongType()), *keys, *(T.StructField(n, T.LongType()) for n in ("at", "width", "n_words")),
         T.StructField("slots", T.ArrayType(T.LongType()))]
    )
    return rows, schema


def _bitmap(found: DataFrame) -> np.ndarray:
    """The low bits of the windows' hashes as a bitmap of fixed size."""
    low = F.col("hash").bitwiseAND(2**BITMAP_BITS - 1)
    words = found.groupBy(F.shiftright(low, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST((hash & {2**BITMAP_BITS - 1}) & 63 AS INT))")).alias("bits")
    )
    bitmap = np.zeros(2 ** (BITMAP_BITS - 6), np.uint64)
    for word, bits in words.collect():
        bitmap[word] = np.uint64(bits & (2**64 - 1))
    return bitmap


_OF_BEST = ["covered_words", "item_words", "consistent", "n_slots", "n_changed"]


def _copy(text) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(text)


def _best() -> Column:
    """The best of some alignments."""
    return F.max(
        F.struct("covered_words", "consistent", (-F.col("n_changed")).alias("same"), "n_slots", "n_changed", "item_words")
    ).alias("best")


def _by_text(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, covered: int = COVERED) -> DataFrame:
    """One row per different text of a doc_id and item found in it."""
    spark = docs.sparkSession
    widths = list(range(1, WIDTH + 1))
    rows, schema = _window_rows([benchmark.schema["item_id"]], widths, None, whole=True)
    items = scratch.table(benchmark.select("item_id", "text").mapInArrow(rows, schema), "items")
    used = sorted(r["width"] for r in items.select("width").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    keys = [docs.schema["doc_id"], T.StructField("copy", T.LongType())]
    rows, schema = _window_rows(keys, used or [WIDTH], bitmap, whole=False)
    found = docs.select("doc_id", "text", _copy("text").alias("copy")).mapInArrow(rows, schema)
    key = ["doc_id", "copy", "item_id", "shift"]
    hits = scratch.table(
        found.select("hash", "doc_id", "copy", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
        .join(items, "hash")
        .select(
            "doc_id", "copy", "item_id", (F.col("doc_at") - F.col("at")).alias("shift"), "at", "width", "n_words",
            F.filter(
                F.arrays_zip(
                    F.transform("slots", lambda v, i: F.col("at") + i).alias("place"),
                    F.col("slots").alias("item_value"), F.col("doc_slots").alias("doc_value"),
                ),
                lambda z: z["item_value"] != 0,
            ).alias("slots"),
        )
        .distinct(),
        "hits",
    )
    slots = hits.select(*key, F.inline("slots")).distinct()
    per_value = slots.groupBy(*key, "item_value").agg(
        (F.min("doc_value") == F.max("doc_value")).alias("one"), F.count("*").alias("n"),
        F.sum(F.when(F.col("item_value") != F.col("doc_value"), 1).otherwise(0)).alias("changed"),
    )
    filled = per_value.groupBy(*key).agg(
        F.min("one").alias("consistent"), F.sum("n").alias("n_slots"), F.sum("changed").alias("n_changed")
    )
    # places of windows are bounded by the length of an item
    places = hits.groupBy(*key).agg(
        F.first("n_words").alias("item_words"),
        F.collect_set(F.struct("at", "width")).alias("all"),
        F.collect_set(F.when(F.size("slots") == 0, F.struct("at", "width"))).alias("literal"),
    )

    def words_in(ranges):
        ordered = F.sort_array(ranges)
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(
            ordered, start,
            lambda acc, r: F.struct(
                (acc["total"] + F.greatest(r["at"] + r["width"] - F.greatest(acc["end"], r["at"]), F.lit(0))).alias("total"),
                F.greatest(acc["end"], r["at"] + r["width"]).alias("end"),
            ),
        )["total"]

    same = [places[k].eqNullSafe(filled[k]) for k in key]
    judged = places.join(filled, reduce(Column.__and__, same), "left").select(
        *[places[k] for k in key], "item_words",
        F.coalesce("consistent", F.lit(True)).alias("consistent"),
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
        F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"),
        F.when(F.coalesce("consistent", F.lit(True)), words_in("all")).otherwise(words_in("literal")).alias("covered_words"),
    )
    return (
        judged.where(F.col("covered_words") >= F.least(F.lit(covered), F.ceil(F.col("item_words") * SHARE)))
        .groupBy("doc_id", "copy", "item_id").agg(_best())
        .select("doc_id", "copy", "item_id", *[F.col(f"best.{c}") for c in _OF_BEST])
    )


def matches(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, covered: int = COVERED) -> DataFrame:
    """One row per doc_id and item found in one of its texts, with the words covered on the
    best alignment, the number of slots there and how many of them have another value."""
    scratch = scratch or Scratch(docs.sparkSession)
    return (
        _by_text(docs, benchmark, scratch, covered).groupBy("doc_id", "item_id").agg(_best())
        .select("doc_id", "item_id", *[F.col(f"best.{c}") for c in _OF_BEST])
    )


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The documents in which no item was found."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(_by_text(docs, benchmark, scratch).select("doc_id", "copy").distinct(), "found")
    # the keys are named apart, so that a column of any name in the documents stays unambiguous
    marked = found.toDF("_found_id", "_found_copy")
    same = docs["doc_id"].eqNullSafe(marked["_found_id"]) & (_copy(docs["text"]) == marked["_found_copy"])
    return docs.join(marked, same, "left_anti")
