"""Quality rules with thresholds that follow each language and source.

Method: the integer measures of all documents go into histograms per language and
source, whose bins are two leading digits wide. Such sketches merge by adding their
counts, so they are pre-aggregated before the shuffle and a hot source is no hot task.
Quantiles read from the sketches give the fences of each group, and a join brings the
fences to the documents. Repeats are rare, so that their quartiles are zero nearly everywhere;
their fences start from a high quantile. DataFrame functions only.

Defined results: a null text has no words and fails; null languages and sources form
groups of their own, named by the empty text; repeated rows count and are judged each;
an empty table gives an empty result; columns beside the documents' own are dropped
from the measures and kept by ``filtered``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palestra.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Fence:
    """A measure is out of line beyond its group's quartile by ``spreads`` times the
    distance of the quartiles plus ``slack``. ``lower`` adds the same on the low side. ``tail``
    takes the 95th percentile and the median in place of the quartiles."""

    measure: str
    slack: int
    spreads: int = 3
    lower: bool = False
    tail: bool = False


# permille of words, permille of lines, tenths of a character, permille of words
FENCES = (
    Fence("symbol_rate", 300),
    Fence("dup_line_rate", 100, tail=True),
    Fence("word_length", 20, lower=True),
    Fence("repeat_rate", 50, tail=True),
)
# Groups with fewer documents are judged by the merged sketch of their language, and
# languages with fewer by the one of all documents.
LEAST_GROUP = 100
# in percent
QUANTILES = (25, 50, 75, 95)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """The hash of each run of five words."""
    of_five = lambda h: F.slice(
        F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])),
        1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)),
    )
    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_five)


# Up to so many different repeated windows are looked up one by one, more by sorting.
_FEW = 16


def _repeated_words(h: Column) -> Column:
    """Words in windows that occur at least twice in the text, from the windows' hashes."""

    def places(again: Column) -> Column:
        few = F.filter(
            F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)),
            lambda i: i.isNotNull(),
        )
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        many = F.sort_array(_let(numbered, lambda s: F.transform(F.filter(s, lambda e, i: same(s, e, i)), lambda e: e["i"])))
        return F.when(F.size(again) <= _FEW, few).otherwise(many)

    def same(s: Column, e: Column, i: Column) -> Column:
        beside = [F.coalesce(F.get(s, i + k)["h"] == e["h"], F.lit(False)) for k in (-1, 1)]
        return beside[0] | beside[1]

    def covered(at: Column) -> Column:
        gaps = F.transform(
            at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    again = _let(
        F.sort_array(h),
        lambda s: F.array_distinct(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))
        ),
    )
    found = _let(again, lambda x: _let(places(x), covered))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)


def measured(docs: DataFrame) -> DataFrame:
    """The documents with the base measures and the rates derived from them."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    base = F.struct(
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _windows(w).alias("hashes"))).alias("w"),
        _let(
            lines,
            lambda x: F.struct(
                F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeated")
            ),
        ).alias("l"),
    )
    # generators of one row, so that what uses the measures does not compute them again
    first = docs.select("*", F.inline(F.array(base)).alias("word_chars", "n_symbols", "_w", "_l"))
    repeated = F.struct(_repeated_words(F.col("_w.hashes")).cast("long").alias("n_repeat_words"))
    flat = first.select("*", F.inline(F.array(repeated))).select(
        *[F.col(f"`{c}`") for c in docs.columns], "word_chars", "n_symbols", "n_repeat_words",
        F.col("_w.n").cast("long").alias("n_words"), F.col("_l.n").cast("long").alias("n_lines"),
        F.col("_l.repeated").cast("long").alias("n_dup_lines"),
    )
    per = lambda a, b, by: F.floor(F.col(a) * by / F.greatest(b, F.lit(1))).cast("long")
    return flat.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_rate": per("n_symbols", "n_words", 1000),
            "dup_line_rate": per("n_dup_lines", "n_lines", 1000),
            "word_length": per("word_chars", "n_words", 10),
            "repeat_rate": per("n_repeat_words", "n_words", 1000),
            "lang_key": F.coalesce("lang", F.lit("")),
            "source_key": F.coalesce("source", F.lit("")),
        }
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATES = ["symbol_rate", "dup_line_rate", "word_length", "repeat_rate"]
_ADDED = [*MEASURES, "n_lines", "base_failed", *_RATES, "lang_key", "source_key"]


def bin_of(value: Column) -> Column:
    """Values with their two leading digits kept."""
    found = F.when(value < 100, value)
    for digits in range(1, 17):
        found = found.when(value < 100 * 10**digits, value - value % 10**digits)
    return found.otherwise(value - value % 10**17)


def sketches(measures: DataFrame, fences: Sequence[Fence] = FENCES) -> DataFrame:
    """Counts per language, source, measure and bin, of documents that pass the base rules."""
    return (
        measures.where(~F.col("base_failed"))
        .select(
            "lang_key", "source_key",
            F.explode(
                F.array(*[F.struct(F.lit(f.measure).alias("measure"), bin_of(F.col(f.measure)).alias("bin")) for f in fences])
            ).alias("m"),
        )
        .groupBy("lang_key", "source_key", "m.measure", "m.bin")
        .agg(F.count("*").alias("docs"))
    )


def _merged(sketch: DataFrame, *group: str) -> DataFrame:
    """Quantiles per group and measure from the sketches merged over the rest."""
    counts = sketch.groupBy(*group, "measure", "bin").agg(F.sum("docs").alias("docs"))
    w = Window.partitionBy(*group, "measure")
    ranked = counts.withColumns(
        {
            "below": F.sum("docs").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("docs").over(w),
        }
    )
    quantile = lambda k: F.min(F.when(100 * F.col("below") >= k * F.col("total"), F.col("bin")))
    return ranked.groupBy(*group, "measure").agg(
        *[quantile(k).alias(f"q{k}") for k in QUANTILES], F.max("total").alias("total")
    )


def thresholds(sketch: DataFrame, fences: Sequence[Fence] = FENCES, least: int = LEAST_GROUP) -> DataFrame:
    """Per language and source one row with a low and a high bound for each measure."""
    group = ["lang_key", "source_key"]
    levels = [
        _merged(sketch, *of).withColumnsRenamed({**{f"q{k}": f"{level}{k}" for k in QUANTILES}, "total": f"{level}n"})
        for level, of in (("g", group), ("l", group[:1]), ("a", []))
    ]
    joined = levels[0].join(levels[1], ["lang_key", "measure"]).join(levels[2], ["measure"])
    pick = lambda k: F.when(F.col("gn") >= least, F.col(f"g{k}")).when(
        F.col("ln") >= least, F.col(f"l{k}")
    ).otherwise(F.col(f"a{k}"))
    chosen = joined.select(*group, "measure", *[pick(k).alias(f"q{k}") for k in QUANTILES])
    bounds = []
    for f in fences:
        low, high = (
            F.max(F.when(F.col("measure") == f.measure, F.col(f"q{k}"))) for k in ((50, 95) if f.tail else (25, 75))
        )
        reach = f.spreads * (high - low) + f.slack
        bounds.append((high + reach).alias(f"high_{f.measure}"))
        if f.lower:
            bounds.append((low - reach).alias(f"low_{f.measure}"))
    return chosen.groupBy(*group).agg(*bounds)


def judged(measures: DataFrame, limits: DataFrame, fences: Sequence[Fence] = FENCES) -> DataFrame:
    """The measured documents with ``kept``; a group without limits has no passing document."""
    inside = ~F.col("base_failed")
    for f in fences:
        inside &= F.col(f.measure) <= F.col(f"high_{f.measure}")
        if f.lower:
            inside &= F.col(f.measure) >= F.col(f"low_{f.measure}")
    return measures.join(limits, ["lang_key", "source_key"], "left").withColumn(
        "kept", F.coalesce(inside, F.lit(False))
    )


def verdicts(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``."""
    scratch = scratch or Scratch(docs.sparkSession)
    plain = docs.select("doc_id", "text", "lang", "source")
    measures = scratch.table(measured(plain).drop("text", "lang", "source"), "measures")
    limits = thresholds(sketches(measures))
    return judged(measures, limits).select("doc_id", *MEASURES, "base_failed", "kept")


def filtered(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The kept documents with all their columns. They are stored once with their measures, so
    that no text is measured twice or shuffled."""
    scratch = scratch or Scratch(docs.sparkSession)
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text", "lang", "source"
    )
    stored = scratch.table(measured(packed).drop("text", "lang", "source"), "measured")
    kept = judged(stored, thresholds(sketches(stored))).where("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in names])
