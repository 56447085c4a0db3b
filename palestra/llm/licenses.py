"""Licence notices in documents, by the Dice coefficient over word bigrams.

Method: texts are normalised to lower-case words. Each line, each block of lines, each
sentence and the whole text is compared with the licence templates by the Dice coefficient of
their distinct word bigrams. A coefficient of at least t needs sizes within a factor of
t / (2 - t), which leaves few templates for a passage and none for most passages. Runs of as
many words as a template has are compared with it too, wherever they hold one of its telling
bigrams, so a notice inside a line or over several lines is found; one inside a longer notice
that is found there is part of that. Templates are a bounded parameter; nothing but matches is
shuffled.

Defined results: null and empty texts and passages of one word have no bigrams and match
nothing; rows that repeat a doc_id count as one document, null ids as one too; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERCENT = 80

# fixed values: licence notices in their usual words
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
    "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.",
}

_SPLIT = r"[^\p{L}\p{N}\n]+"


def _bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours; the words are computed once."""
    pairs = F.transform(
        F.array(words),
        lambda found: F.transform(
            F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))),
            lambda w, i: F.concat(w, F.lit(" "), F.get(found, i + 1)),
        ),
    )
    return F.array_distinct(pairs[0])


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"[ \n]+"), lambda w: w != "")


def _telling(bigrams: list[str], percent: int) -> list[str]:
    """Bigrams of a template of which every matching passage has at least one: the longest,
    one more than a match can lack."""
    lacking = len(bigrams) - -(-len(bigrams) * percent // (200 - percent))
    return sorted(bigrams, key=lambda b: (-len(b), b))[: lacking + 1]


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _SPLIT, " ")


def candidates(docs: DataFrame, telling: list[str]) -> DataFrame:
    """The normalised texts that have one of the telling bigrams, also in one line, and raw."""
    raw = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.inline(F.array(F.struct(raw.alias("raw"), _normalised(raw).alias("plain")))))
    one_line = plain.select("*", F.inline(F.array(F.struct(F.regexp_replace("plain", r"[ \n]+", " ").alias("one_line")))))
    return one_line.where(reduce(Column.__or__, [F.col("one_line").contains(b) for b in telling]))


def passages(found: DataFrame) -> DataFrame:
    """The different lines, blocks, sentences and whole texts of the candidates, normalised."""
    sentences = F.transform(
        F.split(F.col("raw"), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(_normalised(s), r"[ \n]+", " ")
    )
    units = F.array_distinct(
        F.concat(F.split(F.col("plain"), "\n"), F.split(F.col("plain"), r"\n ?\n"), F.array("plain"), sentences)
    )
    return found.select("doc_id", F.explode(units).alias("passage"))


def _run_scores(pairs: list[str], bigrams: set[str], telling: set[str], width: int, percent: int) -> dict[int, int]:
    """By first word: the coefficients, if large enough, of the runs of ``width`` bigrams that
    hold a telling one."""
    last = len(pairs) - width
    starts = sorted({s for p, b in enumerate(pairs) if b in telling for s in range(max(0, p - width + 1), min(p, last) + 1)})
    found, inside, common, before = {}, Counter(), 0, None
    for start in starts:
        if before is not None and start == before + 1:
            gone, come = pairs[before], pairs[start + width - 1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
                common -= gone in bigrams
            common += come in bigrams and come not in inside
            inside[come] += 1
        else:
            inside = Counter(pairs[start : start + width])
            common = sum(b in bigrams for b in inside)
        score = 200 * common // (len(bigrams) + len(inside))
        if score >= percent:
            found[start] = score
        before = start
    return found


def _peaks(scores: dict[int, int]) -> Iterator[tuple[list[int], int]]:
    """Of each series of neighbouring starts those with the best coefficient, and that."""
    starts = sorted(scores)
    firsts = [k for k, s in enumerate(starts) if k == 0 or s != starts[k - 1] + 1]
    for a, b in zip(firsts, [*firsts[1:], len(starts)]):
        score = max(scores[s] for s in starts[a:b])
        yield [s for s in starts[a:b] if scores[s] == score], score


def runs_of(found: DataFrame, known: list[tuple[str, list[str], int]], percent: int) -> DataFrame:
    """Per candidate and licence the best coefficient of its runs of words."""
    schema = T.StructType(
        [found.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("dice_percent", T.LongType())]
    )
    # the longest first
    listed = sorted(
        ((n, set(b), set(_telling(b, percent)), words - 1) for n, b, words in known), key=lambda t: (-t[3], t[0])
    )

    def best_of(line: str) -> dict[str, int]:
        words = line.split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        distinct, best, places = set(pairs), {}, []
        for name, bigrams, telling, size in listed:
            width = min(size, len(pairs))
            if len(distinct & bigrams) * (200 - percent) < percent * len(bigrams):
                continue
            scores = _run_scores(pairs, bigrams, telling, width, percent)
            longer = [(a, b) for a, b in places if b - a > width]
            for tops, score in _peaks(scores):
                if not any(a <= s and s + width <= b for a, b in longer for s in tops):
                    best[name] = max(best.get(name, 0), score)
                places += [(s, s + width) for s in tops]
        return best

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, scores = [], [], []
            for row, line in enumerate(batch.column("one_line").to_pylist()):
                for name, score in best_of(line).items():
                    at.append(row)
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(scores, pa.int64())],
                names=schema.names,
            )

    return found.select("doc_id", "one_line").mapInArrow(rows, schema)


def matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per document and licence found in it, with the best coefficient in percent."""
    spark = docs.sparkSession
    plain = spark.createDataFrame(list(templates.items()), "license string, text string").select(
        "license", _words(_normalised(F.col("text"))).alias("words")
    ).select("license", _bigrams(F.col("words")).alias("bigrams"), F.size("words").alias("n_words"))
    known = [(r["license"], r["bigrams"], r["n_words"]) for r in plain.collect() if r["bigrams"]]
    if not known:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0).cast("long").alias("dice_percent")).limit(0)
    least, most = (f(len(b) for _, b, _ in known) for f in (min, max))
    # words are letters and digits, so quotes need no care but in names
    listed = ", ".join(
        "struct('{}' AS license, {} AS n, array({}) AS bigrams)".format(
            n.replace("\\", "").replace("'", "\\'"), len(b), ", ".join(f"'{g}'" for g in b)
        )
        for n, b, _ in known
    )
    table = F.expr(f"array({listed})")
    # sizes a and b fit if 100 * 2 * min(a, b) >= percent * (a + b)
    fits = lambda n, a: 200 * F.least(n, a) >= percent * (n + a)
    spaces = F.length("passage") - F.length(F.translate("passage", " \n", ""))
    # a passage has at most one more word than spaces, and one bigram less than words
    found = candidates(docs, sorted({g for _, b, _ in known for g in _telling(b, percent)}))
    split = passages(found).where(spaces >= percent * least // (200 - percent)).select(
        "doc_id", F.inline(F.array(F.struct(_bigrams(_words(F.col("passage"))).alias("bigrams"))))
    )
    sized = split.where((F.size("bigrams") * (200 - percent) >= percent * least) & (percent * F.size("bigrams") <= (200 - percent) * most))
    scored = F.transform(
        F.filter(table, lambda t: fits(t["n"], F.size("bigrams"))),
        lambda t: F.struct(
            t["license"].alias("license"),
            F.floor(200 * F.size(F.array_intersect("bigrams", t["bigrams"])) / (t["n"] + F.size("bigrams"))).cast("long").alias("dice_percent"),
        ),
    )
    return (
        sized.select("doc_id", F.inline(scored)).where(F.col("dice_percent") >= percent)
        .unionAll(runs_of(found, known, percent))
        .groupBy("doc_id", "license").agg(F.max("dice_percent").alias("dice_percent"))
    )
