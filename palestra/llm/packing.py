"""Documents packed into training sequences of a fixed capacity, by bulk best-fit.

Method: bulk-synchronous best-fit. All pieces of one length are interchangeable, so the
sorted documents are ranges ``(length, first rank, count)`` and the sorted gaps are ranges
``(size, first sequence, count)``; both are few however many documents there are, because
lengths end at the capacity. In each round, ranges of sizes go to different tasks, which
sweep from the largest document to its next larger gap, settle conflicts by rank, and
report placements and what is left over. Documents without a gap in their range move to the
next one, those without any open sequences; gaps are updated; and the rounds go on until no
document is left. Then each piece finds its place by its length and rank in one join.

Ranks are counted per length and salt, so a length that a third of all pieces have is no
hot group, and only lengths and keys are shuffled.

Ids are those of the tokenizer's JSON beside the ranks file, without special tokens put
around a text. The added tokens that it lists are found inside texts, as its library does.

Defined results: a null or empty text is the end token alone; repeated rows and null ids
are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import slices
from palestra.llm.scratch import Scratch

CAPACITY = 1024
END_TOKEN = 2
# Sizes per task of a sweep.
SWEEP_WIDTH = 128
ROWS_PER_RANKING = 10_000
# Placements are few; beyond this they are joined by shuffle.
BROADCAST_ROWS = 100_000

_encoders: dict[str, tuple] = {}


def _added_tokens(ranks_file: str) -> dict[str, int]:
    """The added tokens of the vocabulary, from its JSON; none if there is no JSON."""
    listed = Path(ranks_file).with_suffix(".json")
    if not listed.exists():
        return {}
    found = json.loads(listed.read_text(encoding="utf-8")).get("added_tokens") or []
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} does not stand for its text alone")
    return {token["content"]: token["id"] for token in found}


def _encoder(ranks_file: str):
    """Encoders of the vocabulary for texts without and with neighbouring white space, and its
    added tokens. Without white space side by side, the usual pattern needs no look-ahead,
    which makes splitting much faster."""
    if ranks_file not in _encoders:
        import tiktoken

        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        tail = (r"|\s", r"|\s+(?!\S)|\s+")
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        plain, full = (
            tiktoken.Encoding("bpe", pat_str=split + end, mergeable_ranks=ranks, special_tokens={}) for end in tail
        )
        added = _added_tokens(ranks_file)
        # the longest first, and nothing at all if there are none
        marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")" if added else r"((?!))")
        _encoders[ranks_file] = plain, full, re.compile(r"\s\s"), marks, added
    return _encoders[ranks_file]


def token_ids(text: str | None, ranks_file: str) -> np.ndarray:
    """The ids of a text, with the end token."""
    plain, full, spaces, marks, added = _encoder(ranks_file)
    found = []
    for k, part in enumerate(marks.split(text or "")):
        if k % 2:
            found.append(added[part])
        else:
            found += (full if spaces.search(part) else plain).encode_ordinary(part)
    found.append(END_TOKEN)
    return np.array(found, "<u4")


def pieces(docs: DataFrame, ranks_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's tokens, cut so that all pieces but the first are full. ``with_ids`` adds
    the ids themselves."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
         T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, number, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = token_ids(text, ranks_file)
                cuts = [0, *range(len(found) % capacity or capacity, len(found), capacity), len(found)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(row)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(found[a:b].tobytes()))
                    if with_ids:
                        ids.append(found[a:b].astype(np.int64))
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            columns += [pa.array(ids, pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def ranked(found: DataFrame, rows: int, per_ranking: int = ROWS_PER_RANKING) -> DataFrame:
    """Pieces with their rank among those of the same length, from 0. A length is split by
    salt; counts per salt give each one its first rank."""
    salts = max(1, -(-rows // per_ranking))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own))
    return numbered.join(firsts, ["length", "salt"]).select(
        *found.columns, (F.col("first") + F.col("own") - 1).alias("rank")
    )


_STATE = "kind string, at long, size long, first long, n long"
_FOUND = "kind string, size long, first long, n long, sequence long, per long, gap long"


def _sweep(state: pd.DataFrame) -> pd.DataFrame:
    """One range of sizes in one round: each document range, the largest first, goes to the
    smallest gaps that hold it, as many to a gap as fit."""
    gaps = state[state["kind"] == "gap"].sort_values(["size", "first"])
    gaps = [[int(g), int(b), int(n)] for g, b, n in zip(gaps["size"], gaps["first"], gaps["n"])]
    docs = state[state["kind"] == "doc"].sort_values(["size", "first"], ascending=[False, True])
    out = []
    for size, rank, n in zip(docs["size"].tolist(), docs["first"].tolist(), docs["n"].tolist()):
        for gap in gaps:
            if n and gap[2] and gap[0] >= size:
                per = gap[0] // size
                for take, used in ((per, min(gap[2], n // per)), (n % per, 1)):
                    if take and used and gap[2] >= used and n >= take * used and (take == per or n < per):
                        out.append(("placed", size, rank, take * used, gap[1], take, gap[0]))
                        rank, n = rank + take * used, n - take * used
                        gap[1], gap[2] = gap[1] + used, gap[2] - used
        if n:
            out.append(("doc", size, rank, n, 0, 0, 0))
    out += [("gap", g, b, n, 0, 0, 0) for g, b, n in gaps if n]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])


def _opened(lacking: list[list[int]], capacity: int, sequence: int) -> tuple[list, int]:
    """Placements in new sequences for document ranges that no gap holds: all that are larger
    than half the capacity, or else the largest, until the others could fit in whole."""
    large = [d for d in lacking if 2 * d[0] > capacity]
    total = sum(size * n for size, _, n in lacking)
    budget = sum(d[2] for d in large) or -(-total // capacity)
    placed = []
    for size, rank, n in sorted(large or lacking, reverse=True):
        per = capacity // size
        for take, used in ((per, min(budget, n // per)), (n % per, 1)):
            if take and used and budget >= used and n >= take * used and (take == per or n < per):
                placed.append((size, rank, take * used, sequence, take, capacity))
                rank, n, sequence, budget = rank + take * used, n - take * used, sequence + used, budget - used
    return placed, sequence


def placements(counts: DataFrame, capacity: int = CAPACITY, width: int = SWEEP_WIDTH) -> list[tuple]:
    """Where the ranges go: ``(length, first rank, count, first sequence, per sequence, gap)``.
    ``counts`` has a row per length. The driver holds ranges only, never documents."""
    spark = counts.sparkSession
    docs = [[r["length"], 0, r["n"], r["length"]] for r in counts.collect()]  # size, rank, n, sweep at
    gaps: list[list[int]] = []  # size, first sequence, n
    found, sequence = [], 0
    while docs:
        sizes = sorted({g for g, _, _ in gaps})
        state = [("doc", at, s, r, n) for s, r, n, at in docs] + [("gap", g, g, b, n) for g, b, n in gaps]
        placed, left, gaps = [], [], []
        if sizes:
            rows = spark.createDataFrame(pd.DataFrame(state, columns=["kind", "at", "size", "first", "n"]), _STATE)
            swept = rows.groupBy((F.col("at") / width).cast("long").alias("range")).applyInPandas(_sweep, _FOUND)
            for kind, size, first, n, seq, per, gap in swept.collect():
                if kind == "placed":
                    placed.append((size, first, n, seq, per, gap))
                else:
                    (left if kind == "doc" else gaps).append([size, first, n])
        else:
            left = [d[:3] for d in docs]
        reached = {(s, r + n): at for s, r, n, at in docs}  # the end of a range stays its own
        docs, lacking = [], []
        for size, rank, n in left:
            at = reached[size, rank + n] if sizes else size
            later = [g for g in sizes if g // width > at // width]
            docs.append([size, rank, n, later[0] if later else size])
            if not later:
                lacking.append([size, rank, n])
        opened, sequence = _opened(lacking, capacity, sequence) if lacking else ([], sequence)
        ends = {(size, rank): n for size, rank, n, _, _, _ in opened}
        for d in docs:
            while (d[0], d[1]) in ends:
                step = ends.pop((d[0], d[1]))
                d[1], d[2] = d[1] + step, d[2] - step
        docs = [d for d in docs if d[2]]
        for size, _, n, seq, per, gap in placed + opened:
            if gap > per * size:
                gaps.append([gap - per * size, seq, n // per])
        found += placed + opened
    return found


def packed(found: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, which are stored already, with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counts = found.groupBy("length").agg(F.count("*").alias("n"))
    places = placements(counts, capacity)
    schema = "p_length long, p_first long, p_n long, p_sequence long, p_per long, p_gap long"
    table = spark.createDataFrame(pd.DataFrame(places, columns=[c.split()[0] for c in schema.split(", ")]), schema)
    if len(places) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    numbered = ranked(found, found.count())
    inside = (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_first") + F.col("p_n"))
    step = F.col("rank") - F.col("p_first")
    return numbered.join(table, (F.col("length") == F.col("p_length")) & inside).select(
        *found.columns,
        (F.col("p_sequence") + F.floor(step / F.col("p_per"))).cast("long").alias("sequence_id"),
        (F.lit(capacity) - F.col("p_gap") + step % F.col("p_per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, ranks_file: str, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(docs.sparkSession)
    return packed(scratch.table(pieces(docs, ranks_file, capacity), "pieces"), scratch, capacity)


def sequences(docs: DataFrame, ranks_file: str, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """The training sequences themselves: ids in order, and whose they are. A group has at most
    ``capacity`` ids."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(pieces(docs, ranks_file, capacity, with_ids=True), "pieces")
    part = F.struct("offset", "doc_id", "piece", "ids")
    rows = packed(found, scratch, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
