"""Documents linked by the Jaccard similarity of their word shingles, joined exactly.

Method: signature trees. Every set of shingles has a bitmap. The sets that share a shingle
of their prefixes, which is necessary for a link, form a tree: leaves of a few sets of like
size, branches of some leaves, each node with the OR of its bitmaps, its range of sizes and
its labels. Pairs of branches, then pairs of leaves, then pairs of sets are dropped if the
largest possible overlap is too small for a link, by bitmaps, by sizes, and by what is left
of the sets behind the shared shingle, since the first one that two sets share decides. What is left is verified on the full sets.

The prefix of a set is its first shingles in an order that all sets share: shingles seen
often come last, so a passage that many documents share makes no large tree. Equal sets are
one class before anything else. Sets are first compared with the centre of each tree only,
and those linked to it get its label; pairs of one label need no comparison, so a large
group of near copies does not become all its pairs.

Defined results: without words the set is empty, linked with nothing; rows that repeat a
doc_id have one result per row and link as their texts do, their own id included; null ids
are ignored as smallest id and a component of them alone has none; an empty table gives no
rows; extra columns are ignored by ``components_of`` and kept by ``one_of_each``, which judges
each text by itself and leaves one row of each class of equal texts, with or without ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import LOWER, Hasher, joined, mixed, signed, slices, spread, windows, words
from palestra.llm.scratch import Scratch

WIDTH = 5
PERCENT = 75
WORDS_OF_BITMAP = 16  # of 64 bits
LEAF = 32  # sets in a leaf, leaves in a branch
# Shingles that go last in the common order: at most so many, each counted at least so often.
HEAVY, HEAVY_COUNT = 1 << 17, 8
# Shingles that a task counts at a time for that.
COUNTED_AT_ONCE = 1_500_000
# Bits of the filter for the sets that a verification needs.
FILTER_BITS = 22


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each text, and how many each has."""
    data, offsets = joined(column)
    starts, ends, first = words(data, offsets)
    hashes = Hasher(LOWER[data])(starts, ends)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    found = windows(hashes, width)
    n = len(found)
    inside = text[:n] == text[width - 1 : width - 1 + n]
    found, owner = found[inside], text[:n][inside]
    for short in range(1, width):  # fewer words: the whole sequence
        rows = np.flatnonzero(counts == short)
        if len(rows):
            whole = windows(hashes, short)[first[:-1][rows]] + np.uint64(short)
            found, owner = np.concatenate((found, whole)), np.concatenate((owner, rows))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=len(counts))


def _keys(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole set; equal sets have equal keys."""
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mixed(found ^ np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    ends = np.cumsum(sizes)
    return mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))


def _bitmaps(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = 64 * WORDS_OF_BITMAP
    grid = np.zeros((len(sizes), bits), np.uint8)
    grid[np.repeat(np.arange(len(sizes)), sizes), (found % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(grid, axis=1, bitorder="little").view(np.int64)


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    places = np.arange(len(flat) // width + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat))


def described(docs: DataFrame) -> DataFrame:
    """Per document its set's size, key and bitmap, and ``copy`` to tell texts of one doc_id
    apart; an empty set has no key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, sizes = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), pa.array(sizes.astype(np.int64)),
                 pa.array(signed(_keys(found, sizes)), mask=sizes == 0),
                 _lists(_bitmaps(found, sizes).ravel(), WORDS_OF_BITMAP)],
                names=["doc_id", "copy", "n_shingles", "key", "bitmap"],
            )

    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("copy", T.LongType()), T.StructField("n_shingles", T.LongType()),
         T.StructField("key", T.LongType()), T.StructField("bitmap", T.ArrayType(T.LongType()))]
    )
    return docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInArrow(rows, schema)


def heavy_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles seen often, sorted. Each task counts over some texts at a time and reports
    what it saw twice, so the counts are lower bounds; they only fix the common order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(values[often])), pa.array(counts[often])], names=["shingle", "n"]
            )

        for batch in slices(batches):
            kept.append(shingle_sets(batch.column("text"))[0])
            n += len(kept[-1])
            if n > COUNTED_AT_ONCE:
                yield counted()
                kept, n = [], 0
        if kept:
            yield counted()

    counts = docs.select("text").mapInArrow(rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HEAVY_COUNT).orderBy(F.desc("n"), "shingle").limit(HEAVY)
    found = np.array([r["shingle"] for r in top.collect()], np.int64)
    return np.sort(found.view(np.uint64))


def _prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Of two linked sets, both prefixes of this length share a shingle."""
    return np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)


def postings(docs: DataFrame, heavy, percent: int = PERCENT) -> DataFrame:
    """Prefix shingles with the key and size of their set and how much of the set is left from
    there on in the common order, once per task and set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = heavy.value, set()
        for batch in slices(batches):
            found, sizes = shingle_sets(batch.column("text"))
            keys = signed(_keys(found, sizes))
            owner, _ = spread(sizes)
            if len(often):
                last = often[np.minimum(np.searchsorted(often, found), len(often) - 1)] == found
                found = found[np.lexsort((found, last, owner))]
            take = _prefix_length(sizes, percent)
            for row, key in enumerate(keys.tolist()):
                if key in seen:
                    take[row] = 0
                seen.add(key)
            owner, place = spread(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(found[(np.cumsum(sizes) - sizes)[owner] + place])), pa.array(keys[owner]),
                 pa.array(sizes[owner].astype(np.int64)), pa.array((sizes[owner] - place).astype(np.int64))],
                names=["shingle", "key", "n", "reach"],
            )

    return docs.select("text").mapInArrow(rows, "shingle long, key long, n long, reach long")


def _shared(found: DataFrame) -> DataFrame:
    """The postings of shingles that several sets have."""
    same = Window.partitionBy("shingle")
    return (
        found.withColumns({"low": F.min("key").over(same), "high": F.max("key").over(same)})
        .where("low <> high").select("shingle", "key", "n", "reach").distinct()
    )


def _trees(shared: DataFrame) -> DataFrame:
    """The groups of sets that share a shingle, each different group once and named by one
    the first such shingle in the common order as its ``tree``."""
    groups = shared.groupBy("shingle").agg(
        F.count("*").alias("sets"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.sum("reach").alias("left"),
    )
    chosen = groups.groupBy("sets", "x", "y").agg(F.max_by("shingle", F.struct("left", "shingle")).alias("shingle"))
    return shared.join(chosen.select("shingle", "sets"), "shingle").withColumnRenamed("shingle", "tree")


def _overlap_bound(a: str, b: str):
    """The largest overlap of any set of node a with any of node b, from the bitmaps: common
    bits, and the shingles that hide behind a bit that another one set."""
    bits = F.aggregate(
        F.zip_with(f"{a}_bitmap", f"{b}_bitmap", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    return F.least(F.col(f"{a}_reach"), F.col(f"{b}_reach"), bits + F.least(f"{a}_slack", f"{b}_slack"))


def _possible(a: str, b: str, percent: int):
    """Whether two nodes can hold a linked pair of different labels."""
    least = F.ceil((F.col(f"{a}_min") + F.col(f"{b}_min")) * percent / (100 + percent))
    sizes = (F.col(f"{a}_max") * 100 >= F.col(f"{b}_min") * percent) & (
        F.col(f"{b}_max") * 100 >= F.col(f"{a}_min") * percent
    )
    labels = (F.least(f"{a}_low", f"{b}_low")) != (F.greatest(f"{a}_high", f"{b}_high"))
    return sizes & labels & (_overlap_bound(a, b) >= least)


def _node_columns() -> list:
    ors = F.array(*[F.bit_or(F.col("bitmap")[i]) for i in range(WORDS_OF_BITMAP)])
    return [ors.alias("bitmap"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.max("reach").alias("reach"), F.max("slack").alias("slack"), F.min("low").alias("low"), F.max("high").alias("high")]


def tree_pairs(labelled: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of sets that the dual traversal of each tree leaves over. ``labelled`` has tree,
    sets, key, n, reach, label and bitmap."""
    like = F.floor(F.log("n") / math.log(100 / percent)).cast("long")
    leaves = F.ceil(F.col("sets") / LEAF).cast("long")
    bits = F.aggregate("bitmap", F.lit(0).cast("long"), lambda t, w: t + F.bit_count(w))
    members = labelled.withColumns(
        {"like": like, "leaf": F.pmod(F.xxhash64("key"), leaves), "min": F.col("n"), "max": F.col("n"),
         "low": F.col("label"), "high": F.col("label"), "slack": F.col("n") - bits}
    ).withColumn("branch", F.floor(F.col("leaf") / LEAF).cast("long"))
    leaf = members.groupBy("tree", "like", "branch", "leaf").agg(
        *_node_columns(), F.collect_list(F.struct("key", "n", "reach", "label", "slack", "bitmap")).alias("sets")
    )
    branch = leaf.groupBy("tree", "like", "branch").agg(*_node_columns())
    side = lambda df, p: df.select("tree", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "tree"])
    near = (F.col("b_like") - F.col("a_like")).between(0, 1)
    after = lambda *cs: F.struct(*[f"a_{c}" for c in cs]) <= F.struct(*[f"b_{c}" for c in cs])
    branches = (
        side(branch, "a").join(side(branch, "b"), "tree")
        .where(near & after("like", "branch") & _possible("a", "b", percent))
        .select("tree", "a_like", "a_branch", "b_like", "b_branch")
    )
    pairs = (
        branches.join(side(leaf, "a"), ["tree", "a_like", "a_branch"])
        .join(side(leaf, "b"), ["tree", "b_like", "b_branch"])
        .where(after("like", "leaf") & _possible("a", "b", percent))
        .select("a_sets", "b_sets", (F.struct("a_like", "a_leaf") == F.struct("b_like", "b_leaf")).alias("own"))
    )
    return pairs.mapInArrow(_compare_leaves(percent), "a long, b long").distinct()


def _columns_of(sets: pa.Array) -> tuple:
    flat = sets.flatten()
    get = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    bitmap = flat.field("bitmap").flatten().to_numpy().reshape(-1, WORDS_OF_BITMAP)
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
    return get("key"), get("n"), get("label"), get("slack"), bitmap, np.cumsum(sizes) - sizes, sizes, get("reach")


def _possible_pairs(na, nb, ra, rb, sa, sb, ba, bb, percent: int) -> np.ndarray:
    bits = np.bitwise_count(ba & bb).sum(axis=-1).astype(np.int64)
    bound = np.minimum(np.minimum(ra, rb), bits + np.minimum(sa, sb))
    return (100 + percent) * bound >= percent * (na + nb)


def _compare_leaves(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_columns_of(batch.column(c)) for c in ("a_sets", "b_sets"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for row in range(batch.num_rows):
                i, j = np.meshgrid(
                    np.arange(a[5][row], a[5][row] + a[6][row]), np.arange(b[5][row], b[5][row] + b[6][row]), indexing="ij"
                )
                i, j = i.ravel(), j.ravel()
                keep = a[2][i] != b[2][j]
                keep &= (a[0][i] < b[0][j]) if own[row] else (a[0][i] != b[0][j])
                i, j = i[keep], j[keep]
                near = np.minimum(a[7][i], b[7][j]) * (100 + percent) >= percent * (a[1][i] + b[1][j])
                i, j = i[near], j[near]
                keep = _possible_pairs(a[1][i], b[1][j], a[7][i], b[7][j], a[3][i], b[3][j], a[4][i], b[4][j], percent)
                i, j = a[0][i[keep]], b[0][j[keep]]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"]
                    )

    return rows


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that all the keys pass."""
    low = F.col("key").bitwiseAND(2**FILTER_BITS - 1)
    found = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST((key & {2**FILTER_BITS - 1}) & 63 AS INT))")).alias("bits")
    )
    bitmap = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    for word, bits in found.collect():
        bitmap[word] = np.uint64(bits & (2**64 - 1))
    return bitmap


def _full_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The shingles of the wanted sets, once each."""
    passing = docs.sparkSession.sparkContext.broadcast(_filter_of(keys))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            found, sizes = shingle_sets(batch.column("text"))
            keys = signed(_keys(found, sizes))
            low = keys & (2**FILTER_BITS - 1)
            keep = (passing.value[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) > 0
            starts = np.cumsum(sizes) - sizes
            out = []
            for row in np.flatnonzero(keep & (sizes > 0)).tolist():
                if keys[row] not in seen:
                    seen.add(int(keys[row]))
                    out.append((int(keys[row]), found[starts[row] : starts[row] + sizes[row]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())],
                names=["key", "shingles"],
            )

    found = docs.select("text").mapInArrow(rows, "key long, shingles binary")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _by_bitmaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of sets that their own bitmaps do not rule out."""
    bits = F.aggregate("bitmap", F.lit(0).cast("long"), lambda t, w: t + F.bit_count(w))
    side = lambda p: sets.select(
        F.col("key").alias(p), F.col("n").alias(f"{p}_min"), F.col("n").alias(f"{p}_reach"),
        (F.col("n") - bits).alias(f"{p}_slack"), F.col("bitmap").alias(f"{p}_bitmap"),
    )
    least = F.ceil((F.col("a_min") + F.col("b_min")) * percent / (100 + percent))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where((F.least("a_min", "b_min") * 100 >= F.greatest("a_min", "b_min") * percent) & (_overlap_bound("a", "b") >= least)).select("a", "b")
    )


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough. ``pairs`` must be stored."""
    keys = scratch.table(
        pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "keys"
    )
    sets = scratch.table(_full_sets(docs, keys), "sets")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    side = lambda p: sets.select(F.col("key").alias(p), F.col("shingles").alias(f"{p}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    links = scratch.table(both.mapInArrow(rows, "a long, b long"), "links", rows_at_once=200)
    scratch.drop(sets, keys)
    return links


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node of the edges (a, b) with its component's ``root``. In each round every node
    joins its neighbour that is first in a random order of that round, and edges are drawn
    between what was joined; a path shrinks by a constant share in each round."""
    edges = scratch.table(edges.where("a <> b").distinct(), "edges")
    roots = None
    step = 0
    while not edges.isEmpty():
        draw = lambda c: F.xxhash64(c, F.lit(step))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined_to = scratch.table(
            both.groupBy("a").agg(F.min(F.struct(draw("b").alias("h"), F.col("b").alias("to"))).alias("m"))
            .select(F.col("a").alias("node"), F.when(F.col("m.h") < draw("a"), F.col("m.to")).otherwise(F.col("a")).alias("to")),
            "joined",
        )
        move = lambda df, c: df.join(
            joined_to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c, "left"  # noqa: B023
        )
        if roots is None:
            new_roots = joined_to.select("node", F.col("to").alias("root"))
        else:
            new_roots = move(roots, "root").select("node", F.coalesce("root_to", "root").alias("root"))
        a, b = F.col("a_to"), F.col("b_to")
        new_edges = move(move(edges, "a"), "b").where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        old = [edges, joined_to, *([roots] if roots is not None else [])]
        roots = scratch.table(new_roots, "roots")
        edges = scratch.table(new_edges, "edges")
        scratch.drop(*old)
        step += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def linked_sets(docs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Pairs of keys that connect all sets that links connect. ``sets`` has key, n, bitmap."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs))
    shared = scratch.table(_shared(postings(docs, heavy, percent)), "shared")
    trees = scratch.table(_trees(shared), "trees")
    scratch.drop(shared)
    # the centre of a tree: the set whose prefix others share most
    score = trees.groupBy("key").agg((F.sum(F.log2("sets")) / F.sqrt(F.max("n"))).alias("score"))
    scored = trees.join(score, "key")
    centres = scored.groupBy("tree").agg(F.max(F.struct("score", "key", "n", "reach")).alias("c"))
    with_centre = scored.join(centres, "tree").where(
        (F.col("key") != F.col("c.key"))
        & (F.least("reach", "c.reach") * (100 + percent) >= (F.col("n") + F.col("c.n")) * percent)
    )
    spokes = with_centre.select("key", F.col("c.key").alias("centre")).distinct()
    spokes = spokes.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    first = verified(docs, scratch.table(_by_bitmaps(spokes, sets, percent), "spokes"), scratch, percent)
    by_centre = first.select(F.col("a").alias("key"), F.col("b").alias("label")).unionByName(
        first.select(F.col("b").alias("key"), F.col("a").alias("label"))
    )
    # of a linked pair, the one with more links gives its label
    degree = by_centre.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("links"))
    ranked = by_centre.join(degree.withColumnRenamed("key", "label"), "label").withColumnRenamed("links", "label_links").join(degree, "key")
    labels = ranked.groupBy("key").agg(
        F.max(F.struct("label_links", "label")).alias("best"), F.max("links").alias("links")
    ).select(
        "key",
        F.when(
            F.struct(F.col("best.label_links"), F.col("best.label")) > F.struct("links", "key"), F.col("best.label")
        ).otherwise(F.col("key")).alias("label"),
    )
    labelled = trees.join(scratch.table(labels, "labels"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    open_trees = labelled.groupBy("tree").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    rest = labelled.join(open_trees.select("tree"), "tree", "left_semi").join(sets.select("key", "bitmap"), "key")
    rest = scratch.table(rest, "rest")
    pairs = scratch.table(tree_pairs(rest, percent), "pairs", rows_at_once=500)
    scratch.drop(rest, trees)
    # what the first comparison has decided is not decided again
    return first.unionByName(verified(docs, pairs, scratch, percent))


def _placed(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Per document the size of its set and the ``first`` document that links lead to: the one
    with the smallest doc_id, those without any last, and among its texts the smallest copy."""
    known = scratch.table(described(docs), "described")
    sets = scratch.table(
        known.where("key IS NOT NULL").groupBy("key")
        .agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")).alias("first")),
        "classes",
    )
    roots = connected(linked_sets(docs, sets, scratch, percent), scratch)
    in_component = sets.select("key", "first").join(
        roots.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    least = in_component.groupBy("root").agg(F.min("first").alias("first"))
    of_key = in_component.drop("first").join(least, "root").select("key", "first")
    return known.select("doc_id", "copy", "n_shingles", "key").join(of_key, "key", "left").drop("key")


def components_of(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """Per document the size of its set and the smallest doc_id that links lead to."""
    return _placed(docs, percent, scratch or Scratch(docs.sparkSession)).select(
        "doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """The documents, of each component only one row: of the document with the smallest doc_id,
    or of any if none has an id. Documents without words all stay."""
    scratch = scratch or Scratch(docs.sparkSession)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    counted = (
        _placed(docs, percent, scratch).where("n_shingles > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.first(is_first).alias("_stays"), F.count("*").alias("_n"))
    )
    # what does not stay as it is; the keys are named apart from any column of the documents
    touched = scratch.table(counted.where("NOT _stays OR _n > 1"), "touched")
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_copy"])
    kept = docs.join(touched, same(touched), "left_anti")
    repeated = touched.where("_stays").select("_id", "_copy")
    if repeated.isEmpty():
        return kept
    # one row of those that repeat both the id and the text; the rows are cut per task first
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)])
    ones = docs.join(repeated, same(repeated)).groupBy("_id", "_copy").agg(F.first(row).alias("_row"))
    return kept.unionAll(ones.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
