"""Archives, chat logs and the pipeline on small tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from helpers import documents, empty, prose

from palestra.llm import archives, chats, ngram_join
from palestra.llm.scratch import Scratch

PAGES = "page_id long, url string, html string"


def pages(spark, data):
    return spark.createDataFrame(data, PAGES).selectExpr("*", "'x' AS date", "1 AS path")


def test_archives_keep_payloads_and_find_revisits(spark):
    rng = random.Random(4)
    bodies = [None, "", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "a\n\nb", "x" * 200_000, *(prose(k, 30) for k in range(5))]
    data = [(k, rng.choice([None, "http://a b/ü\n?q", f"http://h/{k}"]), rng.choice(bodies)) for k in range(90)]
    data += [(None, "http://n/", bodies[5]), (7, "http://again/", data[7][2])]
    found = archives.converted(pages(spark, data)).collect()
    assert len(found) == len(data)
    plain = Counter((k, len((h or "").encode()), archives.digest_of((h or "").encode())) for k, _, h in data)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found) == plain
    first = {}
    for key, _, digest in plain:
        if key is not None:
            first[digest] = min(first.get(digest, 10**9), key)
    responses = Counter(r["payload_digest"] for r in found if r["record_type"] == "response")
    assert set(responses.values()) == {1} and set(responses) == {d for _, _, d in plain}
    for r in found:
        if r["record_type"] == "response":
            assert r["page_id"] == first[r["payload_digest"]] and r["refers_to"] is None
        else:
            assert r["refers_to"] == first[r["payload_digest"]]


def test_no_pages_make_no_records(spark):
    assert archives.converted(pages(spark, [])).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_each_version(spark, version):
    scratch = Scratch(spark)
    path = scratch.path("arc")
    archives.write_arc(pages(spark, [(k, f"http://h/{k}", prose(k, 9)) for k in range(7)]).coalesce(1), path,
                       versions=(version,), per_archive=3)
    contents = [r["content"] for r in archives._archives(spark, path).collect()]
    records = [r for c in contents for r in archives.arc_records(bytes(c))]
    assert len(contents) == 4 and len(records) == 7 and {r.version for r in records} == {version}
    assert sorted(r.payload.decode() for r in records) == sorted(prose(k, 9) for k in range(7))
    if version == 2:
        assert all(archives.digest_of(r.payload) == r.fields["Checksum"] for r in records)


def test_archives_end_at_a_number_of_bytes(spark):
    """Long pages beside short ones, in their order; one longer than the bound stands alone."""
    sizes = [300, 40_000, 5, 70_000, 30_000, 30_000, 30_000, 250_000, 9, 0, 90_000]
    data = [(k, f"http://h/{k}", "é" * (n // 2) + str(k)) for k, n in enumerate(sizes)]
    scratch = Scratch(spark)
    arc, warc = scratch.path("arc"), scratch.path("warc")
    archives.write_arc(pages(spark, data).coalesce(1), arc, bytes_per_archive=100_000)
    stored = archives._archives(spark, arc)
    found = [[int(r.http_header("X-Page-Id")) for r in archives.arc_records(bytes(c["content"]))] for c in stored.collect()]
    assert sorted(found) == [[0, 1, 2], [3], [4, 5, 6], [7], [8, 9, 10]]
    archives.write_warc(stored, archives.revisits(archives.arc_index(stored)), warc, bytes_per_archive=100_000)
    # records of several ARC archives share a WARC archive while they fit
    lengths = [sum(len(b) for h, b in archives.warc_records(bytes(c["content"])) if h["WARC-Type"] != "warcinfo")
               for c in archives._archives(spark, warc).collect()]
    assert sum(n > 101_000 for n in lengths) == 1 and len(lengths) < len(sizes)
    assert {(r["page_id"], r["payload_bytes"]) for r in archives.read_warc(spark, warc).collect()} == {
        (k, len(t.encode())) for k, _, t in data}


def test_broken_archives_are_refused():
    good = archives._arc_start(1, "a.arc", "20240101000000") + "\nhttp://h/ 0.0.0.0 20240101000000 text/html 5\nab"
    with pytest.raises(ValueError, match="declared length"):
        list(archives.arc_records(good.encode()))
    wrong = archives._arc_start(2, "a.arc", "20240101000000") + "\nhttp://h/ 0.0.0.0 20240101000000 text/html 2\nab"
    with pytest.raises(ValueError, match="does not fit version 2"):
        list(archives.arc_records(wrong.encode()))


def chat(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' AS position", "1 AS block")


def test_snapshots_collapse_into_the_longest(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    data = [(1, talk[:2]), (2, talk), (3, talk), (4, talk[:1]), (5, [("user", "a"), ("assistant", "x")]),
            (6, [("user", None), (None, "b")]), (None, [("user", "n")]), (7, [("user", "ab")])]
    rows = [(c, k, role, text) for c, turns in data for k, (role, text) in enumerate(turns)]
    rows += [(8, None, "user", "late"), (8, 0, "user", "late"), (8, 0, "user", "late")]
    found = chats.rendered(chat(spark, rows)).collect()
    assert {r["conv_id"] for r in found} == {2, 5, 6, None, 7, 8}
    texts = {c: "".join(r["rendered"] for r in sorted((r for r in found if r["conv_id"] == c), key=lambda r: r["position"])) for c in (2, 8)}
    assert texts[2] == "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in talk)
    assert texts[8].count("late") == 3
    assert chats.rendered(chat(spark, [])).count() == 0


def test_blocks_do_not_change_the_hashes(spark):
    rows = [(c, k, "user", f"{k % 7}") for c in (1, 2) for k in range(40 if c == 1 else 25)]
    small, large = (chats.hashed_turns(chat(spark, rows), block).select("conv_id", "position", "hash1", "hash2").collect() for block in (4, 1024))
    assert sorted(small) == sorted(large)
    assert {r["conv_id"] for r in chats.rendered(chat(spark, rows)).collect()} == {1}


def test_a_conversation_with_a_third_of_all_rows_is_cut_by_ranges(spark):
    """Rows without id that share few turn numbers: the same positions, and no group much larger
    than a range."""
    rows = [(None, k % 3 if k % 5 else None, f"r{k % 2}", f"{k % 40}") for k in range(3000)]
    rows += [(c, k, "user", f"{c % 9} {k}") for c in range(600) for k in range(10)]
    given = chat(spark, rows)
    plain = chats.hashed_turns(given, 1 << 20).select("conv_id", "position", "role", "text", "hash1", "hash2").collect()
    cut = chats.hashed_turns(given, 64).select("conv_id", "position", "role", "text", "hash1", "hash2").collect()
    assert sorted(plain, key=repr) == sorted(cut, key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    keyed = given.selectExpr("conv_id", "turn", "role", "text", "if(conv_id IS NULL, 'none', concat('c', conv_id)) AS conv_key",
                             "coalesce(turn div 64, -1) AS block")
    largest = chats.in_blocks(keyed, 64, Scratch(spark)).groupBy("conv_key", "block").count().agg({"count": "max"}).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert largest <= 3 * 3000 / 16


def test_paths_become_one_component(spark):
    n = 500
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n + 5, n + 6), (n + 6, n + 6)], "a long, b long")
    roots = {r["node"]: r["root"] for r in ngram_join.connected(edges, Scratch(spark)).collect()}
    assert len({roots[k] for k in range(n + 1)}) == 1 and roots[n + 5] == roots[n + 6] != roots[0]


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    benchmark = prose(900, 40)
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    data = [(k, prose(k, 80), "en", "web", None) for k in range(150)]
    data += [(200, prose(3, 80), "en", "web", None), (201, prose(999, 50) + " " + benchmark, "en", "web", None),
             (202, prose(998, 60) + " token = 0123456789abcdef0123456789abcdef", "en", "web", None),
             (203, "###%%% " * 50, "en", "web", None), (204, None, None, None, None)]
    docs = documents(spark, data)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    everything = {k for k, *_ in data}
    assert kept == [everything - {203, 204}, everything - {203, 204, 200}, everything - {203, 204, 200, 201}, everything - {203, 204, 200, 201}]
    assert "[assign]" in docs.where("doc_id = 202").first()["text"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r[0] for r in pieces.select("doc_id").collect()} == kept[-1]


def test_pipeline_of_nothing(spark, tmp_path):
    empty(spark).drop("a.b").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
