"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palestra.llm import (
    alignment, archives, chats, contamination, licenses, ngram_join, packing, periods, phrases, quality, secret_scan,
    suffixes, wrappers,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, benchmark = _table("documents"), _table("pages"), _table("benchmark")
conversations = _table("conversations")


def vocabulary() -> str:
    """The ranks of the byte-level vocabulary; any machine of the cluster has the file there."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_model() -> str:
    """The model of the second tokenizer; any machine of the cluster has the file there."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.converted(pages(spark, sf_dir)).drop("url", "date")


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.pack(documents(s, d), vocabulary()),
        "op2_license_scans": lambda s, d: licenses.matches(documents(s, d)),
        "op3_warc": warc,
        "op4_decontamination": lambda s, d: contamination.matches(documents(s, d), benchmark(s, d)),
        "op5_ngram_jaccard_join": lambda s, d: ngram_join.components_of(documents(s, d)),
        "op6_substring_dedup": lambda s, d: phrases.digests(documents(s, d)),
        "op7_secret_scans": lambda s, d: secret_scan.scan(documents(s, d)),
        "op8_quality_rules": lambda s, d: quality.verdicts(documents(s, d)),
        "op9_suffix_array_dedup": lambda s, d: suffixes.digests(documents(s, d)),
        "op10_chat_formatting": lambda s, d: chats.rendered(conversations(s, d)),
        "op11_cross_tokenizer_alignment": lambda s, d: alignment.scored(documents(s, d), vocabulary(), pieces_model()),
        "op12_html_extraction": lambda s, d: wrappers.main_texts(pages(s, d)),
        "op13_periodic_run_detection": lambda s, d: periods.digests(documents(s, d)),
    }


# Base32 of the digest: five hexadecimal digits make four letters.
_WARC = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages
), named AS (
    SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER)
                   >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1, 1)), 'string_agg', '') AS payload_digest
    FROM hashed
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM named
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


_CHATS = """
WITH placed AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1
               AS position,
           count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM conversations
), so_far AS (
    SELECT *, md5(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY conv_id ORDER BY position)) AS seen
    FROM placed
), ends AS (
    SELECT min(conv_id) AS conv_id, position, seen FROM so_far WHERE position = n_turns - 1 GROUP BY position, seen
), kept AS (
    SELECT conv_id FROM ends
    WHERE NOT EXISTS (SELECT 1 FROM so_far s
                      WHERE s.position = ends.position AND s.seen = ends.seen AND s.n_turns > s.position + 1)
)
SELECT conv_id, position, n_turns, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
FROM placed WHERE conv_id IN (SELECT conv_id FROM kept)
"""


# The pages of the test tables mark their article, and only headings, paragraphs and inline tags
# are inside.
_MAIN_TEXTS = r"""
WITH block AS (
    SELECT page_id, url, html, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS place
    FROM (SELECT page_id, url, html, string_split_regex(
              regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'),
              '</?(?:h1|p)>') AS blocks FROM pages) AS b
), plain AS (
    SELECT page_id, url, html, place, trim(regexp_replace(regexp_replace(replace(replace(replace(
               regexp_replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'),
               '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block
    FROM block
), joined AS (
    SELECT page_id, url, html,
           coalesce(string_agg(block, chr(10) ORDER BY place) FILTER (block <> ''), '') AS text
    FROM plain GROUP BY page_id, url, html
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""


def _license_sql() -> str:
    rows = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES.items()
    )
    plain = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g')"
    split = r"list_filter(regexp_split_to_array({}, '[ \n]+'), lambda w: w <> '')"
    bigrams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return rf"""
WITH template AS (
    SELECT license, {bigrams} AS bigrams
    FROM (SELECT license, {split.format(plain)} AS words FROM (VALUES {rows}) AS t(license, text)) AS w
), passage AS (
    SELECT DISTINCT doc_id, unnest(list_concat(string_split(plain, chr(10)),
                                               regexp_split_to_array(plain, '\n ?\n'), [plain])) AS passage
    FROM (SELECT doc_id, {plain} AS plain FROM documents) AS p
), split AS (
    SELECT doc_id, {bigrams} AS bigrams
    FROM (SELECT doc_id, {split.format('passage')} AS words FROM passage) AS w
)
SELECT doc_id, license,
       max(CAST(floor(200 * len(list_intersect(s.bigrams, t.bigrams)) / (len(s.bigrams) + len(t.bigrams))) AS BIGINT))
           AS dice_percent
FROM split AS s, template AS t
WHERE 200 * least(len(s.bigrams), len(t.bigrams)) >= {licenses.PERCENT} * (len(s.bigrams) + len(t.bigrams))
  AND 200 * len(list_intersect(s.bigrams, t.bigrams)) >= {licenses.PERCENT} * (len(s.bigrams) + len(t.bigrams))
GROUP BY doc_id, license
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scans": _license_sql(), "op3_warc": _WARC, "op10_chat_formatting": _CHATS, "op12_html_extraction": _MAIN_TEXTS}
