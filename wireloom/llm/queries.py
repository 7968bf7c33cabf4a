"""The registered queries of this package: whole tables in, digests out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.llm import (
    ball_tree,
    conversations,
    embeddings,
    language,
    minhash,
    mixing,
    pieces,
    pii,
    prefix_trie,
    quality,
    token_files,
    url_rules,
    warc,
)
from wireloom.sources.staging import staging_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in base])


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_rules.RULES), "rule string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = conversations.link(_table(spark, sf_dir, "conversations"))
    body = F.coalesce("body", F.lit(""))
    return linked.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "reply_to",
        F.col("root").alias("root_turn"),
        "depth",
        F.length(body).cast("bigint").alias("body_chars"),
        F.sha2(body.cast("binary"), 256).alias("body_sha256"),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return judged.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return found.select("doc_id", *[F.col(f"pii.{c}").alias(c) for c in names])


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, of them byte pieces, a digest of the ids, and
    whether decoding gives the text back."""
    table = pieces.load()
    decoded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), table))
    by_byte = F.filter("ids", lambda i: i.isin(table.bytes_ids))
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"),
        F.coalesce(F.size(by_byte), F.lit(0)).cast("bigint").alias("n_byte_pieces"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_packages(warc.write_packages(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(_table(spark, sf_dir, "documents"))
    return language.identify(_table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)
    return judged.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    rows = token_files.read(spark, path)
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", token_files.checksum(F.col("ids")).alias("ids_crc32"))


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_files": op12_token_files,
    "op13_ball_tree_search": op13_ball_tree_search,
}
SQL: dict[str, str] = {
    "op2_url_filters": """
        WITH rest AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages
        ), parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1), '') AS path
            FROM rest
        ), judged AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    "op8_warc": """
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        firsts AS (SELECT payload, min(page_id) AS first_id FROM hashed GROUP BY payload)
        SELECT page_id, strlen(payload) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4)))::INTEGER & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM hashed JOIN firsts USING (payload)
    """,
    "op11_prefix_trie": """
        WITH crc_table AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS of_byte
        ), own AS (
            SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT own.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT)),
                lambda s, b: xor(s // 256, of_byte[xor(s % 256, b) + 1])), 4294967295) % 6 AS h
            FROM own, crc_table
        ), rebuilt AS (
            SELECT a.c, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns
            FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 100
        ), beginnings AS (
            SELECT c, d, list_slice(turns, 1, d) AS node, d = len(turns) AS ends, coalesce(length(turns[d].text), 0) AS chars
            FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM beginnings GROUP BY node, d
        ), linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = list_slice(n.node, 1, n.d - 1)
        ), children AS (
            SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
        ), below AS (
            SELECT list_slice(node, 1, up) AS node, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
            FROM (SELECT n.*, c.n_children, unnest(range(n.d + 1)) AS up FROM nodes n LEFT JOIN children c USING (node)) GROUP BY ALL
        )
        SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
               saved::BIGINT AS saved_tokens, ends_sha256
        FROM linked LEFT JOIN children USING (node) JOIN below USING (node)
    """,
    "op13_ball_tree_search": r"""
        WITH found AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), tf AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
        corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus
            WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL
        ), ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 50
    """,
}
