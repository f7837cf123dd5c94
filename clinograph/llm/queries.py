"""The queries opN_<name> over the data tables, and their SQL where DuckDB can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, byte_bpe, jpeg_media, ngram_join, packing, quality, sharding, suffix_dedup, token_counts, warc
from .common import read


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: components of documents whose 4-word shingles overlap by 85 %.

    Documents without words have no shingles and are components of their own; copies share theirs.
    """
    return ngram_join.link_components(read(spark, sf_dir, "documents", "doc_id", "text"), n=4, percent=85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, out of the archives.

    A null html is an empty payload; no pages give no rows.
    """
    return warc.archive_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and passage_words.

    Removed are bytes of repeated 400-byte strings; passage_words counts the words in repeated passages of over
    fifty words, which are often shorter than that.  Null and empty texts lose nothing.
    """
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), 400, passage_words=51)


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: 24 shards of near equal bytes.

    Equal texts stand together unless a group is larger than a shard; null texts have 8 bytes.
    """
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents", "doc_id", "text"), 24)


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, empty and null texts included."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and what is read back of the JPEG that holds a document's bytes; null texts are empty payloads."""
    return jpeg_media.media_features(jpeg_media.store_media(read(spark, sf_dir, "documents", "doc_id", "text")))


def op7_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best rows of every row whose id 20 divides.

    Vectors that are null or not finite throughout take no part.
    """
    return bitsliced.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=20, every=20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; a null text has none."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text is empty."""
    return byte_bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document without text is its end id alone.
    """
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_histogram_shards": op4_histogram_shards,
    "op5_quality_trees": op5_quality_trees,
    "op6_jpeg_media": op6_jpeg_media,
    "op7_bitsliced_topk": op7_bitsliced_topk,
    "op8_token_counts": op8_token_counts,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op7_bitsliced_topk": """
        WITH good AS (
          SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
          FROM good q JOIN good r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
