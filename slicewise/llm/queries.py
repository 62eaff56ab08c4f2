"""The registered queries of the operators here, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import TEMPLATE, digest, format_conversations
from . import licenses
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .factorisation import fit_quality, score_quality
from .mixing import mix
from .near_dedup import near_dedup
from .sharding import shard
from .spelling import oracle_sql as spelling_sql
from .spelling import spelling_variants, word_occurrences
from .substrings import remove_shared_passages
from .suffix_dedup import remove_repeats
from .tables import read
from .toxicity import fit_toxicity, score_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), threshold=75)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), threshold=0.6, least=0.75)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")), threshold=0.5)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(narrow, shards=24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"), threshold=0.8)
    starts = F.transform("places", lambda x: x["start"])
    base, blocks = (F.array_distinct(F.transform(c, lambda x: x["label"])) for c in ("places", "blocks"))
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, blocks)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digest(format_conversations(turns.unionByName(probe), TEMPLATE))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_occurrences(read(spark, sf_dir, "documents"), drop_every=199))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = align(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_passages(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_chat_format": op10_chat_format,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_license_scan": licenses.oracle_sql(threshold=0.8),
    "op11_spelling_variants": spelling_sql(),
    "op13_substring_dedup": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ),
        windows AS (
            SELECT r, s, md5(array_to_string(words[s : s + 34], ' ')) AS k FROM docs, unnest(range(1, len(words) - 33)) AS u(s)
        ),
        repeated AS (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
        removed AS (SELECT DISTINCT r, s + i AS place FROM repeated, unnest(range(35)) AS u(i)),
        kept AS (
            SELECT d.r, count(*) AS n, string_agg(word, ' ' ORDER BY d.place) AS text
            FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs) d
            ANTI JOIN removed USING (r, place) GROUP BY d.r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)
    """,
    "op10_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        joined AS (
            SELECT conv_id,
                   count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum(12 + length(role) + length(regexp_replace(role, '[^\\<|]', '', 'g'))
                          + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g'))) AS formatted_chars
            FROM turns GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM joined
    """,
}
