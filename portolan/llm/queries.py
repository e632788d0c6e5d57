"""The registered queries of this package: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from portolan.llm import (
    dimension_scan, filter_audit, host_rules, mixing, packing, pivot_index, prefix_trie, simhash,
    token_counts, token_files, toxicity, url_lists, warc,
)
from portolan.llm.common import table
from portolan.llm.oracles import ORACLES  # noqa: F401  (registered with the queries)
from portolan.scratch import new_folder

WINDOW = 2048
TOKEN_LIMIT = 4096
SEARCHED = 100


def op1_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_of(packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), WINDOW))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.payloads(warc.read_archives(spark, folder, archives))


def op3_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` as captures. They have no fetch time, so one within two years is
    derived from the page's number."""
    minutes = F.pmod(F.col("page_id") * 373, F.lit(1_051_200)).cast("int")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", _at(mins=minutes).alias("fetched_at"))


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a published list: entries for every host of `pages` and its parent
    domain, with dates and actions drawn from the name."""
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")
    domains = table(spark, sf_dir, "pages").select(url_lists.host(F.col("url")).alias("host")).where(
        "host IS NOT NULL").distinct().select(F.explode(F.when(
            F.size(labels) > 2, F.array("host", parent)).otherwise(
            F.array("host"))).alias("domain")).distinct()

    def drawn(n: int):
        return F.conv(F.substring(F.md5("domain"), n, 1), 16, 10).cast("int")

    a, b, c = drawn(1), drawn(2), drawn(3)
    entries = F.array_compact(F.array(
        F.struct(F.lit("block").alias("action"), _at(days=30 * a).alias("at")),
        F.struct(F.lit("remove").alias("action"), _at(days=30 * a + 40 + 10 * b).alias("at")),
        F.when(c < 12, F.struct(
            F.when(c % 2 == 0, "allow").otherwise("block").alias("action"),
            _at(days=30 * a + 200 + 10 * c).alias("at")))))
    return domains.select("domain", F.inline(entries))


def _at(days=None, mins=None):
    start = F.lit("2016-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(days=days, mins=mins)


def op4_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_lists.judge_captures(captures(spark, sf_dir), dated_entries(spark, sf_dir))
    return judged.withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("fetched_at", "since")})


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("place").alias("vec_id"), "n_links",
                        F.col("component").alias("component_id"),
                        F.col("place").eqNullSafe(F.col("component")).alias("kept"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    shards = token_files.write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder, shards)


def op9_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_counts.store_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    counted = token_counts.answers(stored, budgets=(TOKEN_LIMIT,))
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                          f"chars_within_{TOKEN_LIMIT}")


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("place").alias("doc_id"),
                        simhash.hex_digits(F.col("print")[0]).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return dimension_scan.nearest(
        dimension_scan.build(vectors), vectors.where(F.col("vec_id") % SEARCHED == 0))


QUERIES = {query.__name__: query for query in (
    op1_kk_packing, op2_warc_chunks, op3_fm_toxicity, op4_temporal_lists, op5_pivotal_mix,
    op6_pivot_index, op7_host_rules, op8_token_files, op9_prefix_counts, op10_simhash_ball,
    op11_prefix_trie, op12_filter_audit, op13_dimension_scan)}
