"""The queries of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, packing, partenum, ppm, sharding, site_lines, superkmers, url_filters, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of `pages`, with aliases from their own tags."""
    return url_filters.url_report(_table(spark, sf_dir, "pages"))


def op2_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, at 64 MB a shard."""
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return site_lines.lines_report(_table(spark, sf_dir, "documents"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    return ppm.language_report(_table(spark, sf_dir, "documents"))


def op5_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from the windows of every conversation, and of one that speaks in control strings."""
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(talks.unionByName(spark.createDataFrame(chat.TRICK, "conv_id long, turn long, role string, text string")))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return winnowing.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lsm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of the equal texts of every document."""
    return exact_dedup.exact_report(_table(spark, sf_dir, "documents"))


def op8_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of every document."""
    return partenum.near_duplicates_report(_table(spark, sf_dir, "documents"))


def op9_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024 tokens."""
    return packing.packing_report(_table(spark, sf_dir, "documents"))


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start in an earlier one."""
    return superkmers.repeats_report(_table(spark, sf_dir, "documents"))


def url_alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 where the pages' own tags name no alias: the urls of consecutive pages, three by three, are aliases."""
    pages = _table(spark, sf_dir, "pages")
    r = url_filters.judge(pages, url_filters.chained(pages))
    return r.selectExpr("id as page_id", "host", "path", "rule", "verdict")


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 with a limit at which small tables split as well: 128 KB a shard."""
    return sharding.shard_report(_table(spark, sf_dir, "documents"), limit_bytes=128 << 10)


QUERIES = {f.__name__: f for f in (op1_redirects, op2_extendible_hashing, op3_site_lines, op4_ppm, op5_budgeted_windows, op6_winnowing, op7_lsm_index, op8_partenum, op9_balanced_packing, op10_super_kmers, url_alias_chains, sharding_small_limit)}

SQL: dict[str, str] = {"op1_redirects": url_filters.SQL, "op2_extendible_hashing": sharding.SQL, "op3_site_lines": site_lines.SQL, "op6_winnowing": winnowing.SQL, "op7_lsm_index": exact_dedup.SQL, "op8_partenum": partenum.SQL, "op10_super_kmers": superkmers.SQL, "url_alias_chains": url_filters.CHAINED_SQL, "sharding_small_limit": sharding.LIMITED_SQL.replace("@LIMIT", str(128 << 10))}
