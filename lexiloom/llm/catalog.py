"""The registered query of each corpus operator, over its whole table, and the SQL that some are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import digests, jaccard, language, mixing, packing, passages, redirects, rules, sharding, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.karmarkar_karp_shards(_table(spark, sf_dir, "documents"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_token_counts(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op4_first_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.redirect_decisions(_table(spark, sf_dir, "pages"), hosts=redirects.host_rules(spark))


def op5_redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a fixture's redirects, as the tables hold none."""
    pages = _table(spark, sf_dir, "pages")
    return redirects.redirect_decisions(pages, redirects.fixture_redirects(pages), redirects.host_rules(spark))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.risk_controlled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_cutoff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stratum and rule its holdout, its safe cutoff if there is one, and how many good labels one needs."""
    return rules.cutoff_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair_mix(_table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.canonical_copies(_table(spark, sf_dir, "documents"))


def op10_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_karmarkar_karp_shards, op2_separator_scan, op3_ngram_jaccard_join, op4_first_fit_decreasing, op5_redirect_equivalence, op5_redirect_chains, op6_risk_controlled_rules, op6_cutoff_report, op7_pfair_mix, op8_compact_windows, op9_canonical_digest, op10_byte_bigru)}
SQL = {"op3_ngram_jaccard_join": jaccard.SQL, "op5_redirect_equivalence": redirects.SQL, "op5_redirect_chains": redirects.CHAINS_SQL, "op6_risk_controlled_rules": rules.SQL, "op6_cutoff_report": rules.REPORT_SQL, "op9_canonical_digest": digests.SQL}
