"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, license_scan, merkle, mixing, neardup, pii, secret_scan, tokenfile, toxicity, urlfilter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that benchmark windows hit, by Wu-Manber search; contaminated from two items on."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: base patterns, and what the span classifier adds."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of which each document holds at least four fifths of the shingles."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document: base patterns, and tokens that are random and not text."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of each document and of its edited text, and their likeness."""
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token file says of each document, written and read back."""
    return tokenfile.encode_documents(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document: Jaccard of five-word shingles of 0.8 and more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("h", "root")


#: verdict, host, path
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of each page's URL."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, urlfilter.RULE_SCHEMA))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, by its source's target."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by the grammar, learned from rows that aren't held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_personal_data, op3_licenses, op4_secrets, op5_merkle, op6_token_files, op7_near_duplicates, op8_url_filter, op9_mix_sources, op10_toxicity)}
