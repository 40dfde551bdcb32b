"""The registered queries of this subpackage, over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxgrid.llm import chats, decontaminate, html, interactions, licenses, packing, pii, quality, ranking, simhash, tokens, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item and each document that contains it."""
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that documents are as a whole, and notices of them that documents have."""
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs).unionByName(licenses.notices(docs))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document, and terms that reveal it."""
    return pii.spans(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its sequence of at most 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of all pages as WARC archives, the second one with the damage of a drill."""
    pages = _table(spark, sf_dir, "pages")
    return warc.audited(pages, warc.drill(pages))


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that prefix no other one, rendered."""
    return chats.rendered(_table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document and the cascade's verdict."""
    return quality.counts(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return simhash.components(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat token files."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html.extracted(_table(spark, sf_dir, "pages"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of five filters removes, by source."""
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item."""
    return ranking.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL, by rule or by template."""
    return urls.judged(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_licenses, op3_pii, op4_packing, op5_warc_fixity, op6_chats, op7_quality_rules, op8_simhash,
        op9_token_counts, op10_html, op11_filter_interactions, op12_ranked_search,
        op13_url_filters,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_fixity": warc.ORACLE, "op6_chats": chats.ORACLE, "op11_filter_interactions": interactions.ORACLE,
    "op12_ranked_search": ranking.ORACLE, "op13_url_filters": urls.ORACLE,
}
