"""Queries of the training-data operators over the tables of a data directory, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import best_record, canonical_map, charset, exact_copies, leakage, main_content, name_link, oracle, packing, truncation
from rosterloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = best_record.survivors(table(spark, d, "ranked_contacts"))
    return groups.filter("records > 1 and dominant_id is not null").select(F.col("dominant_id").alias("ranked_id"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    rows = best_record.assembled(table(spark, d, "ranked_contacts"))
    return rows.withColumn("observed_at", F.unix_micros(F.col("observed_at").cast("timestamp")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_repaired(spark, d).select("src", "rec_id", "field")


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    contacts = charset.damaged_values(table(spark, d, "contacts"), "contact_id", ["name", "role"], "contacts")
    return contacts.unionByName(charset.damaged_values(table(spark, d, "ranked_contacts"), "ranked_id", ["title"], "ranked_contacts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_link.variant_pairs(table(spark, d, "contacts"), table(spark, d, "ranked_contacts"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every named row with its entity: all pairs of p4_found in compact form."""
    return name_link.entities(table(spark, d, "contacts"), table(spark, d, "ranked_contacts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return exact_copies.copies(table(spark, d, "contacts"), "contact_id", ["name"], ["email", "page_url"])


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return exact_copies.collapsed(table(spark, d, "contacts"), "contact_id", ["name"], ["email", "page_url"])


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Records, canonical forms, and 128-bit hashes that stand for more than one form (the collision check), in one row."""
    keys = exact_copies.keyed(table(spark, d, "contacts"), "contact_id", ["name"], ["email", "page_url"])
    per_hash = exact_copies.collisions(exact_copies.copy_groups(keys), least=1)
    return per_hash.agg(F.sum("records").alias("records"), F.sum("forms").alias("forms"), F.count_if(F.col("forms") > 1).alias("collisions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    part = lambda df, key, col, src: df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("rec_id"), F.col(col).cast("string").alias("value"))
    rows = part(table(spark, d, "contacts"), "contact_id", "role", "contacts").unionByName(part(table(spark, d, "ranked_contacts"), "ranked_id", "title", "ranked_contacts"))
    return canonical_map.mapped_rows(spark, rows, table(spark, d, "role_catalog"), table(spark, d, "role_aliases"), charset.repaired_values)


def _page_records(spark: SparkSession, d: str) -> DataFrame:
    pages = main_content.records(table(spark, d, "acquired_pages"), "acquired_pages", "page_id", "url", "visible_text")
    return pages.unionByName(main_content.records(table(spark, d, "fetched_extractions"), "fetched_extractions", "extraction_id", "url", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.body_lines(_page_records(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.residues(_page_records(spark, d)).select("src", "rec_id")


#: Of a container's capacity, the share that may bear loss: above the share of the documents (0.885), so it binds
#: containers of prose without a heading and leaves the others as they are.
LOSS_SHARE = 0.95


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.assigned(table(spark, d, "documents"), table(spark, d, "pack_sizes"), loss_share=LOSS_SHARE)


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_documents(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_survivors, p2_found, p6_found, p3_found, p3_repaired, p4_found, p4_entities, p5_found, p5_collapsed, p5_check, p7_found, p8_packed, p8_usage, p9_found, p10_found, p10_rates)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
