"""The queries of the training-text operators, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import canonical, entities, history, mixing, pii, scans, tokens
from paperloom.session import spread, table, width


def p2_names(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quarantine")
    m = table(spark, d, "supplier_matches")
    return q.select(F.explode(F.array("supplier", "corrected_supplier")).alias("name")).unionByName(m.select(F.col("matched_alias").alias("name")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    linked = entities.link_entities(p2_names(spark, d), table(spark, d, "supplier_ref"))
    return entities.variant_pairs(linked)


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ocr_results").select(F.lit("ocr_results").alias("rec_table"), F.col("ocr_id").alias("rec_id"), "text")
    return o.unionByName(table(spark, d, "labeled_documents").select(F.lit("labeled_documents").alias("rec_table"), F.col("label_id").alias("rec_id"), "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_damage(p3_records(spark, d))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(p3_records(spark, d))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "suppliers").select("supplier_id", "name", "aliases")
    m = table(spark, d, "supplier_matches").select("match_id", "canonical_name")
    s = s.repartition(width(s), "supplier_id").dropDuplicates(["supplier_id"])
    m = m.repartition(width(m), "match_id").dropDuplicates(["match_id"])
    return (
        s.select(F.lit("suppliers.name").alias("field_name"), F.col("supplier_id").alias("rec_id"), F.lit(0).alias("pos"), F.col("name").alias("val"))
        .unionByName(s.select(F.lit("suppliers.aliases").alias("field_name"), F.col("supplier_id").alias("rec_id"), F.posexplode("aliases").alias("pos", "val")).withColumn("pos", F.col("pos") + 1))
        .unionByName(m.select(F.lit("supplier_matches.canonical_name").alias("field_name"), F.col("match_id").alias("rec_id"), F.lit(0).alias("pos"), F.col("canonical_name").alias("val")))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_reference(p4_values(spark, d), entities.reference_rows(table(spark, d, "supplier_ref")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.find_copies(table(spark, d, "uploads"), table(spark, d, "documents"))


def p5_registry(spark: SparkSession, d: str) -> DataFrame:
    return history.registry_after(table(spark, d, "uploads"), table(spark, d, "document_fingerprints"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(spread(table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(spread(table(spark, d, "documents"))).distinct()


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask_items(spread(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p5_found": p5_found, "p5_registry": p5_registry, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_masked": p8_masked}
_SHA = "lower(trim(regexp_replace(sha256, '^.*:|\\s', '', 'g')))"
ORACLE: dict[str, str] = {
    "p5_registry": f"""with o as (select owner_scope, {_SHA} sha256, min(first_seen_at) a, max(last_seen_at) b, max(coalesce(seen_count, 1)) n from document_fingerprints where sha256 is not null and owner_scope is not null group by 1, 2),
 u as (select owner_scope, {_SHA} sha256, min(ts) a, max(ts) b, count(*) filter (where batch_no >= 1) fresh, count(*) filter (where batch_no < 1) old from (select distinct on (upload_id) * from uploads) where sha256 is not null and owner_scope is not null group by 1, 2)
 select owner_scope, sha256, least(o.a, u.a) first_seen_at, greatest(o.b, u.b) last_seen_at, cast(greatest(coalesce(n, 0), coalesce(old, 0)) + coalesce(fresh, 0) as bigint) seen_count from o full join u using (owner_scope, sha256)""",
}
