"""Sources: JSON lines, run logs, key-value rows, folders, tables of cells. Schemas are always stated, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Malformed lines are dropped, or fail the read where `strict`."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def run_log(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header; cells that don't fit their type are null."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def text_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def pdf_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files that end in .pdf in any case, with the hash of their bytes; sorted by path only where it is shown."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path)
    return f.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))


def kv(df: DataFrame, key: str, default: str) -> DataFrame:
    """The value of a key as a variant; the default where the key is absent or its JSON is broken."""
    one = df.where(F.col("key") == key).agg(F.max("value_json").alias("v"))
    return one.select(F.coalesce(F.try_parse_json("v"), F.parse_json(F.lit(default))).alias("value"))


def history(df: DataFrame) -> DataFrame:
    """(id, ts, payload) with payloads that are JSON objects; others are skipped."""
    p = df.withColumn("payload", F.try_parse_json("payload_json"))
    return p.where("payload is not null and startswith(ltrim(payload_json), '{')").select("id", "ts", "payload")


def settings(df: DataFrame) -> DataFrame:
    """Lines KEY=value of a settings file; comments and other lines are skipped, quotes around a value removed."""
    m = F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", 1)
    v = F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", 2)
    return df.select(m.alias("key"), F.regexp_replace(v, "^[\"']|[\"']$", "").alias("value")).where("key <> ''")


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, col_no, cell) -> (doc_id, table_no, row_no, row) dense rows; missing cells are ''."""
    clean = F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"\s+", " "))
    g = cells.groupBy("doc_id", "table_no", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("col_no", clean.alias("c"))))).alias("m"), F.max("col_no").alias("last"))
    row = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    return g.select("doc_id", "table_no", "row_no", row.alias("row")).where(F.exists("row", lambda c: c != ""))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text) blocks -> (doc_id, page, text) in their order."""
    g = pages.where("text is not null").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return g.select("doc_id", "page", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))


def stem_parts(path: Column) -> Column:
    """supplier_dd-mm-yyyy_number from a file name: the first part that is a date splits it; without one all is supplier."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$")), True)
    n = F.size(parts)
    return F.struct(
        F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), (at - 1).cast("int")), "_")).otherwise(stem).alias("supplier"),
        F.when(at > 0, F.try_to_date(F.try_element_at(parts, at.cast("int")), "dd-MM-yyyy")).alias("date"),
        F.when((at > 0) & (at < n), F.array_join(F.slice(parts, (at + 1).cast("int"), n), "_")).alias("number"),
    )


def labelled_pairs(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, document, label) rows of a retrieval set; the label is 1 where none is given, rows without a text fail."""
    ok = df.withColumn("query", F.coalesce("query", F.raise_error(F.lit("a pair without a query")).cast("string")))
    ok = ok.withColumn("label", F.coalesce("label", F.lit(1)))
    return ok.limit(limit) if limit else ok
