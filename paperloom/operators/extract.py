"""From document texts to fields: lines, segments, dates, numbers, types, suppliers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import supplier_key

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: A dimension that is sent to every task must not be longer.
MAX_DIMENSION = 50_000


def lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line_no, line), line_no from 0; a null text has no lines, a last empty one is dropped."""
    x = docs.where("text is not null").select("doc_id", line_array(F.col("text")).alias("a"))
    return x.select("doc_id", F.posexplode("a").alias("line_no", "line"))


def line_array(text: Column) -> Column:
    """The lines of a text; a last empty one is dropped."""
    a = F.split(text, LINE_ENDS)
    return F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)


def segments(docs: DataFrame, header: int = 35, footer: int = 35) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line_no, line, segment), cut in place; a line of a short document may be header and footer, one row each."""
    x = docs.where("text is not null").select("doc_id", line_array(F.col("text")).alias("a")).select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("line_no", "line"))
    h, f = F.col("line_no") < header, F.col("line_no") >= F.col("n") - footer
    seg = F.array_compact(F.array(F.when(h, "header"), F.when(~h & ~f, "body"), F.when(f, "footer")))
    return x.withColumn("segment", F.explode(seg)).drop("n")


def recipient_block(ls: DataFrame, max_lines: int = 15) -> DataFrame:
    """Lines of the recipient: from a line that begins with a marker to the next blank line or so many lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    start = F.when(F.lower("line").rlike(r"^\s*(z\. hd\.|lieferanschrift|empfaenger|attn\.|à l'attention|a la atención)"), F.col("line_no"))
    x = ls.withColumn("start", F.last(start, True).over(w)).withColumn("blank", F.last(F.when(F.trim("line") == "", F.col("line_no")), True).over(w))
    return x.where(f"start is not null and line_no - start < {max_lines} and coalesce(blank, -1) < start").select("doc_id", "line_no", "line")


def contained_names(docs: DataFrame, dimension: DataFrame) -> DataFrame:
    """(doc_id, name_id, n_found) of the first name, by id, whose normal form lies in the document's; any position counts.

    dimension: (name_id, name), at most MAX_DIMENSION rows; an automaton over it reads each text once.
    """
    rows = dimension.where("name is not null").select("name_id", supplier_key(F.col("name")).alias("k")).where("k <> ''").limit(MAX_DIMENSION + 1).collect()
    if len(rows) > MAX_DIMENSION:
        raise ValueError(f"more than {MAX_DIMENSION} names")
    keys: dict[str, list[int]] = {}
    for r in rows:
        keys.setdefault(r.k, []).append(r.name_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, ids in keys.items():
            a.add_word(k, tuple(ids))
        if keys:
            a.make_automaton()
        for b in batches:
            out = []
            for doc, t in zip(b.doc_id, b.t):
                found = {i for _, ids in a.iter(t) for i in ids} if keys else set()
                if found:
                    out.append((doc, min(found), len(found)))
            yield pd.DataFrame(out, columns=["doc_id", "name_id", "n_found"])

    return docs.where("text is not null").select(F.col("doc_id").cast("long"), supplier_key(F.col("text")).alias("t")).mapInPandas(run, "doc_id long, name_id long, n_found long")


def name_from_file(path_col: str = "original_name"):
    """Kind and number that a scanner wrote into a file name, e.g. Rechnung_00542.pdf: a struct (kind, number, ext)."""
    c = F.col(path_col)
    return F.struct(
        F.lower(F.regexp_extract(c, r"^([A-Za-z]+)[ _-]", 1)).alias("kind"),
        F.regexp_extract(c, r"[ _-]([0-9]+)\.", 1).try_cast("long").alias("number"),
        F.lower(F.regexp_extract(c, r"\.([A-Za-z]+)$", 1)).alias("ext"),
    )
