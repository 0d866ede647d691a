"""Numbers of a document: field names on lines, values after, below or in the column under them, vehicle plates.

Lines are cut in place with the two lines after them; only lines that hold a field name go on, and one small row per
hit is aggregated. Defined results: null and empty texts, and texts without a plausible number, give no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as attribute

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.extract import line_array
from paperloom.session import evaluated, present

# What a number looks like, in order of preference.
TOKENS = (r"\b[A-Za-z0-9][-A-Za-z0-9/]{2,}\b", r"\b\d{6,}\b")
# Tokens that are no number of a document.
DATE, IBAN, PHONE, AMOUNT = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\b", r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", r"^\+?\d[\d\s/()\-]{4,}\d$", r"^\d{1,3}([.,]\d{3})*[.,]\d{2}$"
# Field names by the kind of document, for suppliers without names of their own.
FALLBACK = {
    "lieferschein": ("Lieferschein-Nr", "Lieferscheinnr", "Lieferschein Nr", "LS-Nr"), "rechnung": ("Rechnungsnummer", "Rechnung Nr", "RE-"),
    "auftrag": ("Auftragsnummer", "Auftrag Nr", "Auftrag-Nr"), "beleg": ("Belegnummer", "Beleg-Nr", "Beleg Nr"),
}
# Words that bring a field forward for a kind of document.
FORWARD = {"RECHNUNG": ("rechnung", "invoice", "re-"), "LIEFERSCHEIN": ("lieferschein", "delivery", "ls-"), "ÜBERNAHMESCHEIN": ("übernahmeschein", "uebernahmeschein", "entsorgungs"), "KOMMISSIONIERLISTE": ("kommission", "picking", "auftrag")}


@dataclass
class Fields:
    """A supplier's field names: first and second choice, and other choices for a kind of document."""

    primary: tuple[str, ...]
    secondary: tuple[str, ...] = ()
    overrides: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = attribute(default_factory=dict)


def search_order(fields: tuple[str, ...], doc_type: str | None) -> list[str]:
    """Longest names first; among equally long ones those that fit the kind of document, then as listed."""
    words = FORWARD.get((doc_type or "").upper(), ())
    return sorted(dict.fromkeys(fields), key=lambda f: (-len(f), not any(w in f.lower() for w in words) if words else False))


def tolerant(name: str) -> str:
    """A pattern for a field name with any separators between its words; only the name itself where it is short."""
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", name) if p]
    exact = re.sub(r"([^A-Za-z0-9\s])", r"\\\1", name)
    if len(re.sub(r"[^a-z0-9]+", "", name.lower())) < 4 or not parts:
        return f"(?:{exact})"
    return f"(?:{exact}|\\b{r'[\s\-_/.:#]*'.join(parts)}\\b)"


def plans(spark: SparkSession, suppliers: dict[str, Fields], doc_types: tuple[str, ...]) -> list[tuple]:
    """(supplier | '', doc_type | '', tier, ord, field, pattern, confidence): the fields in the order they are searched."""
    out = []

    def put(s: str, d: str, tier: int, fields: tuple[str, ...], conf: str) -> None:
        out.extend((s, d, tier, k, f, tolerant(f), conf) for k, f in enumerate(search_order(fields, d)))

    for d in ("", *doc_types):
        put("", d, 2, FALLBACK.get(d.lower()) or tuple(f for fs in FALLBACK.values() for f in fs), "medium")
        for s, x in suppliers.items():
            one, two = x.overrides.get(next((k for k in x.overrides if k.upper() == d.upper()), ""), (x.primary, x.secondary))
            put(s, d, 0, one, "high")
            put(s, d, 1, two, "medium")
    return out


def plausible(t: Column) -> Column:
    phone = t.rlike(r"[ ()/\-]") & t.rlike(PHONE)
    return (F.length(t) >= 4) & ~t.rlike(DATE) & ~t.rlike(IBAN) & ~phone & ~t.rlike(AMOUNT) & t.rlike(r"\d")


def first_number(text: Column) -> Column:
    hits = F.filter(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TOKENS]), plausible)
    return F.try_element_at(hits, F.lit(1))


def placed(text: Column) -> Column:
    """Plausible numbers with their places, each once, from left to right."""

    def of(p: str) -> Column:
        raws, gaps = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)
        total = lambda arr, n: F.aggregate(F.slice(arr, 1, n), F.lit(0), lambda s, x: s + F.length(x))
        return F.transform(raws, lambda r, i: F.struct((total(gaps, i + 1) + total(raws, i)).alias("p"), r.alias("t")))

    return F.array_sort(F.array_distinct(F.filter(F.concat(*[of(p) for p in TOKENS]), lambda x: plausible(x["t"]))))


def below(line: Column, values: Column, name: Column) -> Column:
    """The value in the column under a field's name, from the placed values of a line: where there are several and the nearest isn't left of the name."""
    pos = F.call_function("instr", F.lower(line), F.lower(name)) - 1
    near = F.array_min(F.transform(values, lambda x: F.struct(F.abs(x["p"] - pos).alias("far"), x["p"].alias("p"), x["t"].alias("t"))))
    return F.when((pos >= 0) & (F.size(values) >= 2), F.try_element_at(F.filter(F.array(near), lambda x: x["p"] + F.greatest(F.length(x["t"]), F.lit(1)) >= pos), F.lit(1))["t"])


def document_numbers(docs: DataFrame, suppliers: dict[str, Fields] | None = None, doc_types: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, supplier, doc_type) -> (doc_id, number, field, confidence).

    A supplier's own fields come first, then those of the kind of document; each field looks under its name, after it
    and on the next two lines, in the order of lines. The field names are a small list of the project, sent as literals.
    """
    spark = docs.sparkSession
    rows = plans(spark, suppliers or {}, doc_types)
    every = "(?i)" + "|".join(sorted({p for *_, p, _ in rows}, key=len, reverse=True))
    dim = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("s", "d", "tier", "ord", "name", "pattern", "conf"), r)]) for r in rows])
    # texts without any field name are left out before they are cut
    x = docs.where(F.col("text").rlike(every)).select("doc_id", "text", F.coalesce("supplier", F.lit("")).alias("supplier"), F.upper(F.coalesce("doc_type", F.lit(""))).alias("doc_type"))
    known = F.array(F.lit(""), *[F.lit(d.upper()) for d in doc_types])
    x = x.withColumn("doc_type", F.when(F.array_contains(known, F.col("doc_type")), F.col("doc_type")).otherwise(""))
    x = evaluated(x, "doc_id", "supplier", "doc_type", a=line_array(F.col("text")))
    at = lambda k: F.coalesce(F.try_element_at("a", F.col("line_no") + k), F.lit(""))
    x = x.select("*", F.posexplode("a").alias("line_no", "line")).where(F.col("line").rlike(every)).select("doc_id", "supplier", "doc_type", "line_no", "line", at(2).alias("n1"), at(3).alias("n2"))
    mine = F.filter(dim, lambda f: (F.upper(f["d"]) == F.col("doc_type")) & ((f["s"] == "") | (f["s"] == F.col("supplier"))))
    x = x.select("*", F.explode(mine).alias("f")).where(F.rlike("line", F.concat(F.lit("(?i)"), F.col("f.pattern"))))
    x = evaluated(x, "doc_id", "line_no", "line", "n1", "n2", "f", v1=placed(F.col("n1")), v2=placed(F.col("n2")))
    col = F.coalesce(below(F.col("line"), F.col("v1"), F.col("f.name")), below(F.col("line"), F.col("v2"), F.col("f.name")))
    low, name = F.lower("line"), F.regexp_replace(F.lower("f.name"), r"([^a-z0-9\s])", r"\\$1")
    dated = F.rlike(low, F.concat(F.lit(r"datum[:\s-]*"), name, F.lit("|"), name, F.lit(r"[:\s-]*datum")))
    end = F.length(F.call_function("regexp_extract", F.col("line"), F.concat(F.lit("(?is)^.*?"), F.col("f.pattern")), F.lit(0)))
    tail = F.regexp_replace(F.substring("line", end + 1, F.length("line")), r"^[: \t]+", "")
    number = F.coalesce(col, F.when(~dated, F.coalesce(first_number(tail), first_number(F.col("n1")), first_number(F.col("n2")))))
    x = present(x, "doc_id", "line_no", "f", number=number).select("doc_id", F.struct("f.tier", "f.ord", "line_no", "number", F.col("f.name").alias("field"), "f.conf").alias("k"))
    return x.groupBy("doc_id").agg(F.min("k").alias("k")).select("doc_id", "k.number", "k.field", F.col("k.conf").alias("confidence"))


PLATE = r"(?i)\b([A-ZÄÖÜ]{1,3})(?:\s*[-–]\s*|\s+)([A-ZÄÖÜ]{1,2})\s*(\d{2,4})(?:\s*[A-Z])?\b"
MERGED = r"(?i)\b([A-ZÄÖÜ]{1,3})([A-ZÄÖÜ]{1,2})(\d{2,4})(?:\s*[A-Z])?\b"
NAMED = r"(?i)\b(kennz|kennzeichen|amtliches\s+kennzeichen|kz\.?)[\s:]*"


def _plate(line: Column, pattern: str) -> Column:
    """The first plate of a line as XX-YY123; null for words that only look like one."""
    part = lambda k: F.upper(F.regexp_extract(line, pattern, k))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("Ä"), F.lit("AE")), F.lit("Ö"), F.lit("OE")), F.lit("Ü"), F.lit("UE"))
    word = F.concat(part(1), part(2))
    firm = F.upper(line).rlike(r"GMBH|GMB ?- ?H")
    ok = (part(3) != "") & (word != "VOM") & ~firm & ~part(1).isin("GMB", "GMBH")
    return F.when(ok, F.concat(plain(part(1)), F.lit("-"), plain(part(2)), part(3)))


def plates(docs: DataFrame) -> DataFrame:
    """(doc_id, plate, tier): first beside or below a word for it in the first 80 lines, then on any line, at last written together."""
    x = evaluated(docs.where("text is not null"), "doc_id", a=F.transform(line_array(F.col("text")), lambda l: F.trim(l)))
    x = evaluated(x, "doc_id", "a", p=F.transform("a", lambda l: _plate(l, PLATE)), m=F.transform("a", lambda l: F.coalesce(_plate(l, PLATE), _plate(l, MERGED))))
    near = F.transform("a", lambda l, i: F.when((i < 80) & l.rlike(NAMED), F.coalesce(F.try_element_at("p", i + 1), F.try_element_at("p", i + 2))))
    first = lambda c: F.try_element_at(F.filter(c, lambda v: v.isNotNull()), F.lit(1))
    x = evaluated(x, "doc_id", a=first(near), b=first(F.col("p")), c=first(F.col("m")))
    return x.select("doc_id", F.coalesce("a", "b", "c").alias("plate"), F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).otherwise(3).alias("tier")).where("plate is not null")
