"""Text columns: normal forms, safe names, scores, chunks. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Umlauts in plain letters.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
# Month names of folders and long dates.
MONTHS_DE = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
# The tokens a file name template may hold.
TEMPLATE_TOKENS = ("supplier", "date", "date_iso", "doc_number", "doctype", "year", "month", "day")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def transliterate(c: Column) -> Column:
    for a, b in UMLAUTS:
        c = F.replace(c, F.lit(a), F.lit(b))
        if a != "ß":
            c = F.replace(c, F.lit(a.upper()), F.lit(b.capitalize()))
    return c


def supplier_key(c: Column) -> Column:
    """Lower case, umlauts spelt out, anything but letters and digits one space."""
    return F.trim(F.regexp_replace(transliterate(F.lower(c)), "[^a-z0-9]+", " "))


def profile_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def classifier_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(transliterate(F.lower(c)), r"[_:/\\-]+", " "), r"\s+", " ")


def plain_classifier_text(text: str) -> str:
    """The same for a word known beforehand."""
    import re

    text = text.lower()
    for a, b in UMLAUTS:
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", re.sub(r"[_:/\\-]+", " ", text))


def safe_filename(c: Column, default: str = "Unbekannt") -> Column:
    s = F.regexp_replace(F.regexp_replace(transliterate(c), r"\s+", "_"), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def cut_with_hash(c: Column, width: int) -> Column:
    """Longer values keep their beginning and end in six hex digits of their hash."""
    short = F.concat(F.substring(c, 1, width - 7), F.lit("_"), F.substring(F.sha1(c), 1, 6))
    return F.when(F.length(c) > width, short).otherwise(c)


def fallback_number(text: Column) -> Column:
    return F.concat(F.lit("ohneNr_"), F.upper(F.substring(F.sha1(text), 1, 6)))


def canary_bucket(c: Column) -> Column:
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def file_stem(supplier: Column, date: Column, number: Column, width: int = 120) -> Column:
    """supplier_yyyy-MM-dd_number; missing parts are left out."""
    parts = F.concat_ws("_", safe_filename(supplier), F.date_format(date, "yyyy-MM-dd"), F.nullif(F.regexp_replace(number, "[^A-Za-z0-9-]+", ""), F.lit("")))
    return cut_with_hash(parts, width)


def template_value(c: Column) -> Column:
    """A value without signs that file names can't hold, slashes as one underscore, none at its ends."""
    v = F.regexp_replace(F.regexp_replace(c, r"[/\\]", "_"), r'[<>:"|?*\x00-\x1f]', "")
    return F.regexp_replace(F.regexp_replace(v, "_+", "_"), r"^[_. -]+|[_. -]+$", "")


def render(template: str, values: dict[str, Column]) -> Column:
    """A file name template with {tokens}; separators left by empty values are removed. Unknown tokens raise."""
    import re

    if unknown := set(re.findall(r"\{([a-z_]+)\}", template)) - set(TEMPLATE_TOKENS):
        raise ValueError(f"unknown tokens: {sorted(unknown)}")
    out = F.lit(template)
    for t in TEMPLATE_TOKENS:
        if f"{{{t}}}" in template:
            out = F.replace(out, F.lit(f"{{{t}}}"), F.coalesce(template_value(values[t]), F.lit("")))
    return F.regexp_replace(F.regexp_replace(out, "[_ -]*_[_ -]*", "_"), "^[_ -]+|[_ -]+$", "")


def month_folder(date: Column, style: str = "A", supplier: Column | None = None) -> Column:
    """A: yyyy-MM, B: month name and year, C: yyyy-MM_supplier."""
    ym = F.date_format(date, "yyyy-MM")
    if style == "A":
        return ym
    if style == "B":
        return F.concat(F.element_at(F.array(*[F.lit(m) for m in MONTHS_DE]), F.month(date)), F.lit(" "), F.year(date))
    if style == "C":
        return F.concat(ym, F.lit("_"), safe_filename(supplier))
    raise ValueError(style)


def confidence(c: Column) -> Column:
    """Typed confidence with decimal comma or point, 0 when unreadable, within 0 and 1."""
    v = F.coalesce(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def number_confidence(c: Column) -> Column:
    # The weight of each word.
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"high": 0.95, "medium": 0.75, "low": 0.50, "none": 0.0}.items() for x in kv]), F.lower(c)), F.lit(0.0))


def pivot_year(yy: Column, pivot: int = 70) -> Column:
    return F.when(yy >= 100, yy).when(yy >= pivot, yy + 1900).otherwise(yy + 2000)


def parse_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d")) -> Column:
    """The first format that reads the value, with a year from 1990 to 2100; else null."""
    d = F.coalesce(*[F.try_to_date(c, f) for f in formats])
    return F.when(F.year(d).between(1990, 2100), d)


def keyword_hits(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(w)) for w in words])


def text_score(c: Column, keywords: tuple[str, ...], labels: tuple[str, ...]) -> Column:
    """2 per word, 1 per 25 letters or digits, 60 per keyword, 80 if any label, 180 per numeric date; null counts as empty."""
    t = F.lower(F.coalesce(c, F.lit("")))
    words = F.size(F.filter(F.split(t, r"[ \t\r\n]+"), lambda w: w != ""))
    alnum = F.length(F.regexp_replace(t, "[^a-z0-9]", ""))
    dates = F.regexp_count(t, F.lit(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"))
    return 2 * words + F.floor(alnum / 25).cast("int") + 60 * keyword_hits(t, keywords) + F.when(keyword_hits(t, labels) > 0, 80).otherwise(0) + 180 * dates


def trigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays; two empty ones share 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.nullif(F.size(F.array_union(a, b)), F.lit(0))), F.lit(0.0))


def word_chunks(c: Column, budget: int) -> Column:
    """Greedy chunks of whole words within so many characters; a longer word is a chunk of its own, never an empty one."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def put(acc: Column, w: Column) -> Column:
        joined = F.concat(acc["open"], F.lit(" "), w)
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), w.alias("open")))
            .when(F.length(joined) <= budget, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), w.alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(words, start, put, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def page_ranges(c: Column) -> Column:
    """'1-3, 5' as [1, 2, 3, 5]; null when any part is no range."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$"))
    low = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*([0-9]+)$", 1), F.lit("")).cast("int"), low(p))
    return F.when(good & F.forall(parts, lambda p: low(p) <= high(p)), F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))


def rate_rule(c: Column) -> Column:
    """'10/60m' as (limit, seconds); null when it is no rule."""
    unit = F.regexp_extract(c, r"^[0-9]+/[0-9]+([smh]?)$", 1)
    secs = F.regexp_extract(c, r"/([0-9]+)", 1).try_cast("int") * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(c.rlike(r"^[0-9]+/[0-9]+[smh]?$"), F.struct(F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("int").alias("limit"), secs.alias("seconds")))


def error_type(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.substring_index(c, ":", 1)), " +", "_"), 1, 40)


def unit_vector(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def norm_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box on a page in thousandths, at least 1 wide and high."""
    def scale(v: Column, of: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(F.try_divide(v * 1000, of) + 0.5).cast("int")))

    a, b = scale(F.least(x0, x1), width), scale(F.least(y0, y1), height)
    c, d = scale(F.greatest(x0, x1), width), scale(F.greatest(y0, y1), height)
    return F.struct(F.least(a, F.lit(999)).alias("x0"), F.least(b, F.lit(999)).alias("y0"), F.greatest(c, F.least(a, F.lit(999)) + 1).alias("x1"), F.greatest(d, F.least(b, F.lit(999)) + 1).alias("y1"))
