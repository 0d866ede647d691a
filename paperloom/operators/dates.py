"""Dates of a document: scored candidates, label cascades, inspection reports, context scores.

A document's lines are one array, and every operator is a projection over it: no document is shuffled, and a text of
any length stays in its row. Months are read by their name within one line. Defined results: a null or empty text gives
no row, and so does a text without a readable date; ties go to the earlier line, then to the earlier place in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.extract import line_array
from paperloom.session import evaluated, present

# The month names that are read.
MONTHS = {n: k for k, names in enumerate(("jan januar", "feb februar", "mar maer maerz märz", "apr april", "mai may", "jun juni", "jul juli", "aug august", "sep sept september", "okt oktober", "nov november", "dez dezember"), 1) for n in names.split()}
# Lines about a vehicle's registration or a later inspection tell no document date.
EXCLUDED = r"\bez\b|zulassung|nächste hu|naechste hu|fällig|faellig"
# Words of inspection reports, and those of them that stand beside the report's date.
REPORT = ("dekra", "prüfbericht", "pruefbericht", "untersuchungsbericht", "hauptuntersuchung", "hu-prüfung", "hu-pruefung", "berichts-nr", "berichtsnr")
BESIDE = REPORT[1:]
# Date patterns in their order, with the form they are read by.
PATTERNS = (
    (r"\b\d{4}-\d{2}-\d{2}\b", "ymd"), (r"\b\d{4}/\d{2}/\d{2}\b", "ymd"), (r"\b\d{1,2}\.\d{1,2}\.\d{4}\b", "dmy"), (r"\b\d{1,2}-\d{1,2}-\d{4}\b", "dmy"), (r"\b\d{1,2}/\d{1,2}/\d{4}\b", "dmy"),
    (r"\b\d{1,2}\.\d{1,2}\.\d{2}\b", "dmyy"), (r"\b\d{1,2}-\d{1,2}-\d{2}\b", "dmyy"), (r"\b\d{1,2}/\d{1,2}/\d{2}\b", "dmyy"),
    (r"\b\d{1,2}[.\s]+[A-Za-z]+[.\s]+\d{4}\b", "name"), (r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b", "name"),
)
# Sources in their order: labels, words that rule a line out, and how the date is taken from it.
OTHER_DATES = ("auftragsdatum", "lieferdatum", "lieferscheindatum", "lieferscheintermin", "liefertermin", "belegdatum", "beleg-datum", "beleg datum", "rechnungsdatum", "bestelldatum", "druckdatum", "versanddatum", "abholdatum", "abhol-datum", "warenausgang", "ausgang", "delivery by date")
PRIORITIES = (
    ("lieferdatum", ("lieferdatum", "lieferscheindatum", "datum lieferung", "tag der lieferung"), (), "any"),
    ("lieferdatum", ("lieferscheintermin", "liefertermin", "lieferschein-termin", "liefertermin-datum"), (), "any"),
    ("lieferdatum", ("warenausgang", "ausgang", "ausgangsdatum"), (), "any"), ("lieferdatum", ("delivery by date",), (), "dash"), ("lieferdatum", ("delivery date",), (), "any"),
    ("belegdatum", ("beleg-datum", "belegdatum", "beleg datum"), (), "after"), ("belegdatum", ("rechnungsdatum",), (), "any"), ("druckdatum", ("druckdatum",), (), "any"),
    ("datum", ("document date",), (), "dash"), ("datum", ("document date",), (), "any"), ("datum", ("datum",), OTHER_DATES, "any"),
    ("auftragsdatum", ("auftragsdatum",), (), "any"), ("auftragsdatum", ("auftragdatum",), (), "any"),
)
# Labels of a line by their pattern, with priority and bonus.
LABELS = (
    ("lieferdatum", r"\b(lieferscheindatum|lieferdatum|liefertermin|tag der lieferung|tag d[\w.]*ief|lieferschein[\s-]?termin)\b", 1, 0.2),
    ("belegdatum", r"\b(beleg[-\s]?datum|beleg[-\s]?d[\w.]*|datum[-\s]?beleg)\b", 2, 0.15),
    ("rechnungsdatum", r"\b(rechn\.?-?\s*dat\.?|rechnungsdatum|rechnung[s-]?dat|rechn\s*d[\w.]*)\b", 3, 0.1),
    ("druckdatum", r"\b(druckdatum(?:\s*[/\-]?\s*zeit)?|druckdatum/-zeit|druck[-\s]?dat|druck[-\s]?d[\w.]*)\b", 4, 0.05),
    ("ausgang_wm", r"\b(warenausgang|ausgang[\s-]?dat|warenausgang[\s-]?dat)\b", 1, 0.0),
)
# Labels of a context by the first word found.
CONTEXT = (("Rechnungsdatum", ("rechnung", "invoice", "datum", "date", "rg")), ("Lieferdatum", ("liefer", "delivery", "auslieferung")), ("Bestelldatum", ("bestell", "order", "auftrag")), ("Fälligkeitsdatum", ("fällig", "zahlung", "due")))


def has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def read(raw: Column, form: str, pivot: int = 79) -> Column:
    """A raw date by its form; years of two digits up to the pivot are 20xx; null where it is no day of the calendar."""
    if form == "ymd":
        return F.try_to_date(F.replace(raw, F.lit("/"), F.lit("-")), "yyyy-MM-dd")
    if form == "name":
        m = r"^(\d{1,2})[-.\s]+([A-Za-z]+)[-.\s]+(\d{4})$"
        months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
        return F.try_to_date(F.concat_ws(".", F.regexp_extract(raw, m, 1), F.element_at(months, F.lower(F.regexp_extract(raw, m, 2))).cast("string"), F.regexp_extract(raw, m, 3)), "d.M.yyyy")
    d = F.regexp_replace(raw, "[-/]", ".")
    if form == "dmyy":
        d = F.concat(F.regexp_replace(d, r"\d{2}$", ""), F.when(F.right(d, F.lit(2)) <= str(pivot), "20").otherwise("19"), F.right(d, F.lit(2)))
    return F.try_to_date(d, "d.M.yyyy")


def guarded(date: Column) -> Column:
    return F.when(F.year(date).between(1990, 2100), date)


def any_dmy(line: Column) -> Column:
    """The first day.month.year of a line with any separator; years of two digits from 70 on are 19xx."""
    raw = F.regexp_extract(line, r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b", 0)
    return guarded(F.when(raw.rlike(r"[.\-/]\d{2}$"), read(raw, "dmyy", 69)).otherwise(read(raw, "dmy")))


def first_date(line: Column, patterns=PATTERNS) -> Column:
    """The date at the earliest place of a line, of any pattern; on a tie the pattern listed first."""
    of = lambda p, form, k: F.transform(found(line, p), lambda r: F.struct(F.call_function("instr", line, r).alias("at"), F.lit(k).alias("k"), read(r, form).alias("d")))
    hits = F.concat(*[of(p, form, k) for k, (p, form) in enumerate(patterns)])
    return F.array_min(F.filter(hits, lambda h: h["d"].isNotNull()))["d"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, a): the lines of a text."""
    return evaluated(docs.where("text is not null"), "doc_id", a=line_array(F.col("text")))


def _solid(docs: DataFrame) -> DataFrame:
    """(doc_id, a): the lines that aren't blank, trimmed."""
    return evaluated(_lines(docs), "doc_id", a=F.transform(F.filter("a", lambda x: x.rlike(r"\S")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def context_score(low: Column, named: bool) -> Column:
    s = lambda cond, n: F.when(cond, n).otherwise(0)
    return F.lit(60 if named else 10) + s(F.contains(low, F.lit("datum")), 40 if named else 50) + s(F.contains(low, F.lit("liefer")), 20 if named else 30) + s(F.contains(low, F.lit("rechnung")), 20) + s(low.rlike(r"\bvom\b"), 35) + s(F.contains(low, F.lit("bericht")), 15)


def report_dates(docs: DataFrame) -> DataFrame:
    """(doc_id, date, score) of inspection reports: a date on or up to two lines below a line that names the report, or on a line with 'vom'."""

    def window(line: Column, i: Column) -> Column:
        low = F.lower(line)
        mark = has(low, BESIDE)
        n = F.when(mark, 3).otherwise(1)

        def one(c: Column, o: Column) -> Column:
            cl = F.lower(c)
            d = F.when(~cl.rlike(EXCLUDED), any_dmy(c))
            score = 100 + F.when(cl.rlike(r"\bvom\b"), 50).otherwise(0) + F.when(mark, 40).otherwise(0) - 5 * o
            return F.struct((-score).alias("s"), (i + o).alias("at"), d.alias("d"))

        return F.when(~low.rlike(EXCLUDED) & (mark | low.rlike(r"\bvom\b")), F.transform(F.slice("a", i + 1, n), one))

    x = _solid(docs.where(has(F.lower("text"), REPORT))).select("doc_id", F.flatten(F.array_compact(F.transform("a", window))).alias("c"))
    x = present(x, "doc_id", b=F.array_min(F.filter("c", lambda c: c["d"].isNotNull())))
    return x.select("doc_id", "b.d", (-F.col("b.s")).alias("score")).withColumnRenamed("d", "date")


def scored_dates(docs: DataFrame) -> DataFrame:
    """(doc_id, date, score, kind): the date of best score by its line's words; excluded lines don't count."""

    def hits(line: Column, i: Column) -> Column:
        low = F.lower(line)

        def of(p: str, form: str, kind: str) -> Column:
            s = -context_score(low, kind == "month_name")
            return F.transform(found(line, p), lambda r: F.struct(s.alias("s"), i.alias("line"), F.call_function("instr", line, r).alias("at"), guarded(read(r, form)).alias("d"), F.lit(kind).alias("kind")))

        parts = [of(PATTERNS[2][0], "dmy", "de"), of(PATTERNS[4][0], "dmy", "de"), of(PATTERNS[0][0], "ymd", "iso"), of(PATTERNS[8][0], "name", "month_name")]
        return F.when(~low.rlike(EXCLUDED), F.filter(F.concat(*parts), lambda h: h["d"].isNotNull()))

    x = present(_lines(docs), "doc_id", b=F.array_min(F.flatten(F.array_compact(F.transform("a", hits)))))
    return x.select("doc_id", F.col("b.d").alias("date"), (-F.col("b.s")).alias("score"), "b.kind")


def best_dates(docs: DataFrame) -> DataFrame:
    """(doc_id, date, reason): the report's date of inspection reports, else the scored one. Scanned twice, joined on the key."""
    r = report_dates(docs).select("doc_id", F.col("date").alias("rdate"))
    s = scored_dates(docs)
    j = s.join(r, "doc_id", "full_outer")
    return j.select("doc_id", F.coalesce("rdate", "date").alias("date"), F.when(F.col("rdate").isNotNull(), "report_date").otherwise(F.concat(F.lit("score_"), F.col("score").cast("string"), F.lit("_type_"), "kind")).alias("reason"))


def first_dates(docs: DataFrame) -> DataFrame:
    """(doc_id, date): the first date anywhere."""
    return present(_lines(docs), "doc_id", date=F.try_element_at(F.filter(F.transform("a", lambda l: first_date(l)), lambda d: d.isNotNull()), F.lit(1)))


def priority_dates(docs: DataFrame) -> DataFrame:
    """(doc_id, date, source): labels in their order of priority; a label's first line and the one after it, else the next label, at last any date."""
    beleg = ("beleg-datum", "belegdatum", "beleg datum")

    def after(line: Column) -> Column:
        low = F.lower(line)
        return F.coalesce(*[F.when(F.contains(low, F.lit(w)), first_date(F.substring(line, F.call_function("instr", low, F.lit(w)) + len(w), F.length(line)))) for w in beleg])

    # only lines with a digit can hold a date
    digit = lambda l, d: F.when(l.rlike("[0-9]"), d)
    x = evaluated(
        _solid(docs), "doc_id", low=F.transform("a", F.lower), any=F.transform("a", lambda l: digit(l, first_date(l))),
        dash=F.transform("a", lambda l: F.when(F.contains(F.lower(l), F.lit("date")), first_date(l, PATTERNS[9:]))), after=F.transform("a", lambda l: F.when(has(F.lower(l), beleg), after(l))),
    )
    places = {}
    for labels, barred in dict.fromkeys((lab, bar) for _, lab, bar, _ in (*PRIORITIES, ("", ("abholdatum", "abhol-datum"), (), ""))):
        places[labels, barred] = f"at{len(places)}"
    spot = lambda labels, barred: F.array_position(F.transform("low", lambda l: has(l, labels) & ~has(l, barred) if barred else has(l, labels)), True).cast("int")
    x = evaluated(x, "doc_id", "any", "dash", "after", **{n: spot(*k) for k, n in places.items()})

    def rule(labels: tuple[str, ...], barred: tuple[str, ...], how: str) -> Column:
        at = F.col(places[labels, barred])
        pick = lambda c: F.coalesce(F.try_element_at(c, at), F.try_element_at(c, at + 1))
        date = pick(F.col(how)) if how != "after" else F.coalesce(pick(F.col("after")), pick(F.col("any")))
        return F.when(at > 0, date)

    # a pick-up date without a date hands over to the order's date
    pickup = F.when((F.col(places[("abholdatum", "abhol-datum"), ()]) > 0) & rule(("abholdatum", "abhol-datum"), (), "any").isNull(), rule(("auftragsdatum",), (), "any"))
    picks = [F.struct(pickup.alias("date"), F.lit("auftragsdatum").alias("source"))] + [F.struct(rule(l, b, h).alias("date"), F.lit(s).alias("source")) for s, l, b, h in PRIORITIES]
    anyway = F.filter("any", lambda d: d.isNotNull())
    picks.append(F.struct(F.when(F.size(anyway) > 0, anyway[0]).alias("date"), F.lit("fallback").alias("source")))
    x = present(x, "doc_id", p=F.try_element_at(F.filter(F.array(*picks), lambda p: p["date"].isNotNull()), F.lit(1)))
    return x.select("doc_id", "p.date", "p.source")


def repaired_digits(line: Column) -> Column:
    """Commas as points, one blank between words, and the letter O between digits and separators as a zero."""
    c = F.regexp_replace(F.replace(line, F.lit(","), F.lit(".")), r"\s+", " ")
    for p in (r"(?<=\d)[oO](?=\d)", r"(?<=\d)[oO](?=[./-])", r"(?<=[./-])[oO](?=\d)"):
        c = F.regexp_replace(c, p, "0")
    return F.trim(c)


def line_candidates(docs: DataFrame, base: float = 0.7) -> DataFrame:
    """(doc_id, line_no, date, raw, label, priority, confidence): every date on a line or the one after it, with the line's label.

    A date is given again for the line before it, as a label may stand above its date.
    """

    def dates(t: Column) -> Column:
        of = lambda p, f: F.transform(found(t, p), lambda r: F.struct(f(r).alias("d"), r.alias("raw")))
        num = lambda r: F.when(r.rlike(r"[.\-/]\d{2}$"), read(r, "dmyy")).otherwise(read(r, "dmy"))
        hits = F.concat(of(PATTERNS[0][0], lambda r: read(r, "ymd")), of(r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b", num), of(PATTERNS[9][0], lambda r: read(r, "name")))
        return F.filter(hits, lambda h: h["d"].isNotNull())

    x = _lines(docs).select("doc_id", "a", F.transform("a", repaired_digits).alias("clean"))
    x = x.select("doc_id", F.posexplode(F.arrays_zip("a", "clean", F.slice(F.concat("clean", F.array(F.lit(""))), 2, F.greatest(F.size("a"), F.lit(1))).alias("next"))).alias("line_no", "z"))
    low = F.lower("z.a")
    x = x.where(F.col("z.a").rlike(r"\S") & ~low.rlike(EXCLUDED))
    x = x.select("doc_id", "line_no", low.alias("low"), F.explode(dates(F.trim(F.concat_ws(" ", "z.clean", "z.next")))).alias("h"))
    vom = F.contains("low", F.lit("vom")) & has(F.col("low"), ("lieferschein", "beleg", "bericht"))
    label = F.coalesce(*[F.when(F.col("low").rlike(p), n) for n, p, _, _ in LABELS], F.when(vom, "vom"), F.lit("generic"))
    x = x.select("doc_id", "line_no", F.col("h.d").alias("date"), F.col("h.raw").alias("raw"), label.alias("label"))
    of = lambda table, default: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.col("label")), F.lit(default))
    bonus = of({n: b for n, _, _, b in LABELS} | {"vom": 0.05}, 0.0)
    return x.select("*", of({n: p for n, _, p, _ in LABELS}, 99).alias("priority"), F.round(F.least(F.lit(base) + bonus, F.lit(0.99)), 4).alias("confidence"))


def context_dates(docs: DataFrame, as_of: str, keep: int = 5, least: float = 0.3, around: int = 50, future_days: int = 30, past_days: int = 730) -> DataFrame:
    """(doc_id, rank, date, label, confidence) of the best dates by the letters around them, seen from a stated day.

    Places of matches are sums of the lengths of what stands between them.
    """
    patterns = ((r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4}\b", "dmy"), (r"\b\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}\b", "any"))

    def places(k: int, p: str, form: str) -> Column:
        t, raws, gaps = F.col("text"), found(F.col("text"), p), F.split("text", p, -1)
        total = lambda arr, n: F.aggregate(F.slice(arr, 1, n), F.lit(0), lambda s, x: s + F.length(x))

        def one(r: Column, i: Column) -> Column:
            at = total(gaps, i + 1) + total(raws, i)
            start = F.greatest(at - around, F.lit(0))
            d = read(r, "dmy") if form == "dmy" else F.try_to_date(F.regexp_replace(r, "[/]", "-"), "yyyy-M-d")
            return F.struct(F.lit(k).alias("k"), at.alias("at"), d.alias("d"), F.lower(F.substring(t, start + 1, at + F.length(r) + around - start)).alias("context"))

        return F.transform(raws, one)

    x = docs.where("text is not null").select("doc_id", F.explode(F.concat(*[places(k, p, f) for k, (p, f) in enumerate(patterns)])).alias("h")).select("doc_id", "h.*").where("d is not null")
    days = F.datediff("d", F.lit(as_of).cast("date"))
    label = F.coalesce(*[F.when(has(F.col("context"), words), n) for n, words in CONTEXT])
    x = x.select("doc_id", "k", "at", "d", label.alias("label"), days.alias("days"))
    score = 0.5 + F.when(F.col("days").between(-past_days, future_days), 0.3).otherwise(-0.5) + F.when(F.col("label").isNotNull(), 0.3).otherwise(0.0) + F.when(F.col("label") == "Rechnungsdatum", 0.2).otherwise(0.0)
    score = score + F.when(F.abs("days") <= 30, 0.1).when(F.abs("days") <= 90, 0.05).otherwise(0.0)
    x = x.withColumn("confidence", F.round(F.least(score, F.lit(1.0)), 4)).where(F.col("confidence") >= least)
    best = x.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "k", "at", "d", "label"))), 1, keep).alias("b"))
    return best.select("doc_id", F.posexplode("b").alias("rank", "b")).select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("b.d").alias("date"), "b.label", (-F.col("b.c")).alias("confidence"))
