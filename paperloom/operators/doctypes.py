"""The type of a document from weighted words in its head, body and foot.

One projection over the array of lines: nothing is shuffled or joined. Defined results: a null text gives no row; an
empty one is SONSTIGES; without any word the confidence is 0.5; of equal scores the type listed first wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import plain_classifier_text, transliterate
from paperloom.operators.extract import line_array
from paperloom.session import evaluated

# The types in their order, and a segment's weight.
RE, LS, UE, KO, PR, OTHER = "RECHNUNG", "LIEFERSCHEIN", "ÜBERNAHMESCHEIN", "KOMMISSIONIERLISTE", "PRÜFBERICHT", "SONSTIGES"
TYPES = (RE, LS, UE, KO, PR)
WEIGHTS = (("header", 2.0), ("body", 1.0), ("footer", 0.5))
# The words of each type with what a hit adds, strong ones first.
TITLE = ("rechnung", "invoice")
NEGATIVE = ("lieferschein", "delivery note", "uebernahmeschein", "übernahmeschein")
LS_STRONG = ("lieferschein", "delivery note", "lieferscheinnummer", "lieferschein-nr", "lieferschein nr", "lieferscheinnr", "l-schein", "l schein", "lieferdatum", "delivery date", "warenempfänger")
UE_STRONG = ("uebernahmeschein", "übernahmeschein", "entsorgungsnachweis", "entsorgung")
WORDS = {
    RE: ((("rechnungsnummer", "rechnungs-nr", "invoice number", "zahlungsziel", "payment terms", "fällig"), 0.18), (("betrag", "netto", "brutto", "summe", "total", "gesamt", "steuer", "tax", "mehrwertsteuer", "mwst", "iban", "bic", "bankverbindung"), 0.05)),
    LS: ((LS_STRONG, 0.35), (("belegnummer", "ls-nr", "ls nr", "versand", "shipment", "warenausgang", "lieferung"), 0.10)),
    UE: ((UE_STRONG, 0.40), (("abfall", "recycling", "container", "tonne", "mulde", "abfallart", "abfallschluessel", "avv-nr", "avv", "kilogramm", "kg", "tonnen", "kubikmeter", "m3", "abholung", "anlieferung"), 0.12)),
    KO: ((("kommissionierliste", "picking list", "kommissionierung", "pickliste", "entnahmeliste", "auftragsliste", "kommissionierauftrag", "picking", "kommission"), 0.25), (("lager", "lagerplatz", "regal", "fach", "position", "entnehmen", "bereitstellen"), 0.10)),
    PR: ((("pruefbericht", "prüfbericht", "untersuchungsbericht", "hauptuntersuchung", "berichts nr", "berichtsnr", "pruefprotokoll", "pruefprotokoll nr", "hu-bericht", "hu bericht"), 0.40), (("sicherheitspruefung", "sicherheitsprüfung", "hu pruefung", "naechste hu", "nächste hu", "stvzo", "§ 29", "maengel", "mängel", "kennz", "kennzeichen", "fahrzeug", "fahrzeugschein", "plakette"), 0.08)),
}
# Marks of an inspection report and of its surroundings.
REPORT_MARKS = ("dekra", "berichts nr", "berichtsnr", "pruefbericht", "untersuchungsbericht", "hauptuntersuchung", "pruefprotokoll", "sicherheitspruefung")
REPORT_CONTEXT = ("naechste hu", "hu pruefung", "kennz", "stvzo", "vom ")
# Suppliers that hint at a type, and those whose papers are always delivery notes.
HINTS = {"Manitowoc": (RE, 0.10), "Dekra": (PR, 0.30)}
ALWAYS_DELIVERY = ("WM", "WM SE", "WMSE")


def _count(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def _list(words: tuple[str, ...], add: float) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("w"), F.lit(plain_classifier_text(w)).alias("k"), F.lit(add).alias("add")) for w in words])


def _hits(words: Column, segment: str, weight: float) -> Column:
    """(word@segment, points) of the words in a segment."""
    return F.transform(F.filter(words, lambda x: F.contains(F.col(segment), x["k"])), lambda x: F.struct(F.concat(x["w"], F.lit(f"@{segment}")).alias("e"), (x["add"] * weight).alias("p")))


def classify(docs: DataFrame, header: int = 35, footer: int = 35) -> DataFrame:
    """docs(doc_id, text, supplier) -> (doc_id, doc_type, confidence, evidence, scores).

    evidence: up to five words of the type; scores: points by type. A document shorter than head and foot together has
    lines in both.
    """
    n = F.size("a")
    # letters are made plain once for the whole text, blanks are squeezed in each part
    x = evaluated(docs.where("text is not null"), "doc_id", "supplier", t=F.regexp_replace(transliterate(F.lower("text")), r"[_:/\\-]+", " "))
    squeezed = lambda c: F.regexp_replace(c, r"\s+", " ")
    x = x.select("doc_id", "supplier", squeezed(F.col("t")).alias("whole"), line_array(F.col("t")).alias("a"))
    part = lambda c: squeezed(F.array_join(c, "\n"))
    x = evaluated(
        x, "doc_id", "supplier", "whole", header=part(F.slice("a", 1, header)), body=part(F.slice("a", header + 1, F.greatest(n - header - footer, F.lit(0)))),
        footer=part(F.slice("a", F.greatest(n - footer, F.lit(0)) + 1, F.lit(footer))),
    )
    both = F.concat_ws(" ", "header", "body")
    title = F.contains("header", F.lit(TITLE[0])) | F.contains("header", F.lit(TITLE[1]))
    report = (_count(both, REPORT_MARKS) >= 2) | ((_count(both, REPORT_MARKS) >= 1) & (_count(both, REPORT_CONTEXT) >= 2))
    x = evaluated(x, "doc_id", "supplier", "whole", "header", "body", "footer", title=title, report=report)

    none = F.array().cast("array<struct<e:string,p:double>>")
    hits = {t: F.concat(*[_hits(_list(words, add), seg, w) for seg, w in WEIGHTS for words, add in WORDS[t]]) for t in TYPES}
    hits[RE] = F.when(F.col("title"), F.concat(_hits(_list(TITLE, 0.45), "header", 2.0), hits[RE])).otherwise(none)
    x = evaluated(x, "doc_id", "supplier", "whole", "header", "body", "title", "report", **hits)

    points = {t: F.aggregate(F.col(t), F.lit(0.0), lambda s, h: s + h["p"]) for t in TYPES}
    negative = reduce(lambda a, b: a + b, [F.contains("whole", F.lit(plain_classifier_text(w))).cast("int") for w in NEGATIVE])
    points[RE] = points[RE] - 0.15 * negative
    points[PR] = points[PR] + F.when(F.col("report"), 0.45).otherwise(0.0)
    for name, (t, add) in HINTS.items():
        points[t] = points[t] + F.when(F.col("supplier") == name, add).otherwise(0.0)
    x = evaluated(x, "doc_id", "supplier", "header", "body", "title", "report", *TYPES, s=F.array(*[F.round(points[t], 6) for t in TYPES]))

    score = {t: F.col("s")[k] for k, t in enumerate(TYPES)}
    top = F.array_max("s")
    best = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.array_position("s", top).cast("int"))
    second = F.element_at(F.sort_array("s", False), 2)
    delivery = (best != LS) & reduce(lambda a, b: a | b, [F.contains("header", F.lit(plain_classifier_text(w))) for w in LS_STRONG]) & ~F.col("title")
    chosen = F.when(delivery, LS).otherwise(best)
    points_of = F.when(delivery, score[LS]).otherwise(top)
    rival = F.when(delivery, top).otherwise(second)
    sure = F.least(F.lit(0.99), 0.55 + F.least(points_of, F.lit(1.0)) * 0.35 + F.greatest(F.lit(0.0), points_of - rival) * 0.25)
    takeover = reduce(lambda a, b: a | b, [F.contains(both, F.lit(plain_classifier_text(w))) for w in UE_STRONG])
    always = F.upper(F.trim("supplier")).isin(*ALWAYS_DELIVERY)
    kind = F.when(always, "always").when(takeover, "takeover").when(F.col("report") & (score[PR] > 0), "report").when(top <= 0, "none").otherwise("best")
    x = evaluated(x, "doc_id", "s", *TYPES, kind=kind, chosen=chosen, sure=sure)
    kind = F.col("kind")
    typed = F.when(kind == "always", LS).when(kind == "takeover", UE).when(kind == "report", PR).when((kind == "none") | (F.round("sure", 6) < 0.60), OTHER).otherwise(F.col("chosen"))
    conf = F.when(kind == "always", 0.99).when(kind == "takeover", F.least(F.lit(0.99), 0.88 + F.least(score[UE], F.lit(1.0)) * 0.10))
    conf = conf.when(kind == "report", F.least(F.lit(0.99), 0.82 + F.least(score[PR], F.lit(1.0)) * 0.12)).when(kind == "none", 0.50).otherwise(F.col("sure"))
    words = lambda t: F.slice(F.transform(F.col(t), lambda h: h["e"]), 1, 5)
    by_type = reduce(lambda acc, t: acc.when(F.col("chosen") == t, words(t)), TYPES[1:], F.when(F.col("chosen") == TYPES[0], words(TYPES[0])))
    evidence = F.when(kind == "always", F.array(F.lit("supplier_hint"))).when(kind == "takeover", words(UE)).when(kind == "report", F.when(F.size(PR) > 0, words(PR)).otherwise(F.array(F.lit("report_pattern"))))
    evidence = evidence.when(kind == "none", F.array(F.lit("no_words"))).otherwise(by_type)
    return x.select("doc_id", typed.alias("doc_type"), F.round(conf, 4).alias("confidence"), F.array_join(evidence, "|").alias("evidence"), *[F.round(score[t], 4).alias(n) for t, n in zip(TYPES, ("re", "ls", "ue", "ko", "pr"))])
