import pytest
from pyspark.sql import functions as F

from paperloom.operators import dates, doctypes, keep, numbers, report, store, suppliers, vectors

DOC = "doc_id long, text string"


def docs(spark, *texts, **more):
    df = spark.createDataFrame([*enumerate(texts)], DOC)
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v).cast("string"))
    return df


def test_report_dates_stand_near_their_words(spark):
    text = "Erstzulassung 01.01.2001\nUntersuchungsbericht 17\nfür das Fahrzeug\n04.05.2021 in Tarnau\nvom 03.02.2020"
    got = dates.report_dates(docs(spark, text, "Rechnung vom 01.02.2020", None, "")).collect()
    assert [(r.doc_id, str(r.date), r.score) for r in got] == [(0, "2020-02-03", 150)]
    assert [str(r.date) for r in dates.best_dates(docs(spark, text, "Datum 01.02.2020")).orderBy("doc_id").collect()] == ["2020-02-03", "2020-02-01"]


def test_labels_in_their_order(spark):
    texts = ["Datum: 01.01.2020\nLieferdatum:\n02.02.2020", "Abholdatum offen\nAuftragsdatum 03.03.2021\nLieferdatum 04.04.2021", "Beleg-Datum alt 1.1.1999 neu\nRest", "am 5. Mai 2022 hier", "document date 06-Jun-2020", "nichts", None]
    got = {r.doc_id: (str(r.date), r.source) for r in dates.priority_dates(docs(spark, *texts)).collect()}
    # a pick-up date takes the next line's date, so the order's date comes only where there is none
    assert got == {0: ("2020-02-02", "lieferdatum"), 1: ("2021-04-04", "lieferdatum"), 2: ("1999-01-01", "belegdatum"), 3: ("2022-05-05", "fallback"), 4: ("2020-06-06", "datum")}
    assert [str(r.date) for r in dates.first_dates(docs(spark, "31.02.2020 dann 1/2/99 und 2020-01-01")).collect()] == ["1999-02-01"]


def test_line_candidates_and_context(spark):
    got = dates.line_candidates(docs(spark, "Lieferdatum\nO1.1O.2O20"), 0.7).collect()
    assert [(r.line_no, str(r.date), r.label, r.priority, r.confidence) for r in got if r.date] == []
    got = dates.line_candidates(docs(spark, "Lieferdatum\n1,1O,2O20 x"), 0.7).collect()
    assert sorted((r.line_no, str(r.date), r.label, r.priority, r.confidence) for r in got) == [(0, "2020-10-01", "lieferdatum", 1, 0.9), (1, "2020-10-01", "generic", 99, 0.7)]
    far = "x" * 60
    got = dates.context_dates(docs(spark, f"rechnung 01.06.2024 {far} 2010-01-01 {far} due 20/05/2024"), "2024-06-01").collect()
    assert [(r["rank"], str(r.date), r.label, r.confidence) for r in got] == [(1, "2024-06-01", "Rechnungsdatum", 1.0), (2, "2024-05-20", "Fälligkeitsdatum", 1.0)]


def test_types(spark):
    body = "\n" * 40
    texts = ["Rechnung 4711\nRechnungsnummer 12\nIBAN" + body, "Brief" + body + "Rechnung" + body, "Lieferschein 5\nIhre Rechnung folgt", "Übernahmeschein Abfall 3 Tonnen", "DEKRA Prüfbericht vom 1.1.2020", "", None]
    got = {r.doc_id: r for r in doctypes.classify(docs(spark, *texts, supplier=None)).collect()}
    assert [got[k].doc_type for k in range(6)] == ["RECHNUNG", "SONSTIGES", "LIEFERSCHEIN", "ÜBERNAHMESCHEIN", "PRÜFBERICHT", "SONSTIGES"] and 6 not in got
    assert got[5].confidence == 0.5 and got[3].evidence.startswith("uebernahmeschein@header|übernahmeschein@header")
    assert [(r.doc_type, r.confidence) for r in doctypes.classify(docs(spark, "irgendwas", supplier="WM se")).collect()] == [("LIEFERSCHEIN", 0.99)]


def test_numbers(spark):
    texts = ["KD-NR.  Lieferschein-Nr  Datum\n325708  3969013  30.03.26", "Lieferschein Nr: LS20250982", "Datum Beleg-Nr 99887766\nBelegnummer\nRE2025X9 steht hier", "Lieferschein - Nr.\n\nAB123456", "ohne Nummer", "", None]
    df = docs(spark, *texts, supplier=None, doc_type=None)
    got = {r.doc_id: (r.number, r.field, r.confidence) for r in numbers.document_numbers(df).collect()}
    assert got[0] == ("3969013", "Lieferschein-Nr", "medium") and got[1][0] == "LS20250982" and got[2][:2] == ("RE2025X9", "Belegnummer") and got[3][0] == "AB123456" and not {4, 5, 6} & {*got}
    mine = {"A": numbers.Fields(("Vorgang",), ("Nummer",), {"rechnung": (("Kennung",), ())})}
    one = lambda s, d: [tuple(r)[1:] for r in numbers.document_numbers(docs(spark, "Nummer 777001\nKennung 888001\nVorgang 999001", supplier=s, doc_type=d), mine, ("Rechnung",)).collect()]
    assert one("A", None) == [("999001", "Vorgang", "high")] and one("A", "RECHNUNG") == [("888001", "Kennung", "high")] and one("B", None) == []
    assert numbers.search_order(("ab", "xy-re", "re-xy", "abcdefg"), "RECHNUNG") == ["abcdefg", "re-xy", "xy-re", "ab"]
    plates = {r.doc_id: (r.plate, r.tier) for r in numbers.plates(docs(spark, "AB-C 99\nKennzeichen:\nSÖ - FB 1494", "Glas GMBH 22\nVOM 06\nB X 123", "SOFB1282", None)).collect()}
    assert plates == {0: ("SOE-FB1494", 1), 1: ("B-X123", 2), 2: ("SOF-B1282", 3)}


def test_supplier_cascade(spark):
    names = spark.createDataFrame([(1, "MÜLLER glas", "x"), (2, "müller glas gmbh & c", "x"), (3, "abc pattern xyz", "x"), (4, "Hof 12", "bei Meincke"), (5, "Hof 12", "sonst"), (6, None, "x"), (7, " ", "x")], "rec_id long, raw string, full_text string")
    al = spark.createDataFrame([(1, "Müller", "Mueller-Glas"), (2, "Müller", "Müller Glas GmbH & Co"), (3, "Z", None)], "ord int, canonical string, alias string")
    pa = spark.createDataFrame([(1, "P", r"(?i)PATTERN\s")], "ord int, canonical string, pattern string")
    cx = spark.createDataFrame([(1, "H", "hof", "MEINCKE")], "ord int, canonical string, trigger string, word string")
    got = {r.rec_id: (r.canonical, r.match_type, r.confidence) for r in suppliers.canonicalise(names, al, pa, cx).collect()}
    assert got == {1: ("Müller", "exact", 0.95), 2: ("Müller", "substring", 0.85), 3: ("P", "regex", 0.9), 4: ("H", "context", 0.75)}
    assert suppliers.canonicalise(names, al.limit(0), pa.limit(0), cx.limit(0)).count() == 0
    known = spark.createDataFrame([(1, "Glasbau Meier", ["GBM"]), (2, "Holz Bock", None)], "name_id long, name string, aliases array<string>")
    got = [tuple(r) for r in suppliers.fingerprints(docs(spark, "Rechnung der Glasbau Meier, Bock", None, ""), known).collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == 1.0
    blocked = spark.createDataFrame([("Meier",), (None,)], "word string")
    assert [r.canonical for r in suppliers.without_blocked(spark.createDataFrame([("Glas Meier",), ("Holz",), (None,)], "canonical string"), blocked).collect()] == ["Holz", None]


def test_kept_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "id long, s string")
    ids = spark.createDataFrame([(2,), (2,), (9,), (None,)], "id long")
    changed, done = keep.bulk_update(rows, ids, "id", "s", F.lit("z"))
    assert sorted(r.s for r in changed.collect()) == ["a", "n", "z", "z"] and sorted(map(tuple, done.collect())) == [(2, True), (9, False)]
    assert sorted(r.s for r in keep.bulk_delete(rows, ids, "id").collect()) == ["a", "n"]
    r = spark.createDataFrame([("x",), ('```json\n{"supplier": " A  B ", "date": "1.2.2020", "doc_type": "rechnung"}\n```',), (None,), ("{broken",)], "t string").select(keep.suggestion(F.col("t")).alias("s")).collect()
    assert [x.s.error for x in r] == ["no_json", None, "no_json", "no_json"] and (r[1].s.supplier, str(r[1].s.date), r[1].s.doc_type) == ("A B", "2020-02-01", "RECHNUNG")
    pairs = spark.createDataFrame([(f"p{i}", "abc"[i % 3]) for i in range(60)], "path string, supplier string")
    neg = keep.negatives(pairs, 2, 1).collect()
    who = {f"p{i}": "abc"[i % 3] for i in range(60)}
    assert neg and all(who[x.other] != x.supplier and x.other != x.path for x in neg)
    with pytest.raises(ValueError):
        keep.sorted_results(rows, "other", {}, "id", 5)
    q = spark.createDataFrame([(g, i) for g in ("a", None) for i in (5, 70_000, 140_000, 9)], "g string, id long").withColumn("id", F.col("id") + F.when(F.col("g").isNull(), 1).otherwise(0))
    got = dict(map(tuple, store.next_in_list(q, "g", "id").collect()))
    assert got == {5: 9, 9: 70_000, 70_000: 140_000, 140_000: 5, 6: 10, 10: 70_001, 70_001: 140_001, 140_001: 6}


def test_percentiles_of_many_values(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("x"), F.lit("g").alias("g"))
    v = sorted(i * 7919 % 5003 for i in range(5000))
    p = report.percentiles(df, ["x"]).first()
    at = lambda q: v[int(q * 4999)] + (v[min(int(q * 4999) + 1, 4999)] - v[int(q * 4999)]) * (q * 4999 - int(q * 4999))
    assert abs(p.p50 - at(0.5)) < 1e-5 and abs(p.p95 - at(0.95)) < 1e-5 and abs(p.p99 - at(0.99)) < 1e-5
    assert report.nearest_rank(df, "g", "x", 0.95).first().value == v[4750]


def test_vectors_of_mixed_lengths(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0] if i % 2 else [float(i + 1), 1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<float>")
    got = vectors.top_k(df, df, 3).collect()
    assert len(got) == 60 and all(r.query_id % 2 == r.vec_id % 2 for r in got)
