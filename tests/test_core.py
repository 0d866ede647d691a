import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import dates, doctypes, extract, report, store, vectors
from paperloom.sources import readers, sinks
from paperloom.streaming import jobs


def one(spark, col, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(col.alias("x")).first().x


@pytest.mark.parametrize("words,budget", [("a bb ccc dddd", 5), ("", 5), ("   ", 3), ("toolongword b", 4), ("x " * 300, 7)])
def test_word_chunks_against_a_loop(spark, words, budget):
    want, cur = [], ""
    for w in words.split():
        if not cur:
            cur = w
        elif len(cur) + 1 + len(w) <= budget:
            cur += " " + w
        else:
            want.append(cur)
            cur = w
    if cur:
        want.append(cur)
    assert one(spark, X.word_chunks(F.col("t"), budget), t=words) == want


def test_scalar_functions(spark):
    assert one(spark, X.page_ranges(F.col("t")), t="1-3, 5") == [1, 2, 3, 5]
    assert one(spark, X.page_ranges(F.col("t")), t="3-1") is None and one(spark, X.page_ranges(F.col("t")), t="a") is None
    assert tuple(one(spark, X.rate_rule(F.col("t")), t="10/60m")) == (10, 3600) and one(spark, X.rate_rule(F.col("t")), t="x") is None
    assert one(spark, X.confidence(F.col("t")), t="0,85") == 0.85 and one(spark, X.confidence(F.col("t")), t="abc") == 0.0 and one(spark, X.confidence(F.col("t")), t="7") == 1.0
    assert one(spark, X.number_confidence(F.col("t")), t="HIGH") == 0.95
    assert one(spark, X.parse_date(F.col("t")), t="31.02.2026") is None and one(spark, X.parse_date(F.col("t")), t="1.2.2026") == dt.date(2026, 2, 1)
    assert one(spark, X.pivot_year(F.col("t")), t=70) == 1970 and one(spark, X.pivot_year(F.col("t")), t=69) == 2069
    assert one(spark, X.safe_filename(F.col("t")), t=" Müller & Söhne / GmbH ") == "Mueller_Soehne_GmbH" and one(spark, X.safe_filename(F.col("t")), t="??") == "Unbekannt"
    assert one(spark, X.month_folder(F.to_date("t"), "B"), t="2024-03-05") == "März 2024"
    assert one(spark, X.render("{supplier}_{date}_{doc_number}", {"supplier": F.col("t"), "date": F.lit(None).cast("string"), "doc_number": F.lit("7")}), t="A") == "A_7"
    with pytest.raises(ValueError):
        X.render("{nope}", {})
    assert one(spark, X.error_type(F.col("t")), t="Value Error: x") == "Value_Error"
    assert one(spark, X.trigrams(F.col("t")), t="ab") == [] and one(spark, X.jaccard(X.trigrams(F.col("t")), X.trigrams(F.col("t"))), t="abcd") == 1.0
    assert tuple(one(spark, X.norm_box(F.lit(0), F.lit(0), F.lit(0), F.lit(5), F.lit(10), F.lit(10)), t="")) == (0, 0, 1, 500)
    assert one(spark, extract_stem(), t="a/b/Mueller_GmbH_03-04-2024_77.pdf") == ("Mueller_GmbH", dt.date(2024, 4, 3), "77")


def extract_stem():
    return readers.stem_parts(F.col("t"))


def test_lines_segments_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\r\nb c\n", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, line string")
    got = [(r.doc_id, r.line_no, r.line) for r in extract.lines(docs).orderBy("doc_id", "line_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    seg = extract.segments(docs, 2, 2).groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in seg} == {"header": 2, "footer": 2}
    assert doctypes.classify(docs.withColumn("supplier", F.lit(None).cast("string"))).where("doc_type <> 'SONSTIGES'").count() == 0
    assert dates.best_dates(docs.limit(0)).count() == 0
    block = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Kopf", "z. Hd. A", "Weg 1", " ", "Text"])], "doc_id long, line_no int, line string")
    assert [r.line for r in extract.recipient_block(block).orderBy("line_no").collect()] == ["z. Hd. A", "Weg 1"]


def test_contained_names(spark):
    docs = spark.createDataFrame([(1, "Bei Müller Glas GmbH bestellt"), (2, None), (3, "nichts")], "doc_id long, text string")
    dim = spark.createDataFrame([(7, "Mueller Glas"), (5, "Glas GmbH"), (6, None), (8, "")], "name_id long, name string")
    assert [tuple(r) for r in extract.contained_names(docs, dim).collect()] == [(1, 5, 2)]
    assert extract.contained_names(docs, dim.limit(0)).count() == 0


def test_state(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n")], "k string, t int, v string")
    assert sorted(r.v for r in store.latest(df, ["k"], ["t", "v"]).collect()) == ["n", "z"]
    assert store.latest(df.limit(0), ["k"], ["t"]).count() == 0
    kv = store.kv_upsert(df.selectExpr("k key", "v value", "t updated_at"), spark.createDataFrame([("a", "new", 2)], "key string, value string, updated_at int"))
    assert {r.key: r.value for r in kv.collect()} == {"a": "new", None: "n"}
    names = spark.createDataFrame([("d", "a.pdf", i) for i in range(3)] + [("d", "b", 9)], "dir string, name string, o int")
    assert sorted(r.unique_name for r in store.unique_names(names, "dir", "name", "o").collect()) == ["a.pdf", "a_01.pdf", "a_02.pdf", "b"]
    old = spark.createDataFrame([("k1", 1, "old", "keep")], "k string, ord int, v string, w string")
    new = spark.createDataFrame([("k1", 9, "new", "no"), ("k2", 10, "add", "w2")], "k string, ord int, v string, w string")
    got = sorted(tuple(r) for r in store.merge_results(old, new, "k", ["w"]).select("k", "ord", "v", "w", "side").collect())
    assert got == [("k1", 1, "new", "keep", 0), ("k2", 10, "add", "w2", 1)]


def test_reports(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b", "a") for i in range(10)], "x double, t string, g string")
    p = report.percentiles(df, ["x"]).first()
    assert (p.n, p.p50) == (10, 4.5)
    assert report.nearest_rank(df.withColumn("k", F.lit(1)), "k", "x", 0.95).first().value == 9.0
    c = report.classification(df, "t", "g").first()
    assert (c.n_labels, c.accuracy, c.macro_recall) == (2, 0.5, 0.5)
    assert report.percentiles(df.limit(0), ["x"]).count() == 0


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5)).astype("float32")
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(m)] + [(60, None, 0), (61, [], 0), (62, [0.0] * 5, 0), (63, [1.0], 0), (0, [float(x) for x in m[0]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.top_k(df.where("vec_id % 20 = 0 and vec_id < 60"), df, 3).collect()}
    for q in (0, 20, 40):
        want = [int(i) for i in np.lexsort((np.arange(60), -s[q])) if i != q][:3]
        assert [got[q, k] for k in (1, 2, 3)] == want
    st = vectors.pair_statistics(df.where("vec_id between 1 and 59")).first()
    c = (u @ u.T)[1:60, 1:60]
    assert abs(st["mean"] - c.mean()) < 1e-5 and abs(st["std"] - c.std()) < 1e-5
    assert vectors.top_k(df.limit(0), df, 3).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\nbroken\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, v string").count() == 2
    (tmp_path / "run.csv").write_text("a,b\n1,x\noops,y\n")
    assert [r.a for r in readers.run_log(spark, str(tmp_path / "run.csv"), "a int, b string").collect()] == [1, None]
    for n in ("x.pdf", "y.PDF", "z.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert readers.pdf_folder(spark, str(tmp_path)).count() == 2
    kvs = spark.createDataFrame([("a", "{bad"), ("b", '{"x": 1}')], "key string, value_json string")
    assert readers.kv(kvs, "a", '{"d": 0}').selectExpr("variant_get(value, '$.d', 'int') v").first().v == 0
    assert readers.kv(kvs, "b", "{}").selectExpr("variant_get(value, '$.x', 'int') v").first().v == 1
    h = spark.createDataFrame([(1, "t", '{"a": 1}'), (2, "t", "[1]"), (3, "t", "no"), (4, "t", None)], "id long, ts string, payload_json string")
    assert [r.id for r in readers.history(h).collect()] == [1]
    env = spark.createDataFrame([("A=1",), ("# c",), ("export B='x y'",)], "value string")
    assert {r.key: r.value for r in readers.settings(env).collect()} == {"A": "1", "B": "x y"}
    cells = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 2, " b\nc"), (1, 0, 1, 0, None)], "doc_id long, table_no int, row_no int, col_no int, cell string")
    assert [r.row for r in readers.cells_to_rows(cells).collect()] == [["a", "", "b c"]]
    sinks.export_csv(spark.createDataFrame([("x", None)], "a string, b string").coalesce(1), str(tmp_path / "out"), {"a": "Firma", "b": "Datum"})
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"x;" in raw and raw.endswith(b"\r\n")
    t = sinks.truth_samples(spark.createDataFrame([("e", " ", "L"), ("e", "f", "")], "a string, b string, lab string"), ["a", "b"], ["lab"])
    assert [(r.text, r.lab) for r in t.collect()] == [("e", "L")]


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i % 3, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=7 * i), "click", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double")
    df.write.json(str(src))
    schema = "user_id long, ts timestamp_ntz, event_type string, value double"
    stream = jobs.inbox(spark, str(src), schema)
    jobs.start(jobs.usage(stream), "usage", "complete", str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(map(tuple, spark.table("usage").collect())) == sorted(map(tuple, jobs.usage(df).collect()))
    jobs.start(jobs.rates(stream, "30 minutes", "10 minutes"), "rates", "complete", str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, jobs.rates(df, "30 minutes", "10 minutes").collect()))
    jobs.start(jobs.rate_limited(stream, 2, 3600), "limited", "append", str(tmp_path / "c3")).awaitTermination(120)
    got = spark.table("limited")
    assert got.count() == 40
    want = {}
    for u, t, *_ in rows:
        o, n = want.get(u, (None, 0))
        if o is None or (t - o).total_seconds() >= 3600:
            o, n = t, 0
        want[u] = (o, n + 1)
        want.setdefault("blocked", 0)
        want["blocked"] += n + 1 > 2
    assert got.where("not allowed").count() == want["blocked"]


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['paperloom.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p6_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


@pytest.mark.parametrize(
    "line,date,score",
    [
        ("Rechnung Nr. 4711   Datum: 31. Oktober 2021", "2021-10-31", 120), ("Liste 3. Sept. 1999", "1999-09-03", 60), ("Auftrag vom 1.3.2024, bezahlt 02.02.2024", "2024-03-01", 45),
        ("Date : 27/01/2024", "2024-01-27", 10), ("Lieferdatum 05.03.2020", "2020-03-05", 90), ("EZ 05.03.2020", None, None), ("Nächste HU 05.03.2020", None, None), ("Tel. 06.10.05.24.09", None, None), ("Zeichnung 31. Postfach 2021", None, None),
    ],
)
def test_dates_of_all_shapes(spark, line, date, score):
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    got = [(str(r.date), r.score) for r in dates.scored_dates(docs).collect()]
    assert got == ([(date, score)] if score else [])


def test_names_stay_unique(spark):
    rows = [("d", "h.pdf", i) for i in range(105)] + [("d", n, 200 + i) for i, n in enumerate(["scan.pdf", "scan.pdf", "scan_01.pdf", "scan.pdf", "scan_01.pdf"])] + [("e", "scan_01.pdf", 300), ("e", None, 301), (None, "a", 302), (None, "a", 303)]
    got = {r.o: r.unique_name for r in store.unique_names(spark.createDataFrame(rows, "dir string, name string, o int"), "dir", "name", "o").collect()}
    assert [got[i] for i in (0, 10, 99, 100, 104)] == ["h.pdf", "h_10.pdf", "h_99.pdf", "h_100.pdf", "h_104.pdf"]
    assert [got[200 + i] for i in range(5)] == ["scan.pdf", "scan_01.pdf", "scan_01_01.pdf", "scan_02.pdf", "scan_01_02.pdf"]
    assert [got[i] for i in (300, 301, 302, 303)] == ["scan_01.pdf", None, "a", "a_01"] and len(got) == len(rows)
