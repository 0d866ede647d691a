import random
import uuid

from pyspark.sql import functions as F

from paperloom.llm import history

UP = "upload_id long, batch_no int, owner_scope string, sha256 string, doc_id long"


def letter(k, tail=""):
    return f"Firma Glas GmbH\n\nRechnung Nr. 4711{k:04d}99 vom 01.02.2024\n\nDie Lieferung {k:04d}8877 der Position Kugelhahn erfolgte wie vereinbart. Wir danken für den Auftrag 55{k:04d}1.\nFreundliche Grüße{tail}"


def test_a_batch_needs_its_own_texts_only(spark):
    h = history.History(spark, uuid.uuid4().hex, buckets=4)
    feats = lambda rows: history.text_features(spark.createDataFrame(rows, "doc_id long, text string"))
    one = h.accept(spark.createDataFrame([(1, 0, "a", "s1", 1), (2, 0, "a", "s2", 2)], UP), feats([(1, letter(1)), (2, letter(2))]))
    assert one.count() == 0
    # opened again by its name; the texts of the first batch are no argument any more
    h = history.History(spark, h.name)
    assert h.buckets == 4 and not h.fresh
    two = h.accept(spark.createDataFrame([(3, 1, "a", "s3", 3), (4, 1, "b", "s1", 4), (5, 1, "a", "S2 ", 5)], UP), feats([(3, letter(1).replace("danken", "dankcn")), (4, letter(1)), (5, letter(5))]))
    assert {tuple(r) for r in two.collect()} == {(1, 3), (2, 5)}
    # 6 has the file of 1 and the text of 2, so both are one paper from now on; 7 is a copy of what 5 brought
    three = h.accept(spark.createDataFrame([(6, 2, "a", "s1", 6)], UP), feats([(6, letter(2))]))
    assert {tuple(r) for r in three.collect()} == {(1, 6)}
    four = h.accept(spark.createDataFrame([(7, 3, "a", "s7", 7), (8, 3, "a", "s2", None)], UP), feats([(7, letter(5))]))
    assert {tuple(r) for r in four.collect()} == {(1, 7), (1, 8)}
    assert h.accept(spark.createDataFrame([], UP), feats([(1, "x")]).limit(0)).count() == 0
    h.drop()
    assert not [t for t in spark.catalog.listTables() if h.name in t.name]


def plain(rows, docs):
    """All pairs by the stated rule, then connected parts."""
    f = {r.doc_id: r for r in docs}
    top = {i: i for i, *_ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    def same(x, y):
        if x[2] is None or x[2] != y[2]:
            return False
        if x[3] is not None and x[3] == y[3]:
            return True
        a, b = f.get(x[4]), f.get(y[4])
        share = lambda p, q: len({*p} & {*q}) >= history.COVER * min(len(p), len(q))
        return bool(a and b and (a.content == b.content or (a["keys"] and b["keys"] and {*a["keys"]} & {*b["keys"]} and share(a["keys"], b["keys"]) and share(a.paras, b.paras))))

    for n, x in enumerate(rows):
        for y in rows[:n]:
            if same(x, y) and find(x[0]) != find(y[0]):
                a, b = sorted((find(x[0]), find(y[0])))
                top[b] = a
    return {i: find(i) for i, *_ in rows}


def test_against_all_pairs_and_in_any_batches(spark):
    r = random.Random(5)
    pool = [f"Absatz {w} steht hier in voller Länge" for w in "abcdefghijklmnopqrst"] + [f"Die Position {n} wurde geliefert" for n in range(471100, 471118)]
    docs = [(i, "\n".join(r.sample(pool, r.randint(1, 6)))) for i in range(90)]
    docs += [(100 + i, "\n".join([*t.split("\n")[: r.randint(1, 9)], r.choice(pool)])) for i, t in r.sample(docs, 60)]
    rows = [(i, i // 40, r.choice("aab"), r.choice([None, f"f{r.randint(0, 200)}"]), d) for i, (d, _) in enumerate(r.sample(docs, len(docs)))]
    u, d = spark.createDataFrame(rows, UP), spark.createDataFrame(docs, "doc_id long, text string")
    part = plain(rows, history.text_features(d).collect())
    want = {(part[i], i) for i, b, *_ in rows if b >= 1 and part[i] < i}
    assert len(want) > 30
    assert {tuple(x) for x in history.find_copies(u, d).collect()} == want
    h, feats = history.History(spark, uuid.uuid4().hex), history.text_features(d)
    last = {}
    for b in range(4):
        got = h.accept(u.where(f"batch_no = {b}"), feats.join(u.where(f"batch_no = {b}").select("doc_id"), "doc_id", "left_semi")).collect()
        last |= {x.upload_id: x.first_upload_id for x in got}
    h.drop()
    # what a batch is told is the paper as known by then, so never a later merge, and always of the same part
    assert {i for i in last if rows[i][1] >= 1} <= {i for _, i in want} and all(part[a] == part[i] for i, a in last.items())


def test_one_number_on_every_letter_of_a_site(spark):
    head = "Glasbau Meier GmbH, USt-IdNr. DE603730385, Telefon 030 23125946"
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(head + "\n"), F.expr("concat('Betrifft Ihre Anfrage ', sha1(cast(id as string)), '\\n', 'Antwort dazu: ', md5(cast(id as string)))")).alias("text"))
    u = docs.select(F.col("doc_id").alias("upload_id"), F.expr("cast(doc_id % 3 as int) as batch_no"), F.lit("a").alias("owner_scope"), F.concat(F.lit("f"), "doc_id").alias("sha256"), "doc_id")
    assert history.find_copies(u, docs).count() == 0


def test_letters_that_share_only_the_letterhead(spark):
    head = "Glasbau Meier GmbH, USt-IdNr. DE603730385\nTelefon 030 23125946, Konto 4711223344\n"
    docs = [(1, head + "Wir danken für Ihre Bestellung.\nDie Ware kommt am Montag bei Ihnen an.\nBitte halten Sie das Tor frei."), (2, head + "Ihre Mahnung ist bei uns eingegangen.\nDer Betrag wurde schon überwiesen.\nWir bitten um Prüfung.")]
    u = [(i, i - 1, "a", f"s{i}", i) for i in (1, 2)]
    assert history.find_copies(spark.createDataFrame(u, UP), spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_a_text_is_folded_and_searched_once(spark):
    docs = spark.createDataFrame([(1, "Firma Glas.  Auftrag 4711223344\n\nEnde"), (2, "\n . "), (3, None)], "doc_id long, text string")
    f = history.text_features(docs)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    # the planner may copy an expression into the filter and into each place that uses it
    assert [plan.count(x) for x in ("translate(", "regexp_extract_all(", history._BREAKS)] == [1, 1, 1]
    assert [(r.doc_id, len(r["keys"]), len(r.paras)) for r in f.collect()] == [(1, 1, 1)]
