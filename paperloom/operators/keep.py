"""Small changes to kept rows: deletes, restores, undo, preferences, filters, work lists, lookups. Each returns a new frame.

Rows are changed by joins on their key, never one by one. Defined results: null keys match nothing; a repeated key in a
list counts once; ties are broken by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bulk_update(rows: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the column set for the listed ids, one row per different id with `done`: whether it was there)."""
    want = ids.where(F.col(key).isNotNull()).select(key).distinct()
    changed = rows.join(want.withColumn("__hit", F.lit(True)), key, "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit")
    there = rows.select(key).distinct().withColumn("done", F.lit(True))
    return changed, want.join(there, key, "left").select(key, F.coalesce("done", F.lit(False)).alias("done"))


def bulk_delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def visible(rows: DataFrame, owner: str, scope: str) -> DataFrame:
    """Rows of a scope and rows without an owner."""
    return rows.where((F.coalesce(F.trim(F.col(owner)), F.lit("")) == "") | (F.col(owner) == scope))


def trash(rows: DataFrame, key: str, events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """rows with `state`: live, trash or gone. events(key, kind, at): delete, restore, purge; the last one counts.

    What lies in the trash for more than so many days, or since a time that can't be read, is gone.
    """
    last = events.groupBy(key).agg(F.max(F.struct(F.col("at").isNotNull(), "at", "kind")).alias("e")).select(key, "e.kind", F.col("e.at").alias("at"))
    fresh = F.coalesce(F.col("at") >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"), F.lit(False))
    state = F.when(F.col("kind") == "purge", "gone").when((F.col("kind") == "delete") & fresh, "trash").when(F.col("kind") == "delete", "gone").otherwise("live")
    return rows.join(last, key, "left").withColumn("state", state).drop("kind", "at")


def undo_last(events: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """The inverse of each scope's latest event that isn't itself an undo: before and after swapped, kind 'undo'."""
    cols = ["before", "after", *[c for c in events.columns if c not in (scope, "before", "after", "kind")]]
    last = events.where("kind <> 'undo'").groupBy(scope).agg(F.max(F.struct(*order, F.struct(*cols).alias("row"))).alias("b"))
    return last.select(scope, F.col("b.row.after").alias("before"), F.col("b.row.before").alias("after"), F.lit("undo").alias("kind"))


def preferences(stored: DataFrame, defaults: dict[str, object], allowed: dict[str, tuple] | None = None) -> DataFrame:
    """stored(scope, prefs: JSON text) -> (scope, one column per preference): values of the wrong type or not allowed fall back to the default."""
    types = {bool: "boolean", int: "long", float: "double", str: "string"}
    out = []
    for name, default in defaults.items():
        v = F.get_json_object("prefs", f"$.{name}")
        v = v if isinstance(default, str) else v.try_cast(types[type(default)])
        if allowed and name in allowed:
            v = F.when(v.isin(*allowed[name]), v)
        out.append(F.coalesce(v, F.lit(default)).alias(name))
    return stored.select("scope", *out)


def insert_if_absent(current: DataFrame, new: DataFrame, key: str, norm) -> DataFrame:
    """new rows whose normal key isn't there yet, the first of each key by its value."""
    k = new.withColumn("__k", norm(F.col(key))).where("__k is not null")
    one = k.groupBy("__k").agg(F.min(F.struct(*new.columns)).alias("r"))
    return one.join(current.select(norm(F.col(key)).alias("__k")).distinct(), "__k", "left_anti").select("r.*")


def result_key(out: Column, path: Column, original: Column, row: Column) -> Column:
    """The key that results are merged on: the first of their names that isn't blank."""
    of = lambda p, c: F.concat(F.lit(p), F.nullif(F.trim(c), F.lit("")))
    return F.coalesce(of("out:", out), of("path:", path), of("original:", original), F.concat(F.lit("row:"), row.cast("string")))


# The orders that a list of results can be shown in.
SORTS = {"file_asc": [F.asc_nulls_last], "supplier_asc": [F.asc_nulls_last], "date_desc": [F.desc_nulls_last], "date_asc": [F.asc_nulls_last]}


def sorted_results(rows: DataFrame, mode: str, columns: dict[str, str], key: str, limit: int) -> DataFrame:
    """The first rows in one of the orders of SORTS; an unknown order is refused. The limit is the page that is shown."""
    if mode not in SORTS:
        raise ValueError(mode)
    return rows.orderBy(SORTS[mode][0](F.col(columns[mode.split("_")[0]])), key).limit(limit)


def enrich(rows: DataFrame, profiles: DataFrame, name: str, norm) -> DataFrame:
    """rows with their supplier's profile: its type and least confidence where it has them, `profiled` telling which were found.

    profiles(name, doc_type, least); the profile of the greatest name counts where several have one normal name.
    """
    p = profiles.withColumn("__k", norm(F.col("name"))).where("__k <> ''").groupBy("__k").agg(F.max(F.struct("name", "doc_type", "least")).alias("p"))
    j = rows.withColumn("__k", norm(F.col(name))).join(p, "__k", "left")
    return j.select(*[c for c in rows.columns if c not in ("doc_type", "least")], F.coalesce("p.doc_type", "doc_type").alias("doc_type"), F.coalesce("p.least", F.lit(0.85)).alias("least"), F.col("p").isNotNull().alias("profiled"))


def table_summary(cells: DataFrame, rows_shown: int = 10) -> DataFrame:
    """cells(doc_id, table_no, row_no, col_no, cell) -> (doc_id, table_no, n_rows, text): the first rows as 'a | b', blank cells kept, empty rows dropped."""
    clean = F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"\s+", " "))
    r = cells.groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", clean.alias("c")))).alias("cs"))
    r = r.select("doc_id", "table_no", "row_no", F.transform("cs", lambda x: x["c"]).alias("row")).where(F.exists("row", lambda c: c != ""))
    g = r.groupBy("doc_id", "table_no").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("row_no", F.array_join("row", " | ").alias("t")))).alias("rs"))
    return g.select("doc_id", "table_no", "n_rows", F.array_join(F.transform(F.slice("rs", 1, rows_shown), lambda x: x["t"]), "\n").alias("text"))


def reply_object(reply: Column) -> Column:
    """The JSON object in a model's reply: without code fences, from the first brace to the last; null when it is none."""
    t = F.regexp_replace(reply, r"(?m)^\s*```[A-Za-z]*\s*$", "")
    o = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(o).isNotNull(), o)


def suggestion(reply: Column) -> Column:
    """(supplier, doc_type, number, date, error) of a reply; the error is no_json, or null. Dates are read in four forms."""
    o = reply_object(reply)
    f = lambda k: F.nullif(F.trim(F.regexp_replace(F.get_json_object(o, f"$.{k}"), r"\s+", " ")), F.lit(""))
    date = F.coalesce(*[F.try_to_date(f("date"), p) for p in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "yyyy/M/d")])
    return F.struct(f("supplier").alias("supplier"), F.upper(f("doc_type")).alias("doc_type"), F.regexp_replace(f("doc_number"), r"\s", "").alias("number"), date.alias("date"), F.when(o.isNull(), "no_json").alias("error"))


def sentence_chunks(text: Column, budget: int) -> Column:
    """Greedy chunks of whole sentences within so many words; a longer sentence is a chunk of its own."""
    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("open"))

    def put(acc: Column, s: Column) -> Column:
        n = words(s)
        return F.when((acc["open"] == 0) | (acc["open"] + n <= budget), F.struct(acc["done"].alias("done"), (acc["open"] + n).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), n.alias("open")))

    return F.aggregate(parts, start, put, lambda acc: F.when(acc["open"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


#: Documents in a stretch of the ring of negatives, about.
STRETCH = 10_000


def negatives(pairs: DataFrame, k: int, seed: int) -> DataFrame:
    """pairs(path, supplier) -> (path, supplier, other, rank): k other documents of other suppliers for each, drawn by hash.

    Documents stand on a ring in the order of a hash; each takes the next ones of other suppliers within its stretch of
    the ring, so no pair of all documents is made. Where the stretch has too few, fewer are given.
    """
    from pyspark.sql import Window

    cells = max(1, pairs.count() // STRETCH)
    h = pairs.select("path", "supplier", F.xxhash64(F.lit(seed), "path").alias("h")).withColumn("cell", F.expr(f"pmod(h, {cells})"))
    w = Window.partitionBy("cell").orderBy("h", "path")
    near = F.collect_list(F.struct(F.col("path").alias("p"), F.col("supplier").alias("s"))).over(w.rowsBetween(1, 8 * k))
    x = h.withColumn("near", near).withColumn("near", F.slice(F.filter("near", lambda n: ~n["s"].eqNullSafe(F.col("supplier")) & (n["p"] != F.col("path"))), 1, k))
    return x.select("path", "supplier", F.posexplode("near").alias("rank", "n")).select("path", "supplier", F.col("n.p").alias("other"), (F.col("rank") + 1).alias("rank"))


def update_from(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with a column taken from changes(key, column) where the key has a change that isn't null; of several the greatest counts."""
    c = changes.where(F.col(column).isNotNull()).groupBy(key).agg(F.max(column).alias("__new"))
    return rows.join(c, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def best_page(text: Column) -> Column:
    """(page, words) of the page of a text, cut at form feeds, that has most words; the first one on a tie, pages from 1."""
    words = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    pages = F.transform(F.split(text, "\f"), lambda p, i: F.struct((-words(p)).alias("w"), (i + 1).alias("page")))
    best = F.array_min(pages)
    return F.struct(best["page"].alias("page"), (-best["w"]).alias("words"))
