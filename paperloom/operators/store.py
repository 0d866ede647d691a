"""State kept in tables: latest rows, merges, retention, registries, unique names. No operator mutates; each returns a new frame.

Ties are always broken by a stated column, so a result never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns, as an aggregate with map-side combine.

    Null keys form a group; extra columns are kept whatever their names.
    """
    best = df.groupBy(*key).agg(F.max(F.struct(*[F.col(o) for o in order], F.struct(*[F.col(c) for c in df.columns]).alias("__row"))).alias("__b"))
    return best.select("__b.__row.*")


def top_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps only n per group before the shuffle (window group limit)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def override(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column to its correction where there is one that is not blank and differs; `<column>_source` tells which.

    A key that is corrected twice takes the greater value.
    """
    c = corrections.where(F.trim(F.col(column)) != "").groupBy(key).agg(F.max(column).alias("__new"))
    j = df.join(c, key, "left")
    use = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))
    return j.withColumn(f"{column}_source", F.when(use, "manual").otherwise("auto")).withColumn(column, F.when(use, F.col("__new")).otherwise(F.col(column))).drop("__new")


def merge_results(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Ordered full outer merge: new rows override, columns in `keep` stay as they were, old order comes first.

    old, new: the same columns with an `ord`; result: the columns and `ord` anew per side ('0' old, '1' added).
    """
    o = old.select(F.col(key), F.struct(*old.columns).alias("o"))
    n = new.select(F.col(key), F.struct(*new.columns).alias("n"))
    j = o.join(n, key, "full_outer")
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in (*keep, "ord") else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c != key]
    return j.select(key, *cols, F.when(F.col("o").isNotNull(), 0).otherwise(1).alias("side"))


def retain(df: DataFrame, ts: str, as_of: str, days: int, keep_unreadable: bool = True) -> DataFrame:
    """Rows of the last days; rows without a time are kept or dropped as stated."""
    fresh = F.col(ts) >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")
    return df.where(F.coalesce(fresh, F.lit(keep_unreadable)))


def registry(uploads: DataFrame) -> DataFrame:
    """One row per site and file hash: first and last sighting, count, and the name and id of the last upload."""
    u = uploads.where("sha256 is not null and owner_scope is not null").dropDuplicates(["upload_id"]).withColumn("sha", F.lower(F.trim("sha256")))
    last = F.max(F.struct("ts", "upload_id", "original_name", "file_id"))
    g = u.groupBy("owner_scope", "sha").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("seen_count"), last.alias("l"))
    return g.select("owner_scope", F.col("sha").alias("sha256"), "first_seen_at", "last_seen_at", "seen_count", F.col("l.original_name").alias("original_name"), F.col("l.file_id").alias("last_file_id"))


def split_key(df: DataFrame) -> DataFrame:
    """Registry keys in their old and new shape (hash, or site:hash) as a plain hash."""
    return df.withColumn("sha", F.lower(F.trim(F.regexp_replace("sha256", "^.*:", ""))))


def known_and_new(uploads: DataFrame, registered: DataFrame) -> DataFrame:
    """Each upload with `known`: its site's registry has the hash. A semi-join on the distinct keys."""
    keys = split_key(registered).where("owner_scope is not null").select("owner_scope", "sha").distinct().withColumn("known", F.lit(True))
    u = uploads.dropDuplicates(["upload_id"]).withColumn("sha", F.lower(F.trim("sha256")))
    return u.join(keys, ["owner_scope", "sha"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


#: Ids of a list are followed within ranges of so many.
RANGE = 65_536


def next_in_list(df: DataFrame, group: str, key: str) -> DataFrame:
    """(key, next): the following key of each group's list, the first one after the last. Ranges of keys are followed by themselves,
    and the last of a range takes the first of the next range, so that no group is held by one task."""
    x = df.select(group, key).withColumn("range", F.expr(f"{key} div {RANGE}"))
    first = x.groupBy(group, "range").agg(F.min(key).alias("low"))
    w = Window.partitionBy(group).orderBy("range")  # one row a range
    first = first.select(group, "range", F.coalesce(F.lead("low").over(w), F.min("low").over(Window.partitionBy(group))).alias("then"))
    x = x.withColumn("next", F.lead(key).over(Window.partitionBy(group, "range").orderBy(key)))
    last = x.where("next is null").withColumnRenamed(group, "__g").withColumnRenamed("range", "__r")
    last = last.join(first, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__r") == F.col("range"))).select(key, F.col("then").alias("next"))
    return x.where("next is not null").select(key, "next").unionByName(last)


def unique_names(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names made unique per folder, in the given order: a free name is kept, else it gets the first free of _01, _02, ... before the ending.

    Where no numbered name meets another one, a window numbers them. Else the names of one stem, numbers cut off, and
    ending are named one after the other, as each name depends on those taken before.
    """
    k = F.row_number().over(Window.partitionBy(folder, name).orderBy(order)) - 1
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    x = df.withColumn("k", k).withColumn("family", F.concat(F.regexp_replace(stem, r"(_[0-9]{2,})+$", ""), ext))
    x = x.withColumn("unique_name", F.when(F.col("k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.format_string("%02d", "k"), ext)))
    met = (F.count("*").over(Window.partitionBy(folder, "unique_name")) > 1) & F.col("unique_name").isNotNull()
    x = x.withColumn("met", met).withColumn("met", F.max("met").over(Window.partitionBy(folder, "family")))
    out = [*[c for c in df.columns if c != "unique_name"], "unique_name"]
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(folder, "family").orderBy(order)))
    rows = F.array_sort(F.collect_list(F.struct("place", F.struct(*out).alias("row"))), lambda a, b: a["place"] - b["place"])
    busy = x.where("met").groupBy(folder, "family").agg(rows.alias("rows")).select("rows", F.udf(_one_after_another, "array<string>")(F.transform("rows", lambda r: r["row"][name])).alias("names"))
    busy = busy.select(F.explode(F.arrays_zip("rows", "names")).alias("z")).select("z.rows.row.*", F.col("z.names").alias("new")).withColumn("unique_name", F.col("new")).drop("new")
    return x.where("not met").select(*out).unionByName(busy)


def _one_after_another(names: list[str]) -> list[str]:
    taken: dict[str, None] = {}  # in order
    used: dict[str, int] = {}
    for n in names:
        cut = n.rfind(".") if "." in n else len(n)
        k, new = used.get(n, 0), n
        if k:
            new = f"{n[:cut]}_{k:02d}{n[cut:]}"
        while new in taken:
            k += 1
            new = f"{n[:cut]}_{k:02d}{n[cut:]}"
        taken[new] = None
        used[n] = k
    return list(taken)


def merge_aliases(suppliers: DataFrame, norm) -> DataFrame:
    """Suppliers of one normal name become one row: smallest spelling, all aliases distinct by their normal form."""
    s = suppliers.where("name is not null").withColumn("key", norm(F.col("name"))).where("key <> ''")
    names = s.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n_rows"))
    a = s.select("key", F.explode("aliases").alias("alias")).where("alias is not null").withColumn("akey", norm(F.col("alias"))).where("akey <> '' and akey <> key")
    a = a.groupBy("key", "akey").agg(F.min("alias").alias("alias")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))
    return names.join(a, "key", "left").select("name", "n_rows", F.coalesce("aliases", F.lit("")).alias("aliases"))


def kv_upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value, updated_at): the latest value of each key; a change of the same time wins over the current row."""
    both = current.withColumn("side", F.lit(0)).unionByName(changes.withColumn("side", F.lit(1)))
    return latest(both, ["key"], ["updated_at", "side"]).drop("side")


def hash_split(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """A stable split: `part` is train for so many percent of the keys."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(bucket < percent, "train").otherwise("test"))
