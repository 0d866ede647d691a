"""Linking the variant spellings of the names of firms and persons.

1. Different strings are read once each into family name, trade, town and given name (names.parse).
2. Family names within the same trade (persons: within the same first letter of the given name) are joined by a
   pigeonhole segment join: a name of length L is cut into k+1 segments, a longer name looks up its own substrings
   at the positions that k edits can shift them to, and a banded edit distance verifies each candidate.
3. Each spelling points to the nearest better attested spelling; pointers are followed to the root. A spelling
   that is itself well attested points nowhere unless the other one is far better attested.
4. Names without a trade go to the one firm of nearest family name (and same town); initials go to the one person
   of that family whose given name they begin.

Defined results: null, blank and words for "missing" are no names; a name that meets two firms or persons equally
well is linked to neither; repeated rows count once as a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.names import MAX_REFERENCE, build_lexicon, parse, skeleton
from paperloom.session import cut

#: A root used so many times as often as a spelling, with no other town, takes it however many raw strings write it.
USES = 4
#: Pairs of one entity are made in so many parts, as one firm may hold a third of all strings.
SALTS = 8


def edits(length: Column) -> Column:
    """Edits allowed between family names by the length of the shorter one."""
    return F.when(length < 4, 0).when(length < 6, 1).when(length < 8, 2).otherwise(3)


def segment_join(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """Pairs (l, r, d) of ids whose texts have an edit distance d within edits() in the same block.

    left, right: (id, txt, *block). The index holds k+1 segments of each right text under its length; a left text
    looks up, for each length within k of its own, the substrings at the positions that remain possible.
    """

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("id", "txt", *block, F.length("txt").alias("len")).where("len > 0")

    idx = shaped(right).withColumn("k", edits(F.col("len"))).withColumn("i", F.explode(F.expr("sequence(0, k)")))
    idx = idx.withColumn("at", F.expr("i * len div (k + 1)")).withColumn("seg", F.expr("substring(txt, at + 1, (i + 1) * len div (k + 1) - at)"))
    idx = idx.select(F.col("id").alias("r"), F.col("txt").alias("rtxt"), *block, F.col("len").alias("m"), "i", "seg")
    probe = shaped(left).withColumn("m", F.explode(F.expr("sequence(greatest(len - 3, 1), len + 3)"))).withColumn("k", edits(F.col("m")))
    probe = probe.where("abs(len - m) <= k").withColumn("i", F.explode(F.expr("sequence(0, k)")))
    probe = probe.withColumn("at", F.expr("i * m div (k + 1)")).withColumn("n", F.expr("(i + 1) * m div (k + 1) - at"))
    # a segment moves left or right only so far that the edits on both sides still fit into k
    probe = probe.withColumn("s", F.explode(F.expr("sequence(-((k - (len - m)) div 2), (k + (len - m)) div 2)"))).where("at + s >= 0 and at + s + n <= len")
    probe = probe.withColumn("seg", F.expr("substring(txt, at + s + 1, n)")).select(F.col("id").alias("l"), F.col("txt").alias("ltxt"), *block, "m", "i", "seg")
    both = probe.join(idx.hint("merge"), [*block, "m", "i", "seg"]).where("l <> r").select("l", "r", "ltxt", "rtxt").distinct()
    k = edits(F.least(F.length("ltxt"), F.length("rtxt")))
    return both.withColumn("d", F.levenshtein("ltxt", "rtxt", 3)).where((F.col("d") >= 0) & (F.col("d") <= k)).select("l", "r", "d")


def _reader(rows: list[tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = build_lexicon(rows)
        for b in batches:
            out = []
            for name, n in zip(b.name, b.n):
                p = parse(name, lex)
                if p is None or not p.family:
                    continue
                cls = "P" if p.kind == "person" else "F" if p.trade else "N"
                disc = p.given[:1] if cls == "P" else p.trade
                out.append((name, n, cls, disc, skeleton(p.family), p.given, p.town))
            yield pd.DataFrame(out, columns=["name", "n", "cls", "disc", "fam", "given", "town"])

    return run


def reference_rows(ref: DataFrame) -> list[tuple]:
    """The reference list on the driver, refused beyond its stated bound."""
    rows = ref.select("ref_id", "ref_name", "ref_code", "city").dropDuplicates(["ref_id"]).limit(MAX_REFERENCE + 1).collect()
    return sorted(((r[0], r[1] or "", r[2] or "", r[3] or "") for r in rows), key=lambda r: (r[0] is None, r[0]))


def link_entities(names: DataFrame, ref: DataFrame) -> DataFrame:
    """names(name) with repeats, ref(ref_id, ref_name, ref_code, city) -> (name, entity) of every different name."""
    different = names.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    spark = names.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = different.repartition(parts, "name").mapInPandas(_reader(reference_rows(ref)), "name string, n long, cls string, disc string, fam string, given string, town string")
    read = cut(read)
    node = read.groupBy("cls", "disc", "fam").agg(F.count("*").alias("strings"), F.sum("n").alias("uses"), F.max("town").alias("town"))
    node = cut(node.select(F.concat_ws("|", "cls", "disc", "fam").alias("id"), "cls", "disc", F.col("fam").alias("txt"), "strings", "uses", "town"))

    # ids carry what later steps compare, so nothing is joined back; joins are merges, as both sides grow with the data
    known = node.where("cls <> 'N'").select(F.struct("strings", "uses", "id", "txt", "town").alias("id"), "txt", "cls", "disc")
    pairs = segment_join(known, known, ["cls", "disc"]).where("(r.strings, r.uses, r.id) > (l.strings, l.uses, l.id)")
    # the ratio of uses doesn't change with the number of rows, as the number of raw strings does
    pairs = pairs.where(f"l.strings <= 2 or (r.strings >= 3 * l.strings and d <= 2) or (r.uses >= {USES} * l.uses and (l.town = '' or r.town = '' or l.town = r.town))")
    up = pairs.groupBy(F.col("l.id").alias("id")).agg(F.min(F.struct("d", F.expr("-r.strings as s"), F.expr("-r.uses as u"), "r")).alias("best"))
    up = up.select("id", F.struct("best.r.id", "best.r.txt").alias("up"))
    root = cut(known.select("id.id", "txt").join(up.hint("merge"), "id", "left").select("id", "txt", F.coalesce("up", F.struct("id", "txt")).alias("root")))
    while True:  # pointer jumping: the longest chain is halved each time
        nxt = root.select(F.col("id").alias("rid"), F.col("root").alias("further"))
        step = root.join(nxt.hint("merge"), F.col("root.id") == F.col("rid"), "left").select("id", "txt", F.coalesce("further", "root").alias("root"), (F.col("further.id") != F.col("root.id")).alias("moved"))
        step = cut(step)
        moved = not step.where("moved").isEmpty()
        root = step.drop("moved")
        if not moved:
            break
    # a chain of small steps must not end at another name: a spelling far from its root stands alone
    near = F.levenshtein("txt", "root.txt") <= edits(F.least(F.length("txt"), F.length("root.txt"))) + 1
    root = root.select("id", F.when(near, F.col("root.id")).otherwise(F.col("id")).alias("root"))

    # names without a trade: the one firm of nearest family, of the same town if both name one
    firms = node.where("cls = 'F'").select("id", "txt", "town").join(root.hint("merge"), "id").select(F.struct("root", "town").alias("id"), "txt").distinct()
    bare = node.where("cls = 'N'")
    meet = segment_join(bare.select(F.struct(F.col("id").alias("root"), "town").alias("id"), "txt"), firms, [])
    meet = meet.select(F.col("l.root").alias("l"), F.col("r.root").alias("root"), F.expr("cast(not (l.town = '' or r.town = '' or l.town = r.town) as int)").alias("other"), F.expr("cast(l.town = r.town as int)").alias("same"), "d")
    # a firm whose spellings name other towns only is another one
    meet = meet.groupBy("l", "root").agg(F.struct(F.expr("if(max(same) = 1, 0, max(other))").alias("other"), F.min("d").alias("d")).alias("fit"))
    meet = meet.withColumn("least", F.min("fit").over(Window.partitionBy("l"))).where("fit = least and fit.other = 0")
    meet = meet.groupBy("l").agg(F.count("*").alias("c"), F.max("root").alias("root")).where("c = 1").select(F.col("l").alias("id"), "root")
    root = cut(root.unionByName(bare.select("id").join(meet.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))))

    full = read.withColumn("id", F.concat_ws("|", "cls", "disc", "fam")).join(root.hint("merge"), "id").select("name", "cls", "root", "given")
    full = cut(full)
    firm = full.where("cls <> 'P'").select("name", F.col("root").alias("entity"))
    person = full.where("cls = 'P'")
    given = person.where("length(given) > 2").select("root", F.col("given").alias("whole")).distinct()
    short = person.where("length(given) <= 2").select("root", "given").distinct().join(given.hint("merge"), "root").where("startswith(whole, given)")
    short = short.groupBy("root", "given").agg(F.count("*").alias("c"), F.max("whole").alias("whole")).where("c = 1").drop("c")
    person = person.join(short.hint("merge"), ["root", "given"], "left").select("name", F.concat_ws("|", "root", F.coalesce("whole", "given")).alias("entity"))
    return cut(firm.unionByName(person))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name, entity) -> (name_a, name_b) with name_a < name_b, each pair once; hot entities are split into parts."""
    a = linked.select(F.col("name").alias("name_a"), "entity", F.expr(f"pmod(hash(name), {SALTS})").alias("salt"))
    b = linked.select(F.col("name").alias("name_b"), "entity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return a.join(b.hint("merge"), ["entity", "salt"]).where("name_a < name_b").select("name_a", "name_b")
