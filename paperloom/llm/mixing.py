"""Mixing sources to target weights along a curriculum.

Sizes are tokens of a public vocabulary. A source's share of the total is its target unless its documents, used at
most max_repeats times, don't suffice; what it lacks goes to the others in proportion to their targets. A source's
weight may change along the training time u in [0, 1]: w(u) = share * (1 + slope * (2u - 1)). Its cumulative demand
is the integral; a document (each use of it) stands at the u at which the source's demand reaches the middle of the
document in the source's own random order, and all uses are range-sorted by that u.

Running sums are taken in hash buckets with the buckets' offsets joined on, so no source and no sort is one task.

Defined results: unlisted or null sources, and texts without tokens, take no share; a repeated document counts once;
a listed source without documents is reported with 0; the document that crosses the demand is the last one used;
without any documents the mix is empty.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut, width

TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Running sums are split into so many buckets of each source, positions into so many of the whole.
BUCKETS = 1024
#: The list of targets is read on the driver and refused beyond this length.
MAX_SOURCES = 10_000
#: Without a stated total it is the largest at which only sources of so much target weight together fall short.
SHORT = 0.1
#: Largest change of a source's weight over the training time, for the source with most repeats.
TILT = 0.5


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """docs(doc_id, source, text) -> (doc_id, source, n_tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                n = [len(e.ids) for e in t.encode_batch([x if isinstance(x, str) else "" for x in part.text], add_special_tokens=False)]
                yield pd.DataFrame({"doc_id": part.doc_id, "source": part.source, "n_tokens": n})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, n_tokens long")


def plan(targets: list[tuple[str, float, int]], supply: dict[str, int], total: int | None = None) -> dict[str, dict]:
    """source -> demand in tokens, share, slope; the shares of sources that reach their cap are given to the others."""
    weight = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    cap = {s: supply.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    if total is None:
        level, short = 0.0, 0.0
        for s in sorted((s for s in weight if weight[s] > 0), key=lambda s: cap[s] / weight[s]):
            level = cap[s] / weight[s]
            if (short := short + weight[s]) > SHORT:
                break
        total = sum(min(cap[s], level * weight[s]) for s in weight)
    demand = dict.fromkeys(weight, 0.0)
    free, left = {s for s in weight if weight[s] > 0 and cap[s] > 0}, float(total)
    while free:
        base = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / base >= cap[s]}
        if not full:
            for s in free:
                demand[s] = left * weight[s] / base
            break
        for s in full:
            demand[s] = float(cap[s])
            left -= cap[s]
        free -= full
    used = sum(demand.values())
    share = {s: demand[s] / used if used else 0.0 for s in weight}
    # sources that may be repeated more come later; the tilts weighted by share add up to 0, so all weights add up to 1
    reps = {s: max(0, r or 0) for s, _, r in targets}
    mean = sum(share[s] * reps[s] for s in weight)
    span = max([abs(reps[s] - mean) for s in weight if share[s]], default=0) or 1
    return {s: {"target": weight[s], "demand": demand[s], "share": share[s], "slope": TILT * (reps[s] - mean) / span, "repeats": reps[s]} for s in weight}


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text), targets(source, target_share, max_repeats) -> (uses, shares).

    uses: (position, doc_id, source, use_no, n_tokens); shares: one row per listed source.
    """
    spark = docs.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # the list of targets is bounded (MAX_SOURCES), so this is a filter
    listed = docs.where(F.col("source").isin([r.source for r in rows])) if rows else docs.limit(0)
    d = cut(token_counts(listed.repartition(width(listed), "doc_id").dropDuplicates(["doc_id"])).where("n_tokens > 0"))
    supply = {r.source: r.n for r in d.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    p = plan([(r.source, r.t, r.m) for r in rows], supply, total)
    steps = [(s, x["target"], x["demand"], x["slope"], math.ceil(x["demand"] / supply[s] - 1e-9) if supply.get(s) else 0, supply.get(s, 0), x["repeats"]) for s, x in sorted(p.items())]
    small = spark.createDataFrame(steps, "source string, target_share double, demand double, slope double, uses int, supply long, max_repeats int")

    u = d.join(F.broadcast(small.where("uses > 0").select("source", "demand", "slope", "uses")), "source")  # bounded by MAX_SOURCES
    u = u.withColumn("use_no", F.explode(F.expr("sequence(1, uses)"))).withColumn("h", F.xxhash64("doc_id", "use_no"))
    u = u.withColumn("bucket", F.expr(f"cast(pmod(shiftrightunsigned(h, 40), {BUCKETS}) as int)"))
    # the offset of a bucket: everything of the source in earlier passes and buckets
    part = u.groupBy("source", "use_no", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("use_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("source", "use_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "use_no", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(part, ["source", "use_no", "bucket"])
    u = u.withColumn("start", F.col("start") + F.col("offset")).where("start < demand")
    # middle of the document as part of the demand: y = t + slope * (t * t - t), solved for t
    y = F.least(F.lit(1.0), (F.col("start") + F.col("n_tokens") / 2) / F.col("demand"))
    b = 1 - F.col("slope")
    root = F.when(F.abs("slope") < 1e-9, y).otherwise((-b + F.sqrt(b * b + 4 * F.col("slope") * y)) / (2 * F.col("slope")))
    u = cut(u.select("doc_id", "source", "use_no", "n_tokens", F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)).alias("t")))
    u = u.withColumn("slot", F.expr(f"cast(least(t * {BUCKETS}, {BUCKETS} - 1) as int)"))
    count = u.groupBy("slot").agg(F.count("*").alias("n"))
    count = count.select("slot", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # BUCKETS rows
    u = u.withColumn("k", F.row_number().over(Window.partitionBy("slot").orderBy("t", "source", "doc_id", "use_no"))).join(count, "slot")
    uses = u.select((F.col("first") + F.col("k") - 1).alias("position"), "doc_id", "source", "use_no", "n_tokens")
    uses = uses.repartitionByRange("position").sortWithinPartitions("position")
    got = u.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_docs"), F.max("use_no").alias("most_uses"))
    shares = small.join(got, "source", "left").na.fill(0, ["used_tokens", "used_docs", "most_uses"])
    whole = u.agg(F.sum("n_tokens").alias("whole"))
    shares = shares.join(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", F.col("supply").alias("supply_tokens"), "used_tokens", "used_docs", "most_uses",
        F.coalesce(F.col("used_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
    )
    return uses, shares
