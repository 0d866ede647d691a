"""Similarity of vectors: exact top-k of a stated query set against all rows in blocks, and measures over all pairs.

Queries go to the tasks in blocks of BLOCK (bounded); each task keeps k rows per query of its own rows before the
shuffle. Measures over all pairs come from sums over single rows, never from pairs. Null, empty and zero vectors
have no similarity and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

#: Queries that are sent to the tasks at a time.
BLOCK = 2048


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(df: DataFrame) -> DataFrame:
    """Vectors without nulls and NaNs that are not zero; each is compared with those of its own length only."""
    return df.where("embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x))")


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows of each query by cosine, itself left out; ties by vec_id."""
    q = _usable(queries).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    lengths = q.groupBy(F.size("embedding").alias("d")).count().collect()
    r = _usable(rows).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    parts = []
    for d, i, blocks in [(x.d, i, b) for x in lengths for b in [-(-x["count"] // BLOCK)] for i in range(b)]:
        got = q.where(f"size(embedding) = {d} and pmod(xxhash64(vec_id), {blocks}) = {i}").toPandas()
        if got.empty:
            continue
        ids, mat = got.vec_id.to_numpy(), np.stack(got.embedding.map(np.asarray).to_list()).astype(np.float64)

        def run(batches: Iterator[pd.DataFrame], ids=ids, mat=_unit(mat)) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                same = b[b.embedding.map(len) == mat.shape[1]]
                if same.empty:
                    continue
                v = same.vec_id.to_numpy()
                s = np.round(mat @ _unit(np.stack(same.embedding.map(np.asarray).to_list()).astype(np.float64)).T, 6)
                if s.shape[1] > 4 * k:  # rows below a query's k best can't count; ties with the last one stay
                    least = -np.partition(-s, k, axis=1)[:, k]
                    at, col = np.nonzero(s >= least[:, None])
                else:
                    at, col = map(np.ravel, np.indices(s.shape))
                near = pd.DataFrame({"query_id": ids[at], "vec_id": v[col], "score": s[at, col]}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield near.groupby("query_id").head(k + 1)

        parts.append(r.mapInPandas(run, "query_id long, vec_id long, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    near = reduce(DataFrame.unionByName, parts).where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def duplicates(queries: DataFrame, rows: DataFrame, threshold: float, k: int = 10) -> DataFrame:
    """The top k first, then the threshold."""
    return top_k(queries, rows, k).where(F.col("score") >= threshold)


def pair_statistics(rows: DataFrame) -> DataFrame:
    """(n, mean, std) of the cosine over all ordered pairs, each with itself included, in one pass.

    With unit vectors u the mean is |sum u|^2 / n^2 and the mean square is the sum of squares of sum u u^T / n^2.
    """
    u = _usable(rows).select("embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for b in batches:
            if b.empty:
                continue
            m = _unit(np.stack(b.embedding.map(np.asarray).to_list()).astype(np.float64))
            n += len(m)
            s = m.sum(0) if s is None else s + m.sum(0)
            g = m.T @ m if g is None else g + m.T @ m
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    part = cut(u.mapInPandas(run, "n long, s array<double>, g array<double>"))  # one row a task, used three times
    total = part.agg(F.sum("n").alias("n"))
    # one row per task and place, summed
    s = part.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("s2"))
    g = part.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("g2"))
    one = total.join(F.broadcast(s)).join(F.broadcast(g))  # one row each
    mean = F.col("s2") / F.col("n") / F.col("n")
    return one.select("n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("g2") / F.col("n") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"))


def retrieval_metrics(ranked: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """MRR and recall at k from the best rank of a row with the query's label; a query without one counts as 0.

    Queries are those in `ranked`; labels: (vec_id, label).
    """
    lab = labels.dropDuplicates(["vec_id"])
    j = ranked.join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").join(lab.select("vec_id", "label"), "vec_id")
    best = j.groupBy("query_id").agg(F.min(F.when(F.col("want") == F.col("label"), F.col("rank"))).alias("r"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), *[F.round(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks])
