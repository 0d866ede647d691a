"""Checking new batches for copies against everything accepted before, from kept hashes alone.

A History is a set of tables under a stable name in a folder that all executors share. Accepting a batch reads the
batch's own texts, looks its hashes up in the tables bucket by bucket, answers, and appends its hashes; texts that
were accepted earlier are never read again.

* `proofs`, bucketed by key: one row per site and file hash, and per site and hash of the normalised content, with the
  upload that brought it first. An equal key is a copy outright.
* `paragraphs`, bucketed by key: the paragraph hashes of each different content. Scans damage letters but hardly
  digits, so a paragraph with a long number is hashed by its numbers, any other one by its folded letters; a text's
  keys are its numbered paragraphs, or all of them where it has none.
* `features`, bucketed by upload_id: the hash sets that coverage is measured on.
* `papers` and `merged`: the paper (smallest upload) of each upload, and papers that a later upload joined.

Two uploads are the same paper when COVER of the smaller one's keys and COVER of its folded paragraphs are in the
other one. Two sets that share so much must meet in the rarest keys of the smaller one, so only those are looked up
(`probe`): a letterhead that every letter of a site bears is no candidate by itself, and nothing is lost. Uploads that
cover the first one of a key (`covered`) are not compared with each other but with the others only, so a paper that
came in damaged a million times makes a million pairs.

Defined results: blank and null texts are compared by file hash only; a null file hash or site matches nothing;
repeated rows count once; without any upload the result is empty. A batch that is accepted again after a failure, or
twice, gives the same answer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import cut, ensure_checkpoint_dir, evaluated

#: Share of the smaller upload's keys, and of its folded paragraphs, that the other one must have.
COVER = 0.6
#: Shortest folded paragraph that counts.
SHORTEST = 12

_END = "\u0001"
_BREAKS = r"[\r\n  \u0085]+|(?<=[.!?])\s+"


def folded(pieces: Column) -> Column:
    """Letters that scans confuse as one letter, no spaces and signs, doubled letters once; the pieces of a text joined by \\u0001."""
    t = F.lower(F.array_join(pieces, _END))
    for a, b in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "01|!l596u8hctö6ä", "oiiiisggnbbefooa")
    return F.regexp_replace(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{_END}]+", ""), rf"([^{_END}])\1+", "$1")


def text_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, content, keys, paras): hashes only, all inside the JVM; texts without a sign give no row."""
    d = docs.select("doc_id", "text").where("text is not null").dropDuplicates(["doc_id"])
    d = evaluated(d, "doc_id", pieces=F.split("text", _BREAKS))
    numbers = F.transform("pieces", lambda p: F.regexp_extract_all(p, F.lit(r"\d{4,}"), F.lit(0)))
    d = evaluated(d, "doc_id", flat=folded(F.col("pieces")), numbers=numbers).where("flat rlike '[^\\u0001]'")
    paras = F.transform(F.filter(F.split("flat", _END), lambda p: F.length(p) >= SHORTEST), lambda p: F.xxhash64(p))
    # letters misread as digits never make runs of six
    keys = F.transform(F.filter("numbers", lambda n: F.exists(n, lambda x: F.length(x) >= 6)), lambda n: F.xxhash64(n))
    # folding makes some digits alike, so equal contents must have equal long numbers too
    content = F.concat(F.replace("flat", F.lit(_END), F.lit("")), F.lit(_END), F.array_join(F.flatten("numbers"), " "))
    d = d.select("doc_id", F.md5(content.cast("binary")).alias("content"), F.array_distinct(paras).alias("paras"), F.array_distinct(keys).alias("keys"))
    return d.select("doc_id", "content", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.col("paras")).alias("keys"), "paras")


def file_hash(sha: Column) -> Column:
    """A file hash in any of the shapes that it is stored in, plain."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(sha, r"^.*:|\s", ""))), F.lit(""))


def covers(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs (a, b) whose smaller member is covered; left, right: (upload_id, keys, paras)."""
    a = left.select(F.col("upload_id").alias("a"), F.col("keys").alias("ka"), F.col("paras").alias("pa"))
    b = right.select(F.col("upload_id").alias("b"), F.col("keys").alias("kb"), F.col("paras").alias("pb"))
    share = lambda x, y: F.size(F.array_intersect(x, y)) >= COVER * F.least(F.size(x), F.size(y))
    return pairs.join(a, "a").join(b, "b").where(share("ka", "kb") & share("pa", "pb")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, label): the smallest node of each connected part; labels spread along the links and jump ahead."""
    e = cut(edges.where("u <> v").select(F.explode(F.expr("array(struct(u, v), struct(v as u, u as v))")).alias("e")).select("e.*").distinct())
    label = e.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("label"))
    while True:
        low = e.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("low"))
        step = label.join(low, F.col("node") == F.col("u")).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        ahead = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = cut(step.join(ahead, "label").select("node", F.col("next").alias("label"), "was"))
        moved = not step.where("label < was").isEmpty()
        label = step.drop("was")
        if not moved:
            return label


class History:
    """The kept hashes of one office under a stable name; see the module's text."""

    TABLES = {
        "proofs": ("key", "key string, upload_id bigint"),
        "paragraphs": ("key", "key bigint, upload_id bigint, n int, probe boolean, covered boolean"),
        "features": ("upload_id", "upload_id bigint, keys array<bigint>, paras array<bigint>"),
        "papers": ("upload_id", "upload_id bigint, paper bigint"),
        "merged": ("paper", "paper bigint, into bigint"),
    }

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None, buckets: int | None = None):
        """Open or make the history `name` in a shared folder; the number of buckets is fixed when it is made."""
        ensure_checkpoint_dir(spark)
        jvm, sc = spark._jvm, spark.sparkContext
        self.spark, self.name = spark, name
        self.folder = f"{folder or sc._jsc.sc().getCheckpointDir().get()}/history-{name}"
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        made = [f.getPath().getName() for f in self.fs.listStatus(path)] if self.fs.exists(path) else []
        self.buckets = int(made[0].split("-")[1]) if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fresh = not made
        for t, (by, columns) in self.TABLES.items():
            where = f"{self.folder}/buckets-{self.buckets}/{t}"
            self.fs.mkdirs(jvm.org.apache.hadoop.fs.Path(where))
            spark.sql(f"create table if not exists {self._table(t)} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{where}'")

    def _table(self, t: str) -> str:
        return f"history_{self.name}_{t}"

    def read(self, t: str) -> DataFrame:
        return self.spark.table(self._table(t))

    def _append(self, t: str, rows: DataFrame) -> None:
        by, columns = self.TABLES[t]
        rows.select(*[c.split()[0] for c in columns.split(", ")]).repartition(self.buckets, by).write.mode("append").insertInto(self._table(t))

    def drop(self) -> None:
        for t in self.TABLES:
            self.spark.sql(f"drop table if exists {self._table(t)}")
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), True)

    def accept(self, uploads: DataFrame, features: DataFrame) -> DataFrame:
        """uploads(upload_id, owner_scope, sha256, doc_id), features of the batch's texts -> (first_upload_id, upload_id) of the copies.

        Upload ids grow with acceptance. The batch's hashes are kept for the batches after it.
        """
        conf, rule = self.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        before = conf.get(rule)
        conf.set(rule, "false")  # joins by key and one more column stay in the buckets of the key
        try:
            return self._accept(uploads, features)
        finally:
            conf.set(rule, before)

    def _accept(self, uploads: DataFrame, features: DataFrame) -> DataFrame:
        fresh = self.fresh  # an empty history needs no lookups
        u = uploads.where("upload_id is not null and owner_scope is not null").dropDuplicates(["upload_id"])
        u = u.select("upload_id", "owner_scope", "doc_id", file_hash(F.col("sha256")).alias("sha"))
        f = cut(u.join(features, "doc_id", "left").withColumn("keys", F.expr("transform(keys, k -> xxhash64(owner_scope, k))")).drop("doc_id"))

        # equal files and contents: each links to the upload that brought it first
        made = F.array(F.struct(F.lit(True).alias("file"), F.expr("md5(concat_ws('\\u0000', 'file', owner_scope, sha))").alias("key"), F.col("sha").alias("x")), F.struct(F.lit(False).alias("file"), F.expr("md5(concat_ws('\\u0000', 'text', owner_scope, content))").alias("key"), F.col("content").alias("x")))
        proof = f.select("upload_id", F.explode(made).alias("m")).where("m.x is not null").select("upload_id", "m.file", "m.key")
        first = proof.groupBy("key", "file").agg(F.min("upload_id").alias("first"))
        if fresh:
            first = first.withColumn("old", F.lit(None).cast("long"))
        else:
            first = first.join(self.read("proofs").groupBy("key").agg(F.min("upload_id").alias("old")), "key", "left")
        first = cut(first)
        links = proof.join(first, "key").select(F.col("upload_id").alias("u"), F.coalesce("old", "first").alias("v")).where("u <> v")

        # each new content once, with its paragraph keys
        r = cut(f.join(first.where("not file and old is null").select(F.col("first").alias("upload_id")), "upload_id").select("upload_id", "keys", "paras"))
        k = r.select("upload_id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
        count = k.groupBy("key").agg(F.count("*").alias("df"), F.min("upload_id").alias("center"))
        if not fresh:
            old = self.read("paragraphs").groupBy("key").agg(F.count("*").alias("odf"), F.min("upload_id").alias("ocenter"))
            count = count.join(old, "key", "left").select("key", F.expr("df + coalesce(odf, 0)").alias("df"), F.expr("least(center, ocenter)").alias("center"))
        # keys that nobody else has come first in a text's order and need no lookup
        shared = k.join(count.where("df > 1"), "key").groupBy("upload_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key", "center"))).alias("ks"))
        shared = shared.select("upload_id", "n", F.posexplode("ks").alias("at", "k"), (F.col("n") - F.size("ks")).alias("alone"))
        m = cut(shared.select("k.key", "upload_id", "n", F.expr(f"alone + at <= n - ceil({COVER} * n)").alias("probe"), "k.center"))

        known = r if fresh else r.unionByName(self.read("features"))
        star = m.where("probe and upload_id <> center").select(F.col("upload_id").alias("a"), F.col("center").alias("b")).distinct()
        close = cut(covers(star, r, known))
        m = m.join(close.select(F.col("a").alias("upload_id"), F.col("b").alias("center"), F.lit(True).alias("c")), ["upload_id", "center"], "left")
        m = cut(m.select("key", "upload_id", "n", "probe", F.expr("coalesce(c, upload_id = center)").alias("covered")))

        def meet(x: DataFrame, y: DataFrame) -> DataFrame:
            """x looks y up by its rare keys; two covered ones needn't meet."""
            x = x.where("probe").select("key", F.col("upload_id").alias("x"), F.col("n").alias("nx"), F.explode(F.expr("if(covered, array(false), array(true, false))")).alias("covered"))
            j = x.join(y.select("key", "covered", F.col("upload_id").alias("y"), "n"), ["key", "covered"]).where("x <> y and nx <= n")
            return j.select("x", "y")

        pairs = meet(m, m).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        if not fresh:
            s = self.read("paragraphs")
            pairs = pairs.unionByName(meet(m, s).select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(meet(s, m).select(F.col("y").alias("a"), F.col("x").alias("b")))
        found = covers(pairs.distinct().join(close, ["a", "b"], "left_anti"), r, known).unionByName(close)

        # old uploads stand for their papers
        links = links.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if not fresh:
            papers = self.read("papers").groupBy("upload_id").agg(F.min("paper").alias("paper"))
            into = self.read("merged").groupBy("paper").agg(F.min("into").alias("into"))
            links = links.join(papers.withColumnRenamed("upload_id", "v"), "v", "left").join(into, "paper", "left").select("u", F.coalesce("into", "paper", "v").alias("v"))
        label = components(links)
        mine = cut(f.select("upload_id").join(label, F.col("upload_id") == F.col("node"), "left").select("upload_id", F.coalesce("label", "upload_id").alias("paper")))

        self._append("features", r)
        self._append("paragraphs", k.join(m.drop("n"), ["key", "upload_id"], "left").select("key", "upload_id", "n", F.expr("coalesce(probe, true)").alias("probe"), F.expr("coalesce(covered, true)").alias("covered")))
        if not fresh:
            joined = label.join(mine.select(F.col("upload_id").alias("node")), "node", "left_anti").where("label < node").select(F.col("node").alias("paper"), F.col("label").alias("into"))
            further = into.join(joined.select(F.col("paper").alias("into"), F.col("into").alias("last")), "into").select("paper", F.col("last").alias("into"))
            self._append("merged", cut(joined.unionByName(further)))
        self._append("papers", mine)
        # the proofs come last: a content counts as known only when everything else about it is kept
        self._append("proofs", first.where("old is null").select("key", F.col("first").alias("upload_id")))
        self.fresh = False
        return mine.where("paper < upload_id").select(F.col("paper").alias("first_upload_id"), "upload_id")


def find_copies(uploads: DataFrame, docs: DataFrame) -> DataFrame:
    """(first_upload_id, upload_id) of each upload of a batch from 1 on that brings a paper its site had before.

    Batch 0 becomes a history of its own, all later batches are accepted into it together; the history ends with the call.
    """
    features = cut(text_features(docs))
    h = History(uploads.sparkSession, uuid.uuid4().hex)
    try:
        h.accept(uploads.where("batch_no = 0"), features)
        return h.accept(uploads.where("batch_no >= 1"), features)
    finally:
        h.drop()


def registry_after(uploads: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The fingerprint registry after the new batches: per site and file hash the first and last sighting and the count.

    Rows of the registry in any of its key shapes count with their stored seen_count; each upload of a later batch
    adds one. Missing history rows are rebuilt from batch 0. A null key or site gives no row.
    """
    sha = file_hash(F.col("sha256"))
    old = fingerprints.where("sha256 is not null and owner_scope is not null").select("owner_scope", sha.alias("sha256"), "first_seen_at", "last_seen_at", F.coalesce("seen_count", F.lit(1)).alias("n"))
    old = old.groupBy("owner_scope", "sha256").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("n").cast("long").alias("n"))
    up = uploads.where("sha256 is not null and owner_scope is not null").dropDuplicates(["upload_id"]).select("owner_scope", sha.alias("sha256"), "ts", (F.col("batch_no") >= 1).cast("long").alias("fresh"))
    up = up.groupBy("owner_scope", "sha256").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.sum("fresh").alias("fresh"), F.sum(F.expr("1 - fresh")).alias("before"))
    j = old.join(up, ["owner_scope", "sha256"], "full_outer")
    return j.select(
        "owner_scope", "sha256", F.least("first_seen_at", "f").alias("first_seen_at"), F.greatest("last_seen_at", "l").alias("last_seen_at"),
        (F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("before", F.lit(0))) + F.coalesce("fresh", F.lit(0))).alias("seen_count"),
    )
