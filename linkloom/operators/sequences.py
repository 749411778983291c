"""Leaves over the sequences of a dossier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.spelling import path_key, sequence_key
from linkloom.runtime import cut


def timeline(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Every listed leaf with its dossier's sequence as four digits (null is 0000) and its path in one spelling."""
    s = snapshots.select("snapshot_id", sequence_key(F.col("sequence_number")).alias("seq"), "delivered_at").dropDuplicates(["snapshot_id"])
    return entries.join(s, "snapshot_id").withColumn("path", path_key(F.col("relative_path")))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key, or none if the newest one deletes it. (The choice comes first, the test after it.)"""
    last = rows.groupBy(*keys).agg(F.max(F.struct("seq", "delivered_at", "ord", "entry_id", "operation", "leaf_id", "path")).alias("r"))
    keep = [c for c in ("leaf_id", "path") if c not in keys]
    return last.where("coalesce(lower(r.operation), 'new') <> 'delete'").select(*keys, F.col("r.seq").alias("seq"), *[F.col(f"r.{c}").alias(c) for c in keep])


def history(rows: DataFrame) -> DataFrame:
    """(dossier_id, path, versions): the sequences a path was listed in, in order."""
    return rows.groupBy("dossier_id", "path").agg(F.array_join(F.sort_array(F.collect_set("seq")), ",").alias("versions"))


def sequence_edges(rows: DataFrame) -> DataFrame:
    """(dossier_id, path, src, dst): from each version of a path to the next, where both have ids and these differ."""
    w = Window.partitionBy("dossier_id", "path").orderBy("seq", "delivered_at", "ord", "entry_id")
    pairs = rows.withColumn("src", F.lag("leaf_id").over(w)).select("dossier_id", "path", "src", F.col("leaf_id").alias("dst"))
    return pairs.where("src is not null and dst is not null and src <> dst").distinct()


def diff_pair(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed, modified or unchanged. Checksums decide if both sides have one, else the operation."""
    b = before.select(*keys, F.col("checksum").alias("c0"), F.lit(1).alias("in0"))
    a = after.select(*keys, F.col("checksum").alias("c1"), F.coalesce("operation", F.lit("new")).alias("op"), F.lit(1).alias("in1"))
    both = b.join(a, keys, "full")
    differs = F.when(F.col("c0").isNotNull() & F.col("c1").isNotNull(), F.lower("c0") != F.lower("c1")).otherwise(F.col("op") != "new")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(differs, "modified").otherwise("unchanged")
    return both.select(*keys, change.alias("change"))


def field_changes(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """(keys, order, field, before, after): values that differ from the version before, one row per field (null-safe)."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = rows.select(*keys, order, *fields, *[F.lag(f).over(w).alias(f"_{f}") for f in fields], F.lag(F.lit(1)).over(w).alias("_seen")).where("_seen = 1")
    long = seen.select(*keys, order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")) for f in fields])).alias("x"))
    return long.where("not (x.before <=> x.after)").select(*keys, order, "x.field", "x.before", "x.after")


def consecutive_diffs(rows: DataFrame) -> DataFrame:
    """(dossier_id, seq, leaf_id, change) between each sequence of a dossier and the one before it. rows: timeline rows."""
    sides = rows.groupBy("dossier_id", "seq", "leaf_id").agg(F.max("checksum").alias("checksum"), F.max(F.coalesce("operation", F.lit("new"))).alias("operation"))
    order = rows.select("dossier_id", "seq").distinct().withColumn("next", F.lead("seq").over(Window.partitionBy("dossier_id").orderBy("seq")))
    before = sides.join(order.where("next is not null"), ["dossier_id", "seq"]).drop("seq").withColumnRenamed("next", "seq")
    after = sides.join(order.where("next is not null").select("dossier_id", F.col("next").alias("seq")), ["dossier_id", "seq"])
    return diff_pair(before, after, ["dossier_id", "seq", "leaf_id"])


def verify_checksums(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """(entry_id, status, actual): missing_file, no_checksum (none given, or of an unknown kind), ok or mismatch, in any letter
    case. md5 unless checksum_type says sha256. leaves: (entry_id, path, checksum, checksum_type); files: (path, content).
    """
    both = leaves.join(files.select("path", "content", F.lit(True).alias("_there")), "path", "left")
    kind = F.lower(F.coalesce(F.nullif("checksum_type", F.lit("")), F.lit("md5")))
    actual = F.when(kind == "md5", F.md5("content")).when(kind == "sha256", F.sha2("content", 256))
    none = F.coalesce("checksum", F.lit("")) == ""
    status = F.when(F.col("_there").isNull(), "missing_file").when(none | actual.isNull(), "no_checksum").when(F.lower(actual) == F.lower("checksum"), "ok").otherwise("mismatch")
    return both.select("entry_id", status.alias("status"), F.when(status.isin("ok", "mismatch"), actual).alias("actual"))


def latest_along(edges: DataFrame) -> DataFrame:
    """(node, latest): where following the edges (src, dst; one out of each node) ends. Each round doubles the steps, so a chain
    of n takes log(n) rounds; where it never ends, on a cycle, the largest node met stands for the end.
    """
    step = edges.groupBy("src").agg(F.max("dst").alias("dst"))
    ends = step.select(F.col("dst").alias("src")).join(step.select("src"), "src", "left_anti").distinct().select("src", F.col("src").alias("dst"))
    jump, n = cut(step.unionByName(ends).withColumn("top", F.greatest("src", "dst"))), None
    while True:
        far = jump.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("top").alias("far_top"))
        jump = cut(jump.join(far, "dst").select("src", F.col("far").alias("dst"), F.greatest("top", "far_top").alias("top")))
        open_ = jump.join(ends.select(F.col("src").alias("dst")), "dst", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "top")).alias("h")).first()
        if open_.n == 0 or (open_.n, open_.h) == n:
            break
        n = (open_.n, open_.h)
    done = ends.select(F.col("src").alias("dst"), F.lit(True).alias("_end"))
    return jump.join(done, "dst", "left").select(F.col("src").alias("node"), F.when(F.col("_end"), F.col("dst")).otherwise(F.col("top")).alias("latest"))
