"""Changes between consecutive full snapshots, found through Merkle trees over hash ranges of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.spelling import path_key, sequence_key, squeezed
from linkloom.runtime import cut

#: Children of a tree node, as a power of two, and keys a hash range holds on average at most. A dossier's trees are as deep
#: as its largest delivery needs: log(keys / KEYS_PER_RANGE) levels under the root, none for a small one.
FANOUT_BITS, KEYS_PER_RANGE = 3, 8


def chosen_deliveries(snapshots: DataFrame) -> DataFrame:
    """(dossier_id, sequence_number, snapshot_id, ord): of the deliveries of one sequence the latest; ord counts a dossier's
    sequences from 1. Null delivered_at is earliest; ties go to the larger snapshot_id. Null dossier_id or snapshot_id: left out.
    """
    latest = (
        snapshots.where("dossier_id is not null and snapshot_id is not null")
        .groupBy("dossier_id", sequence_key(F.col("sequence_number")).alias("sequence_number"))
        .agg(F.max(F.struct("delivered_at", "snapshot_id")).alias("d"))
    )
    order = Window.partitionBy("dossier_id").orderBy(F.length("sequence_number"), "sequence_number")
    return latest.select("dossier_id", "sequence_number", F.col("d.snapshot_id").alias("snapshot_id"), F.row_number().over(order).alias("ord"))


def present_leaves(entries: DataFrame, deliveries: DataFrame) -> DataFrame:
    """The leaves each chosen delivery lists as present, with the values that are compared. A leaf listed more than once in
    one delivery counts as its row of the largest entry_id; rows without a leaf_id name no leaf and are left out.
    """
    leaf = F.col("leaf")
    rows = entries.where("leaf.leaf_id is not null and snapshot_id is not null").select(
        "snapshot_id",
        leaf["leaf_id"].alias("leaf_id"),
        F.struct(
            F.col("entry_id"),
            (F.coalesce(F.lower(F.trim(leaf["operation"])), F.lit("")) != "delete").alias("present"),
            path_key(leaf["relative_path"]).alias("path"),
            squeezed(leaf["module"]).alias("module"),
            squeezed(leaf["checksum"]).alias("checksum"),
            squeezed(leaf["title"]).alias("title"),
        ).alias("v"),
    )
    return (
        rows.join(deliveries.select("snapshot_id", "dossier_id", "ord"), "snapshot_id")
        .groupBy("dossier_id", "ord", "leaf_id")
        .agg(F.max("v").alias("v"))
        .where("v.present")
        .select("dossier_id", "ord", "leaf_id", "v.path", "v.module", "v.checksum", "v.title")
    )


def with_depth(leaves: DataFrame) -> DataFrame:
    """Adds ``depth``, the levels under the root of the dossier's trees, from the keys of its largest delivery, and ``node``, the
    hash range of the leaf's key at that depth.
    """
    sizes = leaves.groupBy("dossier_id", "ord").agg(F.count(F.lit(1)).alias("n")).groupBy("dossier_id").agg(F.max("n").alias("n"))
    depth = F.least(F.lit(60 // FANOUT_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / KEYS_PER_RANGE) / FANOUT_BITS))).cast("int")
    node = F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.xxhash64("leaf_id"), F.lit(64) - FANOUT_BITS * F.col("depth")))
    return leaves.join(sizes.select("dossier_id", depth.alias("depth")), "dossier_id").withColumn("node", node)


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Digests per (dossier_id, ord, depth, node), root first. A tree's lowest level combines the row digests of a hash range
    (order-free, two independent 64-bit XORs and a count); each level above hashes its children's digests in node order.
    leaves: as with_depth gives them.
    """
    values = ["leaf_id", "path", "module", "checksum", "title"]
    marks = F.concat_ws("", *[F.isnull(c).cast("int").cast("string") for c in values])
    ranges = cut(
        leaves.withColumn("h1", F.xxhash64(*values, marks))
        .withColumn("h2", F.xxhash64(F.lit("second"), marks, *reversed(values)))
        .groupBy("dossier_id", "ord", "depth", "node")
        .agg(F.xxhash64(F.expr("bit_xor(h1)"), F.expr("bit_xor(h2)"), F.count(F.lit(1))).alias("digest"))
    )
    deepest = ranges.agg(F.max("depth")).first()[0] or 0
    levels = [ranges.where(F.col("depth") == deepest)]
    for k in range(deepest - 1, -1, -1):
        above = (
            levels[0].groupBy("dossier_id", "ord", "depth", F.shiftright("node", FANOUT_BITS).alias("node"))
            .agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("node", "digest")))).alias("digest"))  # at most 2 ** FANOUT_BITS
        )
        levels.insert(0, above.unionByName(ranges.where(F.col("depth") == k)))
    return levels


def differing_ranges(levels: list[DataFrame], steps: DataFrame) -> DataFrame:
    """(dossier_id, ord, node) of the hash ranges whose digests differ between sequence ord and ord - 1, found top-down:
    a level is only compared below nodes that differed. A side without keys in a range has no digest and differs.
    """
    open_nodes = steps.select("dossier_id", "ord", F.lit(0).cast("bigint").alias("node"))
    key = ["dossier_id", "ord", "node"]
    found = None
    for k, level in enumerate(levels):
        now = level.select(*key, "depth", F.col("digest").alias("now"), F.lit(None).cast("bigint").alias("before"))
        before = level.select("dossier_id", (F.col("ord") + 1).alias("ord"), "node", "depth", F.lit(None).cast("bigint").alias("now"), F.col("digest").alias("before"))
        below = open_nodes.withColumnRenamed("node", "parent")
        parent = F.shiftright("node", FANOUT_BITS) if k else F.col("node")
        both = now.unionByName(before).withColumn("parent", parent).join(below, ["dossier_id", "ord", "parent"], "left_semi")
        differ = both.groupBy(*key, "depth").agg(F.max("now").alias("now"), F.max("before").alias("before")).where("not (now <=> before)")
        ends = differ.where(F.col("depth") == k).select(*key)
        found = ends if found is None else found.unionByName(ends)
        open_nodes = differ.where(F.col("depth") > k).select(*key)
    return found


def snapshot_changes(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """(dossier_id, sequence_number, leaf_id, change_kind) between each sequence and the next lower one of its dossier.

    added, removed, or changed when path, module, checksum or title differ (spelling aside; null on a side is no
    difference). The lowest sequence yields nothing; a delivery without leaves removes all. Empty tables give no rows;
    further columns are ignored. Rows are compared only inside hash ranges whose digests differ.
    """
    deliveries = cut(chosen_deliveries(snapshots))
    leaves = with_depth(cut(present_leaves(entries, deliveries)))
    steps = deliveries.where("ord > 1")
    differing = cut(differing_ranges(merkle_levels(leaves), steps))
    key = ["dossier_id", "ord", "node"]
    now = leaves.join(differing, key, "left_semi").withColumn("side", F.lit(1))
    before = leaves.withColumn("ord", F.col("ord") + 1).join(differing, key, "left_semi").withColumn("side", F.lit(0))
    fields = ["path", "module", "checksum", "title"]
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    pairs = (
        now.unionByName(before)
        .groupBy("dossier_id", "ord", "leaf_id")
        .agg(F.max("side").alias("hi"), F.min("side").alias("lo"), *[side(s, c).alias(f"{c}{s}") for c in fields for s in (0, 1)])
    )
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.coalesce(F.col(f"{c}0") != F.col(f"{c}1"), F.lit(False))
    kind = F.when(F.col("lo") == 1, "added").when(F.col("hi") == 0, "removed").when(changed, "changed")
    return (
        pairs.withColumn("change_kind", kind)
        .where("change_kind is not null")
        .join(steps.select("dossier_id", "ord", "sequence_number"), ["dossier_id", "ord"])
        .select("dossier_id", "sequence_number", "leaf_id", "change_kind")
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per dossier, sequence and kind."""
    return changes.groupBy("dossier_id", "sequence_number", "change_kind").agg(F.count(F.lit(1)).alias("n"))
