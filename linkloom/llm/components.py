"""Linked groups of records by frontier breadth-first search, and splits that never part a group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.spelling import path_key
from linkloom.runtime import cut, join_unique

#: Most edges of the graph of colliding seeds that one task merges; a larger one goes through a further search.
SMALL_GRAPH = 100_000
#: Groups above this share of all records are placed first, largest first; there are fewer than 1 / share of them.
LARGE_SHARE = 0.01


def _priority(name: str):
    """Order of nodes: by hash, so that nodes that beat all their neighbours are spread evenly; the name settles ties."""
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("node"))


def _merge_small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for a, b in zip(frame["src"], frame["dst"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"label": list(parent), "root": [root(x) for x in parent]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); nodes are strings. Self-links and nulls name no node.

    Seeds are the nodes that come before all their neighbours in hash order; every node has a seed within a few steps, since
    a chain of ever smaller neighbours ends at one. All seeds expand at once: each round joins the frontier with the
    adjacency and labels nodes met first. Edges between differently labelled nodes form the graph of colliding seeds, at
    most half as large, which one task merges if it has at most SMALL_GRAPH edges and which is searched the same way if not.
    """
    both = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    adjacency = cut(both.distinct())
    first = adjacency.groupBy("src").agg(F.min(_priority("dst")).alias("best")).where(F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("node")) < F.col("best"))
    labels = frontier = cut(first.select(F.col("src").alias("node"), F.col("src").alias("label")))
    while True:
        met = adjacency.join(frontier, adjacency["src"] == frontier["node"]).groupBy("dst").agg(F.min("label").alias("label"))
        frontier = cut(met.withColumnRenamed("dst", "node").join(labels.select("node"), "node", "left_anti").select("node", "label"))
        if frontier.isEmpty():
            break
        labels = labels.unionByName(frontier)
    labels = cut(labels)
    ends = adjacency.where("src < dst").join(labels.toDF("src", "from"), "src").join(labels.toDF("dst", "to"), "dst")
    clashes = cut(ends.where("`from` <> `to`").select(F.least("from", "to").alias("src"), F.greatest("from", "to").alias("dst")).distinct())
    n = clashes.count()
    if n == 0:
        return labels.select("node", F.col("label").alias("root"))
    if n <= SMALL_GRAPH:
        merged = F.broadcast(clashes.repartition(1).mapInPandas(_merge_small, "label string, root string"))  # at most 2 * SMALL_GRAPH rows
    else:
        merged = components(clashes.select(F.col("src").alias("a"), F.col("dst").alias("b"))).toDF("label", "root")
    return labels.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def example_keys(examples: DataFrame) -> DataFrame:
    """Distinct (example_id, key): what links an example to others, its document (one spelling) and each study it names."""
    study = F.transform(
        F.filter("entities", lambda e: (e["label"] == "STUDY_ID") & (e["span_end"] > e["span_start"])),
        lambda e: F.concat(F.lit("s:"), F.lower(F.substring("text", e["span_start"] + 1, e["span_end"] - e["span_start"]))),
    )
    keys = F.concat(F.array(F.concat(F.lit("d:"), path_key(F.col("source_doc")))), F.coalesce(study, F.array().cast("array<string>")))
    return examples.where("example_id is not null").select("example_id", F.explode(keys).alias("key")).where("key is not null and key <> 's:'").distinct()


def linked_groups(examples: DataFrame) -> DataFrame:
    """(example_id, group_id, size) of every example: its linked group's smallest example_id and number of examples.

    Examples are linked if they share a document or a study, also through third examples. The search runs over keys, not
    pairs of examples, so a key that a third of all examples share costs no more than its rows. Repeated rows count once;
    null or blank keys link nothing, and an example without keys is a group of its own. An empty table gives no rows.
    """
    keys = cut(example_keys(examples))
    per = cut(keys.groupBy("example_id").agg(F.min("key").alias("key"), F.array_distinct(F.collect_list("key")).alias("all")))
    edges = per.where("size(all) > 1").select(F.col("key").alias("a"), F.explode("all").alias("b")).where("a <> b")
    weights = per.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("least"))
    rooted = cut(weights.join(components(edges).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    groups = rooted.groupBy("root").agg(F.sum("n").alias("size"), F.min("least").alias("group_id"))
    nodes = cut(join_unique(rooted.select("key", "root"), groups, ["root"]).select("key", "group_id", "size"))
    inside = join_unique(per.select("example_id", "key"), nodes, ["key"]).select("example_id", "group_id", "size")
    alone = examples.where("example_id is not null").select("example_id").distinct().join(per.select("example_id"), "example_id", "left_anti")
    return inside.unionByName(alone.select("example_id", F.col("example_id").alias("group_id"), F.lit(1).cast("bigint").alias("size")))


def linked_splits(examples: DataFrame, targets: DataFrame) -> DataFrame:
    """(example_id, group_id, split): a split per example, one and the same within a linked group, sizes near the targets.

    Groups above LARGE_SHARE of all examples go, largest first, to the split with most room left. The others are laid side
    by side in hash order, by their sizes, and cut where the room of each split ends; their places come from sums per hash
    bucket, so no task sees all groups. A single group larger than a split's target can push that split over it.
    """
    groups = cut(linked_groups(examples))
    sizes = cut(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("group_id")).withColumn("bucket", F.shiftrightunsigned("h", 52)))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    room = {r["split"]: (r["target_share"] or 0.0) * total for r in targets.where("split is not null").orderBy("split").collect()}  # one row per split
    if not room:
        return groups.select("example_id", "group_id", F.lit(None).cast("string").alias("split"))
    large = {}
    for r in sizes.where(F.col("n") > max(1, LARGE_SHARE * total)).orderBy(F.desc("n"), "group_id").collect():  # under 1 / LARGE_SHARE rows
        large[r["group_id"]] = best = max(sorted(room), key=lambda s: room[s])
        room[best] -= r["n"]
    rest = sizes.where(~F.col("group_id").isin(*large)) if large else sizes
    buckets = rest.groupBy("bucket").agg(F.sum("n").alias("n"))  # at most 4096 rows
    before = buckets.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0))
    free = {s: max(0.0, x) for s, x in room.items()}
    scale = sum(free.values()) or 1.0
    n_rest = F.lit(float(rest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] or 1))
    place = (F.col("before") + F.col("upto") - F.col("n") / 2) / n_rest
    split, end = None, 0.0
    names = sorted(free, key=lambda s: -free[s])
    for s in names:
        end += free[s] / scale
        split = F.when(place <= end, s) if split is None else split.when(place <= end, s)
    placed = rest.join(F.broadcast(before), "bucket").withColumn("upto", upto).select("group_id", split.otherwise(names[0]).alias("split"))
    if large:
        put = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])
        placed = placed.unionByName(sizes.where(F.col("group_id").isin(*large)).select("group_id", put[F.col("group_id")].alias("split")))
    return join_unique(groups.select("example_id", "group_id"), placed, ["group_id"]).select("example_id", "group_id", "split")


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: target share, examples, groups and share reached."""
    per = splits.groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("n_examples"), F.count(F.lit(1)).alias("n_groups"))
    total = per.agg(F.sum("n_examples").alias("all"))
    return targets.join(per, "split", "left").crossJoin(F.broadcast(total)).select(  # total: one row
        "split", "target_share", F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        F.when(F.col("all") > 0, F.round(F.col("n_examples") / F.col("all"), 6)).otherwise(0.0).alias("actual_share"),
    )
