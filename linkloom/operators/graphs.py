"""The graph of documents and modules: neighbours, cycles, orphans, paths."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.resolution import module_chain
from linkloom.runtime import cut


def reference_edges(links: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls."""
    return links.select("src", "dst").where("src is not null and dst is not null").distinct()


def module_edges(leaves: DataFrame) -> DataFrame:
    """(parent, child) of the module tree and of leaves under their module, each once."""
    chain = leaves.where("module is not null").select("leaf_id", module_chain(F.lower("module")).alias("c")).where("size(c) > 0")
    up = chain.select(F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("parent"), b.alias("child")))).alias("e")).select("e.*")
    return up.unionByName(chain.select(F.element_at("c", -1).alias("parent"), F.col("leaf_id").alias("child"))).distinct()


def leaves_under(leaves: DataFrame) -> DataFrame:
    """(module, leaf_id) for every module a leaf lies under, at any depth: the ancestors come from the label, no recursion."""
    return leaves.where("module is not null").select("leaf_id", F.explode(module_chain(F.lower("module"))).alias("module")).select("module", "leaf_id").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches; a link to itself counts as an edge."""
    return nodes.select("node").distinct().join(edges.select(F.explode(F.array("src", "dst")).alias("node")), "node", "left_anti")


def _rounds(max_rounds: int | None) -> Iterator[int]:
    """1, 2, ... for a loop that ends by itself; an error, never a partial result, where a bound is given and met."""
    yield from itertools.count(1) if max_rounds is None else range(1, max_rounds + 1)
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def _trimmed(left: DataFrame, max_rounds: int | None) -> tuple[DataFrame, int]:
    """Edges left when those of nodes without incoming or without outgoing edges are taken away until none is left."""
    n = left.count()
    for _ in _rounds(max_rounds):
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = cut(kept.select("src", "dst"))
        m = left.count()
        if m == n:
            return left, m
        n = m
    return left, n


def cycle_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle; a component is a set of nodes that all reach each other, named by one
    of them. A link to itself is a cycle of one.

    Strongly connected components by colouring: after trimming, every node takes the greatest (hash, name) that reaches it;
    the nodes of a colour that reach its owner backwards are a component. What lies in none is coloured again.
    """
    left, n = _trimmed(cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct()), max_rounds)
    own = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("name"))
    found = None
    for _ in _rounds(max_rounds):
        if n == 0:
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        color = cut(nodes.select("node", own("node").alias("c")))
        for _ in _rounds(max_rounds):
            brought = left.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("b"))
            nxt = cut(color.join(brought, "node", "left").select("node", F.greatest("c", "b").alias("c"), (F.col("b") > F.col("c")).alias("grew")))
            color = nxt.select("node", "c")
            if nxt.where("grew").isEmpty():
                break
        same = cut(left.join(color.toDF("src", "a"), "src").join(color.toDF("dst", "b"), "dst").where(F.col("a") == F.col("b")).select("src", "dst"))
        reached = frontier = cut(color.where(F.col("c.name") == F.col("node")).select("node", F.col("node").alias("component")))
        for _ in _rounds(max_rounds):
            back = same.join(frontier.select(F.col("node").alias("dst"), "component"), "dst").select(F.col("src").alias("node"), "component").distinct()
            frontier = cut(back.join(reached.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionByName(frontier))
        alone = reached.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("component")
        loops = same.where("src = dst").select(F.col("src").alias("component")).distinct()
        cyclic = reached.join(alone.join(loops, "component", "left_anti"), "component", "left_anti").select("node", "component")
        found = cyclic if found is None else found.unionByName(cyclic)
        rest = left.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
        left, n = _trimmed(cut(rest.select("src", "dst")), max_rounds)
    if found is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component"))
    return found


def cycle_nodes(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node): nodes that lie on a cycle, see cycle_components."""
    return cycle_components(edges, max_rounds).select("node")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, node): a path of fewest edges, the smallest names first among equals; no row if there is none. Breadth first from
    the source until the target is met, then back along the nodes a hop nearer.
    """
    reached = frontier = cut(edges.sparkSession.createDataFrame([(source, 0)], "node string, hops int"))
    for hop in itertools.count(1):
        if not frontier.where(F.col("node") == target).isEmpty():
            break
        nxt = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = cut(nxt.join(reached.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return reached.limit(0).select(F.col("hops").alias("step"), "node")
        reached = reached.unionByName(frontier)
    at, path = target, [target]
    for back in range(hop - 2, -1, -1):  # one lookup a hop: the path is the result, not a group
        at = reached.where(F.col("hops") == back).join(edges.where(F.col("dst") == at).select(F.col("src").alias("node")), "node").agg(F.min("node")).first()[0]
        path.append(at)
    return edges.sparkSession.createDataFrame(list(enumerate(reversed(path))), "step int, node string")


def distances(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(source, node, hops): shortest number of edges from each source to each node it reaches; breadth first, a round per hop."""
    reached = frontier = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct())
    for hop in _rounds(max_rounds):
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = cut(nxt.join(reached.select("source", "node"), ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if hop % 50 == 0:
            reached = cut(reached)  # keeps the plan of a long chain short
    return reached


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, links to themselves."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_links")).crossJoin(F.broadcast(nodes))  # one row each
