"""Clusters from matching pairs: components, centroid linkage, confidence (L1-L5), W1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.sources.lineage import cut_lineage, stored

#: ``left_id, right_id`` -> ``left_id, right_id, score``
Scorer = Callable[[DataFrame], DataFrame]


def connected_components(edges: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """L1: ``record_id, component`` for every record on an edge; a component is named by its smallest id.

    Alternating star contraction: every node points its larger neighbours at
    the smallest one it knows, first by larger then by smaller neighbours, so
    the number of rounds grows with the logarithm of the component size.  A
    node with very many neighbours is a join against one stored row per node:
    both sides are exchanged, so adaptive execution can split the node's rows.
    """
    links = cut_lineage(_canonical(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))))
    while True:
        after = cut_lineage(_small_star(_large_star(links)))
        same = after.count() == links.count() and after.join(links, ["u", "v"], "left_anti").isEmpty()
        links = after
        if same:
            break
    roots = links.select(F.col("v").alias("record_id")).distinct().select("record_id", F.col("record_id").alias("component"))
    return links.select(F.col("u").alias("record_id"), F.col("v").alias("component")).unionByName(roots)


def _canonical(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller), without loops or repeats."""
    return (edges.filter(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
    return _canonical(both.join(low, "u").filter(F.col("v") > F.col("u"))
                      .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    # every edge is (larger, smaller): the smaller neighbours of u are exactly its v
    low = stored(links.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _canonical(moved.unionByName(low.select("u", F.col("m").alias("v"))))


def agglomerate(items: DataFrame, edges: DataFrame, threshold: float, scorer: Scorer | None = None) -> DataFrame:
    """L2-L4: ``record_id, cluster_id, confidence_score`` by centroid linkage, one rule for components of every size.

    ``items`` has ``record_id, copies, own``: how many identical records an item
    stands for and the score of two of them.  ``edges`` has ``left_id, right_id,
    score``; the distance of a scored pair is ``1 - score``.  ``scorer`` turns
    ``left_id, right_id`` into these columns for pairs that are no edges; without
    one their distance is 1.

    The squared distance of two centroids is the mean squared distance between
    their members minus the variance of either cluster, so sums per cluster and
    per pair of clusters are all that is kept.  In a round every cluster finds
    its nearest neighbour among those it has edges with, and mutual
    nearest ones no farther apart than ``1 - threshold`` merge.  Ties are broken
    by a hash of the pair, so that a mass of equal distances merges in a
    logarithmic number of rounds.

    Missing scores are asked for as late as possible: only between two clusters
    that could be nearest if all their unscored pairs were equal, and would not
    surely be farther apart than another neighbour if these had nothing in common.
    """
    limit2 = (1 - threshold) ** 2
    weight = stored(items.select("record_id", F.col("copies").cast("double").alias("w")), "weights")
    pairs = stored(_weighted(edges, weight), "edges")
    # s: what the known pairs take off the squared distance 1, k: how many known pairs of records
    links = stored(pairs.select("a", "b", (F.col("near") * F.col("wa") * F.col("wb")).alias("s"), (F.col("wa") * F.col("wb")).alias("k")), "links")
    # w: records, q: sum of squared weights, s: sum over the pairs inside
    state = stored(weight.select(F.col("record_id").alias("c"), "w", (F.col("w") * F.col("w")).alias("q"), F.lit(0.0).alias("s")), "clusters")
    label = stored(weight.select("record_id", F.col("record_id").alias("c")), "labels")
    while True:
        close = stored(_close(links, state, limit2, scorer is not None), "close")
        if scorer is not None:
            wanted = stored(_open_links(close), "open-links")
            if not wanted.isEmpty():
                found = stored(_weighted(scorer(_unscored(wanted, label, pairs)), weight), "edges")
                pairs, links = pairs.unionByName(found), stored(_with_scores(links, found, label), "links")
                close = stored(_close(links, state, limit2, True), "close")
        merged = stored(_mutual_nearest(close), "merged")
        if merged.isEmpty():
            break
        inside = merged.select(F.col("keep").alias("c"), F.lit(0.0).alias("w"), F.lit(0.0).alias("q"), "s")
        state = stored(_renamed(state, merged, "c").unionByName(inside).groupBy("c")
                       .agg(F.sum("w").alias("w"), F.sum("q").alias("q"), F.sum("s").alias("s")), "clusters")
        moved = _renamed(_renamed(links, merged, "a"), merged, "b").filter(F.col("a") != F.col("b"))
        links = stored(_summed(moved), "links")
        label = stored(_renamed(label, merged, "c"), "labels")
    return _confidences(items, pairs, label, state)


def _weighted(edges: DataFrame, weight: DataFrame) -> DataFrame:
    """``a, b, near, wa, wb`` of scored pairs; ``near`` is what a pair takes off the squared distance 1."""
    near = 1 - (1 - F.col("score")) * (1 - F.col("score"))
    return (edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), near.alias("near"))
            .join(weight.select(F.col("record_id").alias("a"), F.col("w").alias("wa")), "a")
            .join(weight.select(F.col("record_id").alias("b"), F.col("w").alias("wb")), "b"))


def _summed(links: DataFrame) -> DataFrame:
    return links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("k").alias("k"))


def _close(links: DataFrame, state: DataFrame, limit2: float, asks: bool) -> DataFrame:
    """``a, b, s, open, low, order``: pairs of clusters that may merge.

    ``order`` begins with the squared distance if unscored pairs have nothing in
    common; ``low`` is that with equal ones, ``open`` whether there are any.
    """
    spread = ((F.col("w") * F.col("w") - F.col("q")) / 2 - F.col("s")) / (F.col("w") * F.col("w"))
    of = {x: state.select(F.col("c").alias(x), F.col("w").alias(f"w{x}"), spread.alias(f"v{x}")) for x in "ab"}
    full = F.col("wa") * F.col("wb")
    missing = F.greatest(full - F.col("k"), F.lit(0.0)) if asks else F.lit(0.0)
    high = 1 - F.col("s") / full - F.col("va") - F.col("vb")
    return (links.join(of["a"], "a").join(of["b"], "b")
            .select("a", "b", "s", (missing > 0.5).alias("open"), (high - missing / full).alias("low"),
                    F.struct(high.alias("d2"), F.xxhash64("a", "b").alias("h"), F.col("a").alias("a"), F.col("b").alias("b")).alias("order"))
            .filter(F.col("low") <= limit2))


def _ends(close: DataFrame, value: str) -> DataFrame:
    return close.select(F.col("a").alias("c"), value).unionByName(close.select(F.col("b").alias("c"), value))


def _open_links(close: DataFrame) -> DataFrame:
    """``a, b``: pairs of clusters with unscored pairs that could be the nearest ones of either cluster."""
    surely = stored(_ends(close, "order").groupBy("c").agg(F.min("order.d2").alias("d2")), "surely")
    of = {x: surely.select(F.col("c").alias(x), F.col("d2").alias(f"d{x}")) for x in "ab"}
    return (close.filter("open").join(of["a"], "a").join(of["b"], "b")
            .filter(F.col("low") <= F.greatest("da", "db") + 1e-12).select("a", "b"))


def _unscored(wanted: DataFrame, label: DataFrame, pairs: DataFrame) -> DataFrame:
    """``left_id, right_id``: the pairs of members of the wanted clusters that have no score yet."""
    x, y = (label.select(F.col("c").alias(c), F.col("record_id").alias(r)) for c, r in (("a", "x"), ("b", "y")))
    both = wanted.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.join(known, ["a", "b"], "left_anti").select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))


def _with_scores(links: DataFrame, found: DataFrame, label: DataFrame) -> DataFrame:
    """The links with the newly scored pairs of their clusters' members."""
    of = {x: label.select(F.col("record_id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"}
    more = found.join(of["a"], "a").join(of["b"], "b").select(
        F.col("ca").alias("a"), F.col("cb").alias("b"), (F.col("near") * F.col("wa") * F.col("wb")).alias("s"), (F.col("wa") * F.col("wb")).alias("k"))
    return _summed(links.unionByName(more))


def _renamed(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    names = merged.select(F.col("gone").alias(column), F.col("keep").alias("__keep"))
    return df.join(names, column, "left").withColumn(column, F.coalesce("__keep", column)).drop("__keep").select(df.columns)


def _mutual_nearest(close: DataFrame) -> DataFrame:
    """``keep, gone, s``: clusters to merge; the smaller id stays."""
    sure = close.filter("not open")
    nearest = stored(_ends(close, "order").groupBy("c").agg(F.min("order").alias("best")), "nearest")
    best = {x: nearest.select(F.col("c").alias(x), F.col("best").alias(f"best_{x}")) for x in "ab"}
    both = sure.join(best["a"], "a").join(best["b"], "b")
    return (both.filter((F.col("order") == F.col("best_a")) & (F.col("order") == F.col("best_b")))
            .select(F.least("a", "b").alias("keep"), F.greatest("a", "b").alias("gone"), "s"))


def _confidences(items: DataFrame, pairs: DataFrame, label: DataFrame, state: DataFrame) -> DataFrame:
    """L3: ``1 - sqrt(mean squared distance)`` to the other records of the cluster, 1 for a singleton."""
    of = {x: label.select(F.col("record_id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"}
    mates = pairs.join(of["a"], "a").join(of["b"], "b").filter(F.col("ca") == F.col("cb"))
    sides = mates.select(F.col("a").alias("record_id"), (F.col("near") * F.col("wb")).alias("near")).unionByName(
        mates.select(F.col("b").alias("record_id"), (F.col("near") * F.col("wa")).alias("near")))
    nears = stored(sides.groupBy("record_id").agg(F.sum("near").alias("near")), "nears")
    sizes = state.select("c", F.col("w").alias("records"))
    full = items.join(label, "record_id").join(nears, "record_id", "left").join(sizes, "c")
    own2 = (1 - F.col("own")) * (1 - F.col("own"))
    total = F.col("records") - F.col("copies") - F.coalesce("near", F.lit(0.0)) + (F.col("copies") - 1) * own2
    others = F.col("records") - 1
    score = F.when(others > 0, 1 - F.sqrt(F.greatest(total, F.lit(0.0)) / others)).otherwise(1.0)
    return full.select("record_id", F.col("c").alias("cluster_id"), score.alias("confidence_score"))


def with_cluster_size(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Rows of the cluster next to each row, NULL where there is no cluster.

    The sizes are aggregated before the shuffle, stored and joined back: as both
    sides are exchanged, a huge cluster, or a mass of rows without one, is split.
    """
    sizes = stored(df.filter(F.col(cluster).isNotNull()).groupBy(cluster)
                   .agg(F.count(F.lit(1)).alias("cluster_size")), "cluster-sizes")
    return df.join(sizes, cluster, "left")


def size_distribution(membership: DataFrame) -> DataFrame:
    """Clusters per cluster size."""
    return (membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("size").agg(F.count(F.lit(1)).alias("clusters")))
