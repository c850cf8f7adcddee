"""Communities of undirected graphs, level by level: moves of nodes that raise a score, and then of the communities that they made, as nodes of a smaller graph.

The score is modularity, or the length of a random walk's description (the map equation), which differ in the change that a move makes and nothing else. Nodes move in rounds,
all at once. So that two don't change places, moves go to communities of smaller id in one round, and of larger hash in the next. Changes of single moves don't add up where many
go the same way, so a round counts only if the score has risen; else it is undone, and of the nodes that would move half as many may the next time.

Without weights, nodes start with their twins: those that are linked with each other and with the same other nodes. In the best modularity two of degree k are together if k * k < 2m,
as one of them would else gain by joining the other: both moves together bring (2m - k * k) / m^2. A complete graph by itself is one class of twins, and needs no moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.table import dealt, join_counted, tasks
from gleaner.session import discard, materialize, materialize_counted

#: A round must raise the score by this much, and so many rounds in a row may fail before a level is done.
LEAST_GAIN = 1e-9
PATIENCE = 3
#: A level is left for the next one when a round raises the score by less than this share of what the level has raised it; the last level is one where nothing moves.
SLOW = 0.001


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(F.greatest(x, F.lit(1e-300)))).otherwise(0.0)


@dataclass(frozen=True)
class Score:
    """of: the score of communities (total, cut) and the sum of their cuts; gain: the change by a move of a node between two of them.

    total: weights at the community's nodes (a link within counts twice, as its two ends do); cut: weights of links that leave it; m: all weights.
    """

    of: Callable[[DataFrame, float], tuple[float, float]]
    gain: Callable[[float, float], Column]


def _modularity(groups: DataFrame, m: float) -> tuple[float, float]:
    inner = (F.col("total") - F.col("cut")) / (2 * m)
    return tuple(groups.agg(F.sum(inner - F.pow(F.col("total") / (2 * m), F.lit(2.0))), F.sum("cut")).first())


def _modularity_gain(m: float, leaving: float) -> Column:
    k = F.col("k")
    return (F.col("w") - F.col("own")) / m - k * (F.col("total2") - F.col("total1") + k) / (2 * m * m)


def _shortness(groups: DataFrame, m: float) -> tuple[float, float]:
    """The negative length of the description, without the part that all communities share, the nodes' own entropy."""
    cut, total = F.col("cut") / (2 * m), F.col("total") / (2 * m)
    rest, leaving = groups.agg(F.sum(_plogp(cut + total) - 2 * _plogp(cut)), F.sum("cut")).first()
    q = leaving / (2 * m)
    return -(rest + (q * math.log2(q) if q > 0 else 0.0)), leaving


def _shortness_gain(m: float, leaving: float) -> Column:
    s = 2 * m
    one, two, out = F.col("cut1"), F.col("cut2"), F.col("out")
    one_, two_ = one - out + 2 * F.col("own"), two + out - 2 * F.col("w")
    q, q_ = F.lit(leaving / s), (F.lit(leaving) + one_ + two_ - one - two) / s
    cuts = _plogp(one_ / s) + _plogp(two_ / s) - _plogp(one / s) - _plogp(two / s)
    k, t1, t2 = F.col("k"), F.col("total1"), F.col("total2")
    both = _plogp((one_ + t1 - k) / s) + _plogp((two_ + t2 + k) / s) - _plogp((one + t1) / s) - _plogp((two + t2) / s)
    return -(_plogp(q_) - _plogp(q) - 2 * cuts + both)


MODULARITY = Score(_modularity, _modularity_gain)
MAP_EQUATION = Score(_shortness, _shortness_gain)


def links_of(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows (src, dst, w), src < dst: different pairs with the sum of their weights, which must be positive, or with 1; loops and nulls are ignored."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    return dealt(pairs, "src", "dst").groupBy("src", "dst").agg((F.max("w") if weight is None else F.sum("w")).alias("w"))


def contract(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (src, dst, w) between the communities of labels(id, community), with summed weights; links within one go."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("a")), labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    ends = links.join(a, "src").join(b, "dst").where("a <> b")
    return ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w"))


def _near(both: DataFrame, n: int, degree: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (id, community, k, out, c, w): what each node is linked with in each community that it touches; null c for a node without links. A hub's links are dealt to several tasks."""
    here = state.select(F.col("id").alias("dst"), F.col("community").alias("c")).join(degree, "dst")
    touch = join_counted(both, here, "dst", n, "src").groupBy("src", "c").agg(F.sum("w").alias("w"))
    return state.join(touch, state["id"] == touch["src"], "left").select("id", "community", "k", "out", "c", "w")


def _level(links: DataFrame, nodes: DataFrame, m: float, score: Score, most_rounds: int, seed: int) -> tuple[DataFrame, str, float]:
    """(labels, their folder, score): nodes(id, k, out), each a community at first, after rounds of moves; labels (id, community)."""
    spark = links.sparkSession
    both, both_path, n = materialize_counted(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "both")
    degree, degree_path = materialize(both.groupBy("dst").agg(F.count("*").alias("n")), "degree")
    state, path = materialize(nodes.select("id", F.col("id").alias("community"), "k", "out"), "state")
    best, kept, failed, halvings, tables, paths, first, slow = None, state, 0, 1, (), [path], 0.0, False
    for at in range(most_rounds):
        if state is not kept or best is None:
            near, near_path = materialize(_near(both, n, degree, state), "near")
            own = near.where("c = community").select("id", F.col("w").alias("own"))
            inner = near.where("c = community").groupBy("community").agg(F.sum("w").alias("inner"))
            sums = state.groupBy("community").agg(F.sum("k").alias("total"), F.sum("out").alias("leaving"))
            groups, groups_path = materialize(sums.join(inner, "community", "left").select("community", "total", (F.col("leaving") - F.coalesce("inner", F.lit(0.0))).alias("cut")), "groups")
            now, leaving = score.of(groups, m)
            if best is None or now > best + LEAST_GAIN:
                if best is not None:
                    discard(spark, *paths)
                first, slow = (now, False) if best is None else (first, now - best < SLOW * (now - first))
                best, kept, failed, halvings, tables, paths = now, state, 0, max(halvings - 1, 0), (near, own, groups, leaving), [path, near_path, groups_path]
            else:
                discard(spark, path, near_path, groups_path)
                failed, halvings = failed + 1, halvings + 1
        if failed >= PATIENCE or slow:
            break
        near, own, groups, leaving = tables
        one = groups.select("community", F.col("total").alias("total1"), F.col("cut").alias("cut1"))
        two = groups.select(F.col("community").alias("c"), F.col("total").alias("total2"), F.col("cut").alias("cut2"))
        tried = near.where("c <> community").join(one, "community").join(two, "c").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
        tried = tried.withColumn("gain", score.gain(m, leaving)).where(F.col("gain") > LEAST_GAIN)
        wish = tried.groupBy("id", "community").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b")).select("id", "community", (-F.col("b.c")).alias("to"))
        rank = [F.xxhash64(c, F.lit(seed + at)) for c in ("community", "to")]
        goes = (F.col("to") < F.col("community") if at % 2 == 0 else rank[0] < rank[1]) & (F.pmod(F.xxhash64("id", F.lit(-seed - at)), F.lit(1 << halvings)) == 0)
        wish, wish_path, n_wish = materialize_counted(wish.withColumn("goes", goes), "wish")
        if not n_wish:
            discard(spark, wish_path)
            break
        if wish.where("goes").isEmpty():
            state, halvings = kept, max(halvings - 1, 0)
        else:
            to = wish.where("goes").select("id", "to")
            state, path = materialize(kept.join(to, "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k", "out"), "state")
        discard(spark, wish_path)
    labels, labels_path = materialize(kept.select("id", "community"), "labels")
    discard(spark, both_path, degree_path, *paths)
    return labels, labels_path, best


def _twins(links: DataFrame, n: int) -> DataFrame:
    """Rows (id, community, k, n) of n links of weight 1: a node's degree, the least of its twins or itself, and how many they are. Neighbours are told apart by two hashes of 64 bits."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*")
    parts, seen = tasks(links.sparkSession, 2 * n), [F.xxhash64("other", F.lit(i)) for i in (1, 2)]
    nodes = ends.repartition(parts, "id").groupBy("id").agg(F.count("*").cast("double").alias("k"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(seen)))
    closed = nodes.select("id", "k", *(F.col(f"h{i}").bitwiseXOR(F.xxhash64("id", F.lit(i + 1))).alias(f"h{i}") for i in (0, 1)))
    same, small = Window.partitionBy("h0", "h1"), F.col("k") * F.col("k") < 2 * n
    found = closed.repartition(parts, "h0", "h1").select("id", "k", F.min("id").over(same).alias("least"), F.count("*").over(same).alias("n"))
    return found.select("id", F.when(small, F.col("least")).otherwise(F.col("id")).alias("community"), "k", F.when(small, F.col("n")).otherwise(F.lit(1)).alias("n"))


def multilevel(edges: DataFrame, score: Score = MODULARITY, weight: str | None = None, most_rounds: int = 20, seed: int = 1) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """(labels, levels): rows (id, community), named by the smallest id in it, and for each level how many communities there are and their score.

    Level 0 is every node by itself; without weights, level 1 is twins together, if there are any and that doesn't lower the score. The score never falls from level to level. edges(src, dst[, weight]) have no direction; repeated ones count once without weights, and add up with them.
    A node without links isn't returned. No edges give no rows and one level, of no communities.
    """
    spark = edges.sparkSession
    links, path, n = materialize_counted(links_of(edges, weight), "links")
    if n and weight is None:
        twins, twins_path, count = materialize_counted(_twins(links, n), "twins")
        first = twins.where("id = community").select("id", (F.col("n") * F.col("k")).alias("k"), (F.col("n") * (F.col("k") - F.col("n") + 1)).alias("out"))
        m, labels, labels_path = float(n), twins.select("id", "community"), twins_path
        alone = score.of(twins.select(F.col("k").alias("total"), F.col("k").alias("cut")), m)[0]
        levels, classes = [(0, count, alone)], first.count()
        reached = score.of(first.select(F.col("k").alias("total"), F.col("out").alias("cut")), m)[0]
        if classes < count and reached >= alone:
            levels.append((1, classes, reached))
            open_ = twins.where("n <= k")
            if open_.isEmpty():
                discard(spark, path)
                return labels, levels
            near = links.join(open_.select(F.col("id").alias("src")), "src", "left_semi")
            smaller, smaller_path, n = materialize_counted(contract(near, open_.select("id", "community")), "links")
            discard(spark, path)
            links, path, count = smaller, smaller_path, classes
        else:
            first, labels = twins.select("id", "k", F.col("k").alias("out")), twins.select("id", F.col("id").alias("community"))
        nodes, nodes_path = materialize(first, "nodes")
    else:
        ends = links.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("k"))
        nodes, nodes_path, count = materialize_counted(ends.select("id", "k", F.col("k").alias("out")), "nodes")
        labels, labels_path = materialize(nodes.select("id", F.col("id").alias("community")), "members")
        if not n:
            return labels, [(0, 0, 0.0)]
        m = links.agg(F.sum("w")).first()[0]
        levels = [(0, count, score.of(nodes.select(F.col("k").alias("total"), F.col("k").alias("cut")), m)[0])]
    while n:
        own, own_path, reached = _level(links, nodes, m, score, most_rounds, seed + 1000 * len(levels))
        sums = nodes.join(own, "id").groupBy("community").agg(F.sum("k").alias("k"))
        smaller, smaller_path, n = materialize_counted(contract(links, own), "links")
        cut = smaller.select(F.explode(F.array("src", "dst")).alias("community"), "w").groupBy("community").agg(F.sum("w").alias("out"))
        merged, merged_path, left = materialize_counted(sums.join(cut, "community", "left").select(F.col("community").alias("id"), "k", F.coalesce("out", F.lit(0.0)).alias("out")), "nodes")
        if left == count:
            discard(spark, own_path, smaller_path, merged_path)
            break
        up = own.select(F.col("id").alias("community"), F.col("community").alias("above"))
        members, members_path = materialize(labels.join(up, "community").select("id", F.col("above").alias("community")), "members")
        discard(spark, own_path, path, nodes_path, labels_path)
        links, path, nodes, nodes_path, labels, labels_path, count = smaller, smaller_path, merged, merged_path, members, members_path, left
        levels.append((len(levels), count, reached))
    least = labels.groupBy("community").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out, _ = materialize(join_counted(labels, least, "community", labels.count(), "id").select("id", F.col("least").alias("community")), "communities")
    discard(spark, path, nodes_path, labels_path)
    return out, levels


def code_length(edges: DataFrame, labels: DataFrame, weight: str | None = None) -> DataFrame:
    """One row (code_length): bits a step that describe a random walk by labels(id, community), community by community (the map equation of two levels)."""
    links = links_of(edges, weight)
    at = links.select(F.col("src").alias("id"), F.col("dst").alias("other"), "w").unionByName(links.select(F.col("dst").alias("id"), F.col("src").alias("other"), "w"))
    mine, theirs = labels.select("id", F.col("community").alias("a")), labels.select(F.col("id").alias("other"), F.col("community").alias("b"))
    ends = at.join(mine, "id").join(theirs, "other")
    s = at.agg(F.sum("w").alias("s"))
    groups = ends.groupBy("a").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)).alias("cut")).crossJoin(s)  # a row
    cut, total = F.col("cut") / F.col("s"), F.col("total") / F.col("s")
    modules = groups.agg(_plogp(F.sum(cut)).alias("q"), F.sum(_plogp(cut + total) - 2 * _plogp(cut)).alias("rest"))
    nodes = at.groupBy("id").agg(F.sum("w").alias("k")).crossJoin(s).agg(F.sum(_plogp(F.col("k") / F.col("s"))).alias("nodes"))
    return modules.crossJoin(nodes).select((F.col("q") + F.col("rest") - F.col("nodes")).alias("code_length"))
