"""More on graphs: groups, weighted and personalised ranks, cuts, flows, timed and typed networks, benchmark graphs.

What follows whole paths through a graph (cuts, flows, community benchmarks) works on one component or graph in pandas; the
size that a task may get is a parameter and is checked.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators import graph as g
from gleaner.session import discard, materialize

#: Edges of a graph or component that one task may get.
TASK_EDGES = 2_000_000


def group_degree_centrality(edges: DataFrame, group: DataFrame) -> DataFrame:
    """One row (centrality): nodes outside group(id) that have a neighbour in it, over all nodes outside."""
    near = g.both_ways(edges).join(group.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    out = near.join(group.select("id"), "id", "left_anti").agg(F.count("*").alias("n"))
    rest = g.nodes_of(edges).join(group.select("id"), "id", "left_anti").agg(F.count("*").alias("all"))
    return out.crossJoin(rest).select((F.col("n") / F.nullif(F.col("all"), F.lit(0))).alias("centrality"))


def group_closeness(edges: DataFrame, group: DataFrame) -> DataFrame:
    """One row (closeness): nodes outside group(id) over the sum of their hops to it; nodes that can't reach it don't count."""
    one = group.select(F.lit(0).cast("long").alias("source"), "id")
    adj, _ = materialize(g.both_ways(edges), "adj")
    reached, _ = materialize(one.withColumn("hop", F.lit(0)), "hops")
    frontier, hop = reached, 0
    while True:
        hop += 1
        step = frontier.join(adj, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        frontier, _ = materialize(step.select(F.lit(0).cast("long").alias("source"), "id", F.lit(hop).alias("hop")), "hops")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("hop > 0").agg((F.count("*") / F.nullif(F.sum("hop"), F.lit(0))).alias("closeness"))


def weighted_page_rank(arcs: DataFrame, nodes: DataFrame, restart: DataFrame | None = None, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """Rows (id, rank) along arcs (src, dst, weight); what leaks goes to all nodes evenly, or to restart(id) evenly, which makes it personalised."""
    spark = arcs.sparkSession
    out = arcs.groupBy("src").agg(F.sum("weight").alias("out"))
    shares, shares_path = materialize(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "arcs")
    home = nodes.select("id") if restart is None else restart.select("id").distinct()
    n = max(home.count(), 1)
    base, base_path = materialize(nodes.join(home.withColumn("h", F.lit(1.0 / n)), "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h")), "home")
    now, path = materialize(base.select("id", F.col("h").alias("rank")), "rank")
    for _ in range(rounds):
        got = shares.join(now, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.lit(damping) * F.col("rank") * F.col("share")).alias("got"))
        nxt, nxt_path = materialize(base.join(got, F.col("id") == F.col("dst"), "left").select("id", "h", F.coalesce("got", F.lit(0.0)).alias("got")), "rank")
        leak = 1.0 - (nxt.agg(F.sum("got")).first()[0] or 0.0)
        discard(spark, path)
        now, path = nxt.select("id", (F.col("got") + F.lit(leak) * F.col("h")).alias("rank")), nxt_path
    return now


def triad_participation(edges: DataFrame) -> DataFrame:
    """Rows (triangles, nodes): how many nodes are in so many triangles, zero included."""
    return g.clustering(edges).groupBy("triangles").agg(F.count("*").alias("nodes"))


def two_paths(edges: DataFrame) -> DataFrame:
    """Rows (id, paths): pairs of neighbours of each node, that is paths of two edges through it."""
    d = F.col("degree")
    return g.degrees(edges).select("id", (d * (d - 1) / 2).cast("long").alias("paths"))


def _by_component(edges: DataFrame, work, schema: str, most: int) -> DataFrame:
    labels, _ = materialize(g.components(edges), "labels")
    tagged = edges.join(labels, F.col("src") == F.col("id")).select("component", "src", "dst")
    large = tagged.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if not large.isEmpty():
        raise ValueError(f"a component has more than {most} edges")
    return tagged.groupBy("component").applyInPandas(work, schema)


def max_flow(arcs: pd.DataFrame, source: int, sink: int) -> float:
    """Largest flow over directed arcs (src, dst, capacity), by shortest augmenting paths."""
    left: dict[int, dict[int, float]] = {}
    for a, b, c in arcs[["src", "dst", "capacity"]].itertuples(index=False):
        left.setdefault(int(a), {})[int(b)] = left.get(int(a), {}).get(int(b), 0.0) + float(c)
        left.setdefault(int(b), {}).setdefault(int(a), 0.0)
    total = 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for u, c in left.get(v, {}).items():
                if c > 1e-12 and u not in came:
                    came[u] = v
                    queue.append(u)
        if sink not in came or source == sink:
            return total
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        push = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= push
            left[b][a] += push
        total += push


def core_periphery(edges: DataFrame) -> DataFrame:
    """One row (core_size, z): the core that leaves the fewest wrong pairs, that is core pairs without an edge and periphery pairs with one.

    With the k nodes of largest degree as the core, that number is z(k) = k (k - 1) / 2 + m - (sum of their degrees). Among nodes of one degree d it is
    convex in k and least at k = d, or at the end nearest to it, so a row a degree is enough; of equal ones the smallest core counts.
    """
    d = F.col("degree")
    each = g.degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)  # a row a degree
    sums = each.select("degree", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum(d * F.col("n")).over(before), F.lit(0)).alias("d0"), (F.sum(d * F.col("n")).over(Window.partitionBy()) / 2).alias("m"))
    k = F.least(F.greatest(d, F.col("k0") + 1), F.col("k0") + F.col("n"))
    z = k * (k - 1) / 2 + F.col("m") - F.col("d0") - d * (k - F.col("k0"))
    best = sums.select(z.alias("z"), k.alias("core_size")).agg(F.min(F.struct("z", "core_size")).alias("b"))
    return best.select(F.coalesce("b.core_size", F.lit(0)).cast("long").alias("core_size"), F.coalesce("b.z", F.lit(0.0)).alias("z"))


def core_fit(edges: DataFrame, core: DataFrame) -> DataFrame:
    """One row (correlation): of edges with the ideal pattern in which exactly the pairs with an end in core(id) are linked, over all pairs of nodes."""
    n = g.nodes_of(edges).agg(F.count("*").cast("double").alias("n"))
    k = g.nodes_of(edges).join(core.select("id"), "id", "left_semi").agg(F.count("*").cast("double").alias("k"))
    out = g.without_nodes(edges, core).agg(F.count("*").cast("double").alias("out"))
    one = edges.agg(F.count("*").cast("double").alias("a")).crossJoin(n).crossJoin(k).crossJoin(out)
    p, rest = F.col("n") * (F.col("n") - 1) / 2, F.col("n") - F.col("k")
    ideal = p - rest * (rest - 1) / 2
    top = p * (F.col("a") - F.col("out")) - F.col("a") * ideal
    return one.select((top / F.nullif(F.sqrt((p * F.col("a") - F.col("a") * F.col("a")) * (p * ideal - ideal * ideal)), F.lit(0.0))).alias("correlation"))


def weighted_closeness(distances: DataFrame, n_nodes: int) -> DataFrame:
    """Rows (source, farness, closeness) from weighted_distances(): mean distance to the other nodes reached, and its inverse, scaled by the share reached."""
    own = distances.groupBy("source").agg((F.count("*") - 1).alias("r"), F.sum("distance").alias("total"))
    far = F.when(F.col("r") > 0, F.col("total") / F.col("r")).otherwise(0.0)
    return own.select("source", far.alias("farness"), F.when(far > 0, F.col("r") / (n_nodes - 1) / far).otherwise(0.0).alias("closeness"))


def covering_group(edges: DataFrame, size: int) -> DataFrame:
    """Rows (rank, id, gain): greedily the node that adds most nodes to those that the group holds or touches; ties go to the smallest id."""
    spark = edges.sparkSession
    reach = g.both_ways(edges).unionByName(g.nodes_of(edges).select(F.col("id").alias("src"), F.col("id").alias("dst")))
    left, path = materialize(reach, "cover")
    found: list[tuple[int, int, int]] = []
    for rank in range(1, size + 1):
        best = left.groupBy("src").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("src")).alias("i"))).alias("b")).select("b.n", "b.i").first()
        if best["n"] is None:
            break
        found.append((rank, -best["i"], best["n"]))
        covered = left.where(F.col("src") == -best["i"]).select("dst")
        nxt, nxt_path = materialize(left.join(covered, "dst", "left_anti").select("src", "dst"), "cover")
        discard(spark, path)
        left, path = nxt, nxt_path
    return spark.createDataFrame(found, "rank int, id long, gain long")


def split_communities(edges: pd.DataFrame) -> pd.DataFrame:
    """Communities of one small graph by taking away the edge of most shortest paths again and again, at the stage of largest modularity (rows id, community)."""
    near: dict[int, set[int]] = {}
    for a, b in edges[["src", "dst"]].itertuples(index=False):
        near.setdefault(int(a), set()).add(int(b))
        near.setdefault(int(b), set()).add(int(a))
    degree, m = {v: len(u) for v, u in near.items()}, len(edges)
    whole = [(int(a), int(b)) for a, b in edges[["src", "dst"]].itertuples(index=False)]

    def parts() -> dict[int, int]:
        label: dict[int, int] = {}
        for root in sorted(near):
            todo = [root] if root not in label else []
            while todo:
                v = todo.pop()
                if v not in label:
                    label[v] = root
                    todo += near[v]
        return label

    def quality(label: dict[int, int]) -> float:
        weight: dict[int, int] = {}
        for v, c in label.items():
            weight[c] = weight.get(c, 0) + degree[v]
        return sum(label[a] == label[b] for a, b in whole) / m - sum((w / (2 * m)) ** 2 for w in weight.values())

    def busiest() -> tuple[int, int]:
        load = {(a, b): 0.0 for a in near for b in near[a] if a < b}
        for s in near:
            level, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for u in near[v]:
                    if u not in level:
                        level[u] = level[v] + 1
                        queue.append(u)
                    if level[u] == level[v] + 1:
                        paths[u] = paths.get(u, 0.0) + paths[v]
            flow = dict.fromkeys(order, 1.0)
            for v in reversed(order):
                for u in near[v]:
                    if level[u] == level[v] - 1:
                        share = flow[v] * paths[u] / paths[v]
                        load[min(u, v), max(u, v)] += share
                        flow[u] += share
        return max(sorted(load), key=lambda e: round(load[e], 9))

    best = parts()
    score = quality(best)
    while any(near.values()):
        a, b = busiest()
        near[a].discard(b)
        near[b].discard(a)
        now = parts()
        if (value := quality(now)) > score + 1e-12:
            best, score = now, value
    return pd.DataFrame(sorted(best.items()), columns=["id", "community"])


def split_communities_by_component(edges: DataFrame, most: int = 2_000) -> DataFrame:
    """split_communities of each component, one a task, of at most `most` edges: the work grows with the cube of a component."""
    return _by_component(edges, split_communities, "id long, community long", most)


def singular_values(edges: DataFrame, k: int, rounds: int = 30, seed: int = 1) -> DataFrame:
    """Rows (rank, value): the k largest singular values of the adjacency matrix, by power iterations with deflation as joins of (id, value)."""
    adj, _ = materialize(g.both_ways(edges), "adj")
    nodes = g.nodes_of(edges)
    found: list[tuple[int, float]] = []
    kept: list[DataFrame] = []
    for rank in range(k):
        now, _ = materialize(g._unit(nodes.select("id", (F.xxhash64("id", F.lit(seed + rank)) / F.lit(2.0**63)).alias("value")), "value"), "vector")
        value = 0.0
        for _ in range(rounds):
            got = adj.join(now, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.sum("value").alias("value"))
            for other in kept:
                along = got.join(other.withColumnRenamed("value", "o"), "id").agg(F.sum(F.col("value") * F.col("o"))).first()[0] or 0.0
                got = got.join(other.withColumnRenamed("value", "o"), "id").select("id", (F.col("value") - F.lit(along) * F.col("o")).alias("value"))
            got, _ = materialize(got, "vector")
            value = got.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 0.0
            if value == 0.0:
                break
            now = got.withColumn("value", F.col("value") / F.lit(value))
        found.append((rank + 1, float(value)))
        kept.append(now)
    return edges.sparkSession.createDataFrame(found, "rank int, value double")


# Timed and typed networks


def time_buckets(edges: DataFrame, unit: str = "day", cumulative: bool = False) -> DataFrame:
    """Rows (bucket, edges) of edges (src, dst, ts); cumulative: the edges up to each bucket's end."""
    each = edges.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("edges"))
    if not cumulative:
        return each
    return each.select("bucket", F.sum("edges").over(Window.orderBy("bucket")).alias("edges"))  # a row a bucket


def up_to(edges: DataFrame, ts: str) -> DataFrame:
    return edges.where(F.col("ts") <= F.lit(ts).cast("timestamp"))


def node_times(edges: DataFrame) -> DataFrame:
    """Rows (id, ts): when each node has its first edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "ts").groupBy("id").agg(F.min("ts").alias("ts"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each undirected pair."""
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return edges.select(*pair, "ts").groupBy("src", "dst").agg(F.min("ts").alias("ts"))


def growth(edges: DataFrame, unit: str = "day") -> DataFrame:
    """Rows (bucket, nodes, edges): new nodes and new pairs a bucket."""
    n = node_times(edges).groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("nodes"))
    e = first_edges(edges).groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("edges"))
    return n.join(e, "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("nodes", "edges")))


def typed_network(modes: dict[str, DataFrame], links: dict[tuple[str, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One network of node tables (id) by mode and link tables (src, dst) by pair of modes: nodes (mode, id) and edges (src_mode, src, dst_mode, dst)."""
    nodes = None
    for mode, df in modes.items():
        own = df.select(F.lit(mode).alias("mode"), "id")
        nodes = own if nodes is None else nodes.unionByName(own)
    edges = None
    for (a, b), df in links.items():
        own = df.select(F.lit(a).alias("src_mode"), "src", F.lit(b).alias("dst_mode"), "dst")
        edges = own if edges is None else edges.unionByName(own)
    return nodes, edges


def typed_subgraph(edges: DataFrame, modes: Sequence[str]) -> DataFrame:
    return edges.where(F.col("src_mode").isin(list(modes)) & F.col("dst_mode").isin(list(modes)))


def community_benchmark(n: int, mean_degree: float, max_degree: int, mixing: float, sizes: tuple[int, int], seed: int, degree_power: float = 2.0, size_power: float = 1.0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(edges, communities) of a random graph with power-law degrees and community sizes, a share `mixing` of each node's edges leading out.

    Stubs are matched at random within a community and between communities; loops and repeats are dropped, so degrees fall a little short.
    """
    rng = np.random.Generator(np.random.PCG64(seed))

    def power(lo: float, hi: float, p: float, k: int) -> np.ndarray:
        x = np.arange(int(lo), int(hi) + 1)
        w = x.astype(float) ** -p
        return rng.choice(x, size=k, p=w / w.sum())

    least = 1
    while least < max_degree and power(least, max_degree, degree_power, 4000).mean() < mean_degree:
        least += 1
    degree = power(least, max_degree, degree_power, n)
    owner = np.empty(n, np.int64)
    order, at, c = rng.permutation(n), 0, 0
    while at < n:
        k = int(power(*sizes, size_power, 1)[0])
        k = n - at if n - at - k < sizes[0] else k
        owner[order[at : at + k]] = c
        at, c = at + k, c + 1
    inner = np.rint(degree * (1 - mixing)).astype(int)
    pairs: set[tuple[int, int]] = set()

    def match(stubs: np.ndarray, allowed) -> None:
        stubs = rng.permutation(stubs)
        for a, b in zip(stubs[::2].tolist(), stubs[1::2].tolist()):
            if a != b and allowed(a, b):
                pairs.add((min(a, b), max(a, b)))

    for i in range(c):
        own = np.flatnonzero(owner == i)
        match(np.repeat(own, np.minimum(inner[own], len(own) - 1)), lambda a, b: True)
    match(np.repeat(np.arange(n), degree - inner), lambda a, b: owner[a] != owner[b])
    return pd.DataFrame(sorted(pairs), columns=["src", "dst"]), pd.DataFrame({"id": np.arange(n), "community": owner})
