"""Attributes, oracles and node features of a partly crawled graph, in closed form.

A state is the set of crawled nodes. Visible are the edges with a crawled end; a node's degree, neighbours and triangles are
those of the visible graph. Labels y are 1, 0 or null; features count null as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import columns as fn
from gleaner.operators import graph as g

FEATURES = ["od", "cc", "cnf", "tnf", "tri2", "tri1", "tri0"]


def attribute_domain(nodes: DataFrame, column: str) -> DataFrame:
    """Rows (pos, value): distinct values in order. A domain is a small table."""
    values = nodes.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    from gleaner.operators.table import row_numbers

    return row_numbers(values, ["value"], "pos").select("pos", "value")


def attribute_oracle(nodes: DataFrame, column: str, target, domain: Sequence | None = None) -> DataFrame:
    """Rows (id, y): 1 if the value is the target, else 0; null if a domain is given and the value isn't in it (or is null)."""
    v = F.col(column)
    y = F.coalesce(v == F.lit(target), F.lit(False)).cast("int")
    if domain is not None:
        y = F.when(F.coalesce(v.isin(list(domain)), F.lit(False)), y)
    return nodes.select("id", y.alias("y"))


def target_set(labels: DataFrame, limit: int = 10_000_000) -> DataFrame:
    """Ids labelled 1; refuses more than `limit`."""
    found = labels.where("y = 1").select("id")
    if found.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} targets")
    return found


def visible_edges(edges: DataFrame, crawled: DataFrame) -> DataFrame:
    """Edges with a crawled end, both ways: (src, dst, src_crawled, dst_crawled)."""
    mark = crawled.select("id", F.lit(True).alias("c"))
    e = edges.join(mark.select(F.col("id").alias("src"), F.col("c").alias("a")), "src", "left").join(mark.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst", "left")
    e = e.where("a or b").select("src", "dst", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    flip = F.explode(F.array(F.struct("src", "dst", "a", "b"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("b").alias("a"), F.col("a").alias("b"))))
    return e.select(flip.alias("e")).select("e.src", "e.dst", F.col("e.a").alias("src_crawled"), F.col("e.b").alias("dst_crawled"))


def observed(edges: DataFrame, crawled: DataFrame) -> DataFrame:
    """Ids that aren't crawled but have a crawled neighbour."""
    return visible_edges(edges, crawled).where("not src_crawled").select(F.col("src").alias("id")).distinct()


def node_features(edges: DataFrame, crawled: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id, degree, od, cc, cnf, tnf, tri2, tri1, tri0) for each node with a visible edge.

    od: 1/sqrt(degree). cc: clustering. cnf: share of crawled neighbours. tnf: share of targets among those. tri2, tri1, tri0: shares of the
    edges among its neighbours with 2, 1 and 0 target ends (over one at least). Triangles are listed once each, from the end of
    lowest degree.
    """
    seen = visible_edges(edges, crawled)
    y = labels.select("id", F.coalesce("y", F.lit(0)).alias("y"))
    near = seen.join(y.select(F.col("id").alias("dst"), "y"), "dst", "left").groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("degree"), F.sum(F.col("dst_crawled").cast("int")).alias("cd"), F.sum(F.when(F.col("dst_crawled"), F.coalesce("y", F.lit(0))).otherwise(0)).alias("ct")
    )
    t = g.triangles(seen.where("src < dst").select("src", "dst"))
    for corner in ("a", "b", "c"):
        t = t.join(y.select(F.col("id").alias(corner), F.col("y").alias(f"y{corner}")), corner, "left").fillna(0, [f"y{corner}"])
    corners = F.array(*(F.struct(F.col(x).alias("id"), (F.col(f"y{p}") + F.col(f"y{q}")).alias("n")) for x, p, q in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))))
    each = t.select(F.explode(corners).alias("k")).groupBy("k.id").agg(
        F.count("*").alias("t"), F.sum((F.col("k.n") == 2).cast("int")).alias("k2"), F.sum((F.col("k.n") == 1).cast("int")).alias("k1"), F.sum((F.col("k.n") == 0).cast("int")).alias("k0")
    )
    f = near.join(each, "id", "left").fillna(0, ["t", "k2", "k1", "k0"])
    d = F.col("degree").cast("double")
    share = lambda c: F.col(c).cast("double") / F.greatest(F.col("t"), F.lit(1))
    return f.select(
        "id", "degree", (1 / F.sqrt(d)).alias("od"), F.when(d < 2, 0.0).otherwise(2.0 * F.col("t") / (d * (d - 1))).alias("cc"), (F.col("cd") / d).alias("cnf"),
        F.when(F.col("cd") == 0, 0.0).otherwise(F.col("ct").cast("double") / F.col("cd")).alias("tnf"), share("k2").alias("tri2"), share("k1").alias("tri1"), share("k0").alias("tri0"),
    )


def crawl_index(n_crawled: Column) -> Column:
    """1 / log2(crawled + 1)."""
    return 1 / F.log2(n_crawled + 1)


def attribute_fractions(edges: DataFrame, crawled: DataFrame, nodes: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Rows (id, fractions): for each value of the domain, and for none of them, its share among crawled neighbours (zeros without any)."""
    hot = nodes.select(F.col("id").alias("dst"), fn.one_hot(F.col(column), domain, add_none=True).alias("hot"))
    seen = visible_edges(edges, crawled)
    own = seen.where("dst_crawled").join(hot, "dst")
    mean = own.groupBy(F.col("src").alias("id")).agg(*(F.avg(F.element_at("hot", i + 1)).alias(f"f{i}") for i in range(len(domain) + 1)))
    every = seen.select(F.col("src").alias("id")).distinct().join(mean, "id", "left").fillna(0.0)
    return every.select("id", F.array(*(F.col(f"f{i}") for i in range(len(domain) + 1))).alias("fractions"))


def _encoded(values: DataFrame, names: Sequence[str], bins: int) -> DataFrame:
    """Rows (id, <name>...) of values (id, <name>...): means, or arrays of the shares in equal bins of [0, 1]."""
    if bins == 0:
        return values.groupBy("id").agg(*(F.avg(n).alias(n) for n in names))
    slots = lambda n: F.array(*(F.avg((fn.histogram_slot(F.col(n), bins) == i).cast("double")) for i in range(bins)))
    return values.groupBy("id").agg(*(slots(n).alias(n) for n in names))


def neighbour_features(edges: DataFrame, crawled: DataFrame, features: DataFrame, names: Sequence[str] = ("od", "cc", "cnf", "tnf"), bins: int = 0, hop: int = 1) -> DataFrame:
    """Rows (id, <name><hop>...): the features of first neighbours, or of second ones, encoded as means (bins 0) or histograms.

    Second neighbours are neighbours of neighbours that aren't first neighbours; the node itself is among them.
    """
    adj = visible_edges(edges, crawled).select("src", "dst")
    pairs = adj
    if hop == 2:
        two = adj.join(adj.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
        pairs = two.join(adj, ["src", "dst"], "left_anti")
    values = pairs.join(features.select(F.col("id").alias("dst"), *names), "dst").select(F.col("src").alias("id"), *names)
    return _encoded(values, names, bins).select("id", *(F.col(n).alias(f"{n}{hop}") for n in names))


def feature_vector(
    edges: DataFrame, crawled: DataFrame, labels: DataFrame, bins: int = 0, n_crawled: int | None = None, nodes: DataFrame | None = None, attributes: dict[str, Sequence] | None = None
) -> tuple[list[str], DataFrame]:
    """Names, and rows (id, features): own features, then those of first and of second neighbours. Nodes without a visible edge aren't there: all theirs are 0.

    n_crawled: puts the crawl index first. attributes: column of nodes(id, ...) to its domain; each adds a slot for every value and one for none of them, to the
    node's own features (as it is known once crawled; zeros before) and to those of first neighbours (shares among the crawled ones).
    """
    own = node_features(edges, crawled, labels)
    names = ["od", "cc", "cnf", "tnf"]
    one, two = (neighbour_features(edges, crawled, own, names, bins, h) for h in (1, 2))
    whole = own.join(one, "id", "left").join(two, "id", "left")
    layout, parts = list(FEATURES), [F.array(*(F.col(n) for n in FEATURES))]
    if n_crawled is not None:
        layout, parts = ["ix", *layout], [F.array(crawl_index(F.lit(n_crawled))), *parts]
    blocks: dict[int, list[tuple[list[str], Column]]] = {0: [], 1: []}
    for column, domain in (attributes or {}).items():
        slots = [f"{column}={v}" for v in domain] + [f"{column}_is_undef"]
        none = F.array(*(F.lit(0.0) for _ in slots))
        hot = nodes.join(crawled.select("id"), "id", "left_semi").select("id", F.transform(fn.one_hot(F.col(column), domain, add_none=True), lambda x: x.cast("double")).alias(f"__{column}0"))
        near = attribute_fractions(edges, crawled, nodes, column, domain).withColumnRenamed("fractions", f"__{column}1")
        whole = whole.join(hot, "id", "left").join(near, "id", "left")
        for h in (0, 1):
            blocks[h].append(([f"{x}{h or ''}" for x in slots], F.coalesce(F.col(f"__{column}{h}"), none)))
    for h in (0, 1, 2):
        for n in names if h else ():
            c = F.col(f"{n}{h}")
            layout += [f"{n}{h}"] if bins == 0 else [f"{n}{h}_{i}" for i in range(bins)]
            parts.append(F.array(F.coalesce(c, F.lit(0.0))) if bins == 0 else F.coalesce(c, F.array(*(F.lit(0.0) for _ in range(bins)))))
        for slots, c in blocks.get(h, ()):
            layout += slots
            parts.append(c)
    return layout, whole.select("id", F.concat(*parts).alias("features"))


def target_neighbours_score(edges: DataFrame, crawled: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id, score) of observed nodes: 1 - 1 / (x + 1) for x target neighbours among the crawled."""
    y = labels.select(F.col("id").alias("dst"), F.coalesce("y", F.lit(0)).alias("y"))
    x = visible_edges(edges, crawled).where("not src_crawled and dst_crawled").join(y, "dst", "left").groupBy(F.col("src").alias("id")).agg(F.sum(F.coalesce("y", F.lit(0))).alias("x"))
    return x.select("id", (1 - 1 / (F.col("x") + 1)).alias("score"))
