"""Near-duplicate vectors: exact pairs beyond a cosine threshold by dual traversal of cover trees.

The top of each label's tree is shared: sampled centres, with every vector in the ball of the nearest one. Pairs of balls that are too far apart for
any link go before vectors are shuffled; what is left is dealt in pairs of blocks, in which subtrees are traversed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textkit as tk
from gleaner.llm.common import components, discard, join_counted, materialize, materialize_counted, parts, reached

COSINE = 0.93
#: Vectors of a block; a pair of blocks is a unit of work.
BLOCK = 4096
#: At most so many centres (about twice as many at worst, as they are drawn by a hash) come to the driver and are broadcast.
MOST_CENTRES = 8192
#: Members of a node that isn't split further, and how many members are looked at to see whether halving the radius divides them.
LEAF, PROBE = 64, 48
#: Rows of a product that are held at once.
STRIP = 512
#: Slack for rounding: what is so near a bound is looked at again, one level down, and at last by the vectors themselves.
SLACK = 1e-9
_SPAN = 1 << 30


@dataclass
class Node:
    """A ball around one of its own points that covers its members. Children have at most half its scale, and one has the same centre."""

    centre: int
    members: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cover_tree(unit: np.ndarray, least: float = 1e-4) -> Node:
    """Nested levels with halving radii over unit vectors.

    A node stays a leaf if it has few members, if they are nearer to each other than `least`, or if most of a few of them are further apart than half its
    radius, so that a level would only list them one by one.
    """
    everyone = np.arange(len(unit))
    first = _distance(unit, unit[:1])[:, 0]
    root = Node(0, everyone, float(first.max()) + SLACK)
    open_ = [(root, root.radius)]
    while open_:
        node, scale = open_.pop()
        half = scale / 2
        if len(node.members) <= LEAF or scale < least:
            continue
        some = unit[node.members[:: max(1, len(node.members) // PROBE)][:PROBE]]
        if (_distance(some, some) > half).mean() > 0.9:
            continue
        left, centre = node.members, node.centre
        while len(left):
            d = _distance(unit[left], unit[centre : centre + 1])[:, 0]
            near = d <= half
            near |= left == centre
            own = left[near]
            node.children.append(Node(int(centre), own, (float(d[near].max()) + SLACK) if len(own) > 1 else 0.0))
            left = left[~near]
            centre = left[0] if len(left) else -1
        for child in node.children:
            if len(child.members) > 1:
                open_.append((child, half))
    return root


Pairs = list[tuple[np.ndarray, np.ndarray]]


def dual_traversal(x: np.ndarray, tree_x: Node, y: np.ndarray, tree_y: Node, cosine: float = COSINE) -> tuple[Pairs, Pairs]:
    """Links between two sets of vectors: single pairs (rows of x, rows of y), and pairs of member lists all of which link.

    A pair of nodes goes if its centres are further apart than the threshold and both covering radii, links as a whole if they are nearer
    than the threshold less both radii, and is opened otherwise. Pairs of leaves are compared member by member.
    """
    size_x, size_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    ux, uy = x / size_x[:, None], y / size_y[:, None]
    far = float(np.sqrt(2.0 - 2.0 * cosine))
    single, whole = [], []
    open_ = [(tree_x, tree_y)]
    while open_:
        a, b = open_.pop()
        if not a.children and not b.children:
            other = uy[b.members].T
            for at in range(0, len(a.members), STRIP):
                rows = a.members[at : at + STRIP]
                i, j = np.nonzero(ux[rows] @ other >= cosine - SLACK)
                i, j = rows[i], b.members[j]
                ok = np.einsum("ij,ij->i", x[i], y[j]) / (size_x[i] * size_y[j]) >= cosine
                if ok.any():
                    single.append((i[ok], j[ok]))
            continue
        ca, cb = a.children or [a], b.children or [b]
        d = _distance(ux[[n.centre for n in ca]], uy[[n.centre for n in cb]])
        reach = np.add.outer(np.array([n.radius for n in ca]), np.array([n.radius for n in cb]))
        keep = d <= far + reach + SLACK
        sure = keep & (d + reach <= far - SLACK)
        for i, j in zip(*np.nonzero(sure)):
            whole.append((ca[i].members, cb[j].members))
        for i, j in zip(*np.nonzero(keep & ~sure)):
            open_.append((ca[i], cb[j]))
    return single, whole


def _forest(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least node that each of n nodes reaches."""
    label = np.arange(n)
    a, b = pairs
    while True:
        now = label.copy()
        np.minimum.at(now, a, label[b])
        np.minimum.at(now, b, label[a])
        now = now[now]
        if (now == label).all():
            return label
        label = now


def compare(x: np.ndarray, weight_x: np.ndarray, y: np.ndarray, weight_y: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of x and of y (counting weights of the other side), and the least row that each one reaches (y's rows after x's)."""
    n = len(x)
    tree = cover_tree(x / np.linalg.norm(x, axis=1, keepdims=True))
    single, whole = dual_traversal(x, tree, y, tree if same else cover_tree(y / np.linalg.norm(y, axis=1, keepdims=True)), cosine)
    links_x, links_y = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shift = 0 if same else n
    for i, j in single:
        links_x += np.bincount(i, weight_y[j], n).astype(np.int64)
        links_y += np.bincount(j, weight_x[i], len(y)).astype(np.int64)
        a.append(i)
        b.append(j + shift)
    for i, j in whole:
        links_x[i] += weight_y[j].sum()
        links_y[j] += weight_x[i].sum()
        a += [i, np.full(len(j), i[0])]
        b += [np.full(len(i), j[0] + shift), j + shift]
    if same:
        links_x -= weight_x  # each vector is its own neighbour
    return links_x, links_y, _forest(shift + len(y), (np.concatenate(a), np.concatenate(b)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each scaled by a power of two so that its largest component lies between a half and one: its squares then neither under- nor overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each unit, which follow each other."""
    now, held = None, []
    for b in batches:
        unit = b.column("unit").to_numpy()
        cut = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else []
        for at, to in zip(cut, [*cut[1:], len(unit)]):
            if held and unit[at] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = unit[at]
            held.append(b.slice(at, to - at))
    if held:
        yield now, pa.Table.from_batches(held)


def _balls(kinds: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """kinds with a cell and its dist to the cell's centre, and pairs (label, dim, one, other), one <= other, of the cells that may link.

    A label of more than `per` vectors gets a centre for about as many. The cells of small labels, of which each has one, are left out of the pairs.
    """
    spark = kinds.sparkSession
    per = max(BLOCK, total // MOST_CENTRES)
    sizes = kinds.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > per)
    drawn = kinds.join(F.broadcast(sizes), ["label", "dim"]).where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(_SPAN)) < F.ceil(F.col("n") / per) / F.col("n") * _SPAN)
    centres: dict[tuple, list] = {}
    for r in drawn.select("label", "dim", "vector").collect():  # see MOST_CENTRES
        centres.setdefault((r["label"], r["dim"]), []).append(r["vector"])

    def unit(rows) -> np.ndarray:
        x = _matrix(pa.array(rows, pa.list_(pa.float64())))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    sent = spark.sparkContext.broadcast({k: unit(v) for k, v in centres.items()})
    names = kinds.columns

    def assign(batches):
        for b in batches:
            cell, dist = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, 2.0)
            groups: dict[tuple, list] = {}
            for i, k in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist())):
                if k in sent.value:
                    groups.setdefault(k, []).append(i)
            for k, rows in groups.items():
                x = _matrix(b.column("vector").take(pa.array(rows)))
                d = _distance(x / np.linalg.norm(x, axis=1, keepdims=True), sent.value[k])
                cell[rows], dist[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(cell), pa.array(dist)], [*names, "cell", "dist"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema)
    assigned, _ = materialize(kinds.mapInArrow(tk.lean(assign), f"{schema}, cell int, dist double"), "assigned")
    wide = assigned.join(F.broadcast(sizes.select("label", "dim")), ["label", "dim"]).groupBy("label", "dim", "cell").agg(F.max("dist").alias("radius"))
    radii: dict[tuple, dict] = {}
    for r in wide.collect():  # a row a centre
        radii.setdefault((r["label"], r["dim"]), {})[r["cell"]] = r["radius"]
    known = spark.sparkContext.broadcast(radii)

    def partners(batches):
        far = float(np.sqrt(2.0 - 2.0 * COSINE))
        for b in batches:
            for label, dim, cell, radius in zip(*(b.column(c).to_pylist() for c in ("label", "dim", "cell", "radius"))):
                own = known.value[label, dim]
                others = np.array(sorted(c for c in own if c >= cell))
                c = sent.value.get((label, dim))
                if c is not None:
                    d = _distance(c[cell : cell + 1], c[others])[0]
                    others = others[d <= far + radius + np.array([own[o] for o in others.tolist()]) + SLACK]
                n = len(others)
                yield pa.RecordBatch.from_arrays([pa.array([label] * n, b.column("label").type), pa.array([dim] * n, pa.int32()), pa.array([cell] * n, pa.int32()), pa.array(others.astype(np.int32))], ["label", "dim", "one", "other"])

    kind = kinds.schema["label"].dataType.simpleString()
    return assigned, wide.mapInArrow(tk.lean(partners), f"label {kind}, dim int, one int, other int")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of vectors.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least COSINE. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing; vectors of unlike length don't link either. Finite vectors of any size are
    compared, as each is scaled by a power of two first. component_id is the smallest key that links reach; a null key gets the smallest of the rest, and
    null if it links with none. Equal vectors of a label are compared once. Work is dealt in pairs of blocks of at most about BLOCK
    different vectors, so no task grows with a label; each gives a count for each vector and links enough to connect them, not all pairs.
    """
    spark = vectors.sparkSession
    fine = F.size("vector") > 0
    fine &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0.0)
    rows = vectors.select(vectors[key].cast("long").alias("key"), vectors[label].alias("label"), F.transform(vectors[vector], lambda v: v.cast("double")).alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    rows = rows.withColumn("vector", F.when(F.col("ok"), F.col("vector"))).withColumn("node", F.monotonically_increasing_id())
    base, _, total = materialize_counted(rows.select("node", "key", "label", "vector", "ok"), "vectors")
    same = base.where("ok").select("node", F.struct("label", "vector").alias("kind"))
    kinds, kinds_path, n_kinds = materialize_counted(same.groupBy("kind").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "kinds")
    flat = kinds.select("kind.label", F.size("kind.vector").alias("dim"), "rep", F.col("n").alias("weight"), "kind.vector")

    assigned, pairs = _balls(flat, n_kinds)
    place = ["label", "dim", "cell"]
    sizes = assigned.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    alone = sizes.select("label", "dim", F.col("cell").alias("one"), F.col("cell").alias("other"))
    both = alone.unionByName(pairs).distinct()
    one, other = (sizes.select("label", "dim", F.col("cell").alias(c), F.col("blocks").alias(f"{c}_blocks")) for c in ("one", "other"))
    units = both.join(one, ["label", "dim", "one"]).join(other, ["label", "dim", "other"])
    units = units.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("one_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    units = units.where("one < other or i <= j").select("label", "dim", "one", "i", "other", "j").withColumn("unit", F.monotonically_increasing_id())
    units, units_path, n_units = materialize_counted(units, "units")
    twin = (F.col("one") == F.col("other")) & (F.col("i") == F.col("j"))
    side = lambda c, b, n: units.select("label", "dim", F.col(c).alias("cell"), F.col(b).alias("block"), "unit", F.lit(n).alias("side"), twin.alias("twin"))
    sides = side("one", "i", 0).union(side("other", "j", 1).where("not twin"))
    blocked = assigned.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = blocked.join(sides, [*place, "block"]).select("unit", "side", "twin", "rep", "weight", "vector")

    def run(batches):
        for _, t in _by_unit(batches):
            t = t.combine_chunks()
            own, x = t.column("side").to_numpy(), _matrix(t.column("vector").combine_chunks())
            weight, rep = t.column("weight").to_numpy(), t.column("rep").to_numpy()
            same = t.column("twin")[0].as_py()
            a, b = np.flatnonzero(own == 0), np.flatnonzero(own == (0 if same else 1))
            if not len(a) or not len(b):
                continue
            links_x, links_y, root = compare(x[a], weight[a], x[b], weight[b], same, COSINE)
            nodes = rep[a] if same else np.concatenate([rep[a], rep[b]])
            count = links_x if same else np.concatenate([links_x, links_y])
            some = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(count[some])], ["a", "b", "n"])

    n_parts = min(max(parts(vectors), n_units), 20_000)
    found, found_path = materialize(dealt.repartition(n_parts, "unit").sortWithinPartitions("unit").mapInArrow(tk.lean(run), "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    counted = kinds.join(counts, "rep", "left").select("kind", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    live, _ = materialize(join_counted(same, counted, "kind", total, "node").select("node", "rep", "n_links"), "copies")
    whole = base.select("node", "key").join(live, "node", "left").select("node", "key", F.coalesce("rep", "node").alias("rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = reached(whole, total, components(found.where("a <> b").select("a", "b")))
    discard(spark, kinds_path, found_path, units_path)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
