"""Relational operators on tables: DataFrames in, DataFrames out.

A table has no physical order; operators that depend on one take `order`, columns that order rows totally.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from gleaner.functions import columns as fn
from gleaner.session import discard, materialize, materialize_counted


def select(df: DataFrame, predicate: tuple) -> DataFrame:
    """Rows for which a predicate tree holds."""
    return df.where(fn.tree(predicate))


def select_columns(df: DataFrame, left: str, op: str, right: str) -> DataFrame:
    return df.where(fn.compare(F.col(left), op, F.col(right)))


def select_constant(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.where(fn.compare(F.col(column), op, F.lit(value)))


def classify(df: DataFrame, predicate: tuple, label: str, positive: int = 1, negative: int = 0) -> DataFrame:
    """An integer label by a predicate tree."""
    return df.withColumn(label, F.when(fn.tree(predicate), F.lit(positive)).otherwise(F.lit(negative)))


def project(df: DataFrame, columns: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    return df.select(*(F.col(c).alias((rename or {}).get(c, c)) for c in columns))


#: Rows of a hash range that one task takes.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Hash ranges of about TASK_ROWS rows, as many as the session's shuffle partitions at least: what a task holds doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df in hash ranges of columns that follow its rows (see tasks)."""
    return df.repartition(tasks(df.sparkSession, df.count()), *columns)


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "_id") -> DataFrame:
    """Row numbers from 0 in a total order, without sorting in one task: rows are range-partitioned, and each range starts after those before it.

    The ranges are written to the shared folder, so that their sizes and their rows come from one and the same partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt, _ = materialize(ranges.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def zip_arithmetic(left: DataFrame, right: DataFrame, on: str, op: str, a: str, b: str, result: str, integer: bool = False) -> DataFrame:
    """Arithmetic between columns of two tables whose rows match by position; `on` is the position."""
    other = right.select(F.col(on), F.col(b).alias("__b"))
    return left.join(other, on).withColumn(result, fn.arithmetic(op, F.col(a), F.col("__b"), integer)).drop("__b")


def aggregate(df: DataFrame, keys: Sequence[str], policies: dict[str, tuple[str, str]], order: str) -> DataFrame:
    """One row a group; policies: result name to (policy, value column)."""
    return df.groupBy(*keys).agg(*(fn.POLICIES[p](F.col(v), F.col(order)).alias(name) for name, (p, v) in policies.items()))


def aggregate_back(df: DataFrame, keys: Sequence[str], policy: str, value: str, result: str, order: str) -> DataFrame:
    """The group's aggregate on every row. A reduced table is joined back, which combines before the shuffle; no group is windowed as a whole."""
    reduced = aggregate(df, keys, {result: (policy, value)}, order)
    names = [f"__k{i}" for i in range(len(keys))]
    reduced = reduced.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), result)
    same = reduce(lambda x, y: x & y, (df[k].eqNullSafe(reduced[n]) for k, n in zip(keys, names)))
    return df.join(reduced, same).drop(*names)


def aggregate_columns(df: DataFrame, columns: Sequence[str], policy: str, result: str) -> DataFrame:
    return df.withColumn(result, fn.across(columns, policy))


def count_by(df: DataFrame, column: str, result: str) -> DataFrame:
    return aggregate_back(df, [column], "count", column, result, column)


def group_ids(df: DataFrame, keys: Sequence[str], order: str, result: str = "group", ordered: bool = True) -> DataFrame:
    """Dense group numbers from 0 in the order groups are first seen; ordered=False: keys count as a multiset."""
    value: list[Column] = [F.col(k) for k in keys] if ordered else [F.array_sort(F.array(*keys))]
    tagged = df.withColumn("__key", F.struct(*(v.alias(f"k{i}") for i, v in enumerate(value))))
    groups = row_numbers(tagged.groupBy("__key").agg(F.min(order).alias("__first")), ["__first"], result)
    return tagged.join(groups.select("__key", result), "__key").drop("__key")


def unique(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key."""
    own = F.struct(F.col(order).alias("__o"), *(F.col(c) for c in df.columns if c != order))
    best = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(own, F.col(order)).alias("__row"))
    return best.select(*((F.col("__row.__o") if c == order else F.col(f"__row.{c}")).alias(c) for c in df.columns))


def splice(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """One table a group, as partitions of a Parquet folder."""
    df.write.partitionBy(*keys).mode("overwrite").parquet(path)


def order_rank(df: DataFrame, order: Sequence[str], result: str, reset: bool = False) -> DataFrame:
    """Position from 0 in the total order; reset: it starts again when the first column changes."""
    if not reset:
        return row_numbers(df, order, result)
    return df.withColumn(result, F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])) - 1)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top(df: DataFrame, weight: str, key: str, k: int) -> DataFrame:
    """The k rows of largest weight; ties go to the largest key."""
    return df.orderBy(F.desc(weight), F.desc(key)).limit(k)


def weighted_sample(df: DataFrame, weight: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement in proportion to weight, by exponential keys hashed from key and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(k)


def random_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def cumulative(df: DataFrame, value: str) -> DataFrame:
    """Rows (value, at_most, at_least): how many rows have a value up to, and from, each one; the windows run over distinct values only."""
    n = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    up, down = Window.orderBy("value"), Window.orderBy(F.desc("value"))
    return n.select("value", F.sum("n").over(up).alias("at_most"), F.sum("n").over(down).alias("at_least"))


def next_k(df: DataFrame, k: int, group: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Pairs (key, next_key, step) of each row with its next k rows in its group: leads of one sort, no self-join."""
    w = Window.partitionBy(*group).orderBy(*order)
    ahead = df.select(*group, key, *(F.lead(key, i).over(w).alias(f"__next{i}") for i in range(1, k + 1)))
    leads = F.explode(F.array(*(F.struct(F.col(f"__next{i}").alias("next_key"), F.lit(i).alias("step")) for i in range(1, k + 1))))
    pairs = ahead.select(*group, key, leads.alias("p")).select(*group, key, "p.next_key", "p.step")
    return pairs.where("next_key is not null")


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def union(left: DataFrame, right: DataFrame, dedup_right: bool = False) -> DataFrame:
    """Left without duplicates, then right rows that left doesn't have; duplicates among those stay unless dedup_right."""
    new = right.join(left, _same(right, left, right.columns), "left_anti")
    return left.distinct().unionByName(new.distinct() if dedup_right else new)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right rows that left has, as often as right has them."""
    return right.join(left, _same(right, left, right.columns), "left_semi")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows that right doesn't have, as often as left has them."""
    return left.join(right, _same(left, right, left.columns), "left_anti")


def _suffixed(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names in both tables get -1 on the left and -2 on the right."""
    both = set(left.columns) & set(right.columns)
    return left.select(*(F.col(c).alias(f"{c}-1" if c in both else c) for c in left.columns)), right.select(*(F.col(c).alias(f"{c}-2" if c in both else c) for c in right.columns))


def join(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Inner equi-join with all columns of both sides; Spark picks the build side by size."""
    a, b = _suffixed(left, right)
    key_a = f"{left_key}-1" if left_key in right.columns else left_key
    key_b = f"{right_key}-2" if right_key in left.columns else right_key
    return a.join(b, a[f"`{key_a}`"] == b[f"`{key_b}`"])


def self_join(df: DataFrame, key: str) -> DataFrame:
    """Pairs of rows with equal keys, a row with itself included."""
    return join(df, key, df, key)


#: Columns that make the grid of a similarity join; a row meets three cells for each.
GRID = 3
#: A key with fewer rows is never treated as hot; the rows of a hot one are dealt to SALTS tasks.
HOT, SALTS = 1000, 64


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int, spread: str, n: str = "n") -> DataFrame:
    """rows joined with the other columns of counted, which has one row a key and n, how many rows have it, out of total.

    A key with more than a ten-thousandth of the rows (HOT at least) is hot. There are at most 10,000 of those, whatever the input, so the list of them is
    broadcast. Their rows are dealt by a hash of the column `spread`, and their row of counted goes to each of those tasks.
    """
    least, values = max(HOT, total // 10_000), [c for c in counted.columns if c not in (key, n)]
    if total <= least:
        return rows.join(counted.select(key, *values), key)
    hot = counted.where(F.col(n) > least).select(key, F.lit(SALTS).alias("__salts"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col(n) > least, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("__salt")
    return salted.join(counted.select(key, *values, copies), [key, "__salt"]).drop("__salt")


#: Rows of each side that meet in a task of a threshold join, and at least so many blocks of a side; joint rows that a task holds at once, as a power of 2.
BLOCK_ROWS, LEAST_BLOCKS, JOINT_BITS = 1 << 20, 4, 22


def _sides(left: DataFrame, key1: str, on1: str, right: DataFrame, key2: str, on2: str, more1: dict[str, Column], more2: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a threshold join by (key, value), with the rows of each as n."""
    kind = left.select(F.col(on1).alias("v")).unionByName(right.select(F.col(on2).alias("v"))).schema["v"].dataType
    return tuple(
        df.groupBy(F.col(key).alias("key"), F.col(on).cast(kind).alias("value")).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in more.items())).where("value is not null")
        for df, key, on, more in ((left, key1, on1, more1), (right, key2, on2, more2))
    )


def _same_value(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """Pairs of rows (l, r) of a and b of one value with l.n * r.n >= threshold.

    A row needs at least threshold / n rows on the other side. Rows of b are there once for each number that they have enough for, so only pairs of the result meet.
    """
    least = max(threshold, 1)
    x = a.select("value", F.ceil(F.lit(least) / F.col("n")).alias("need"), F.struct(*a.columns).alias("l"))
    y = b.select("value", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(least).cast("long")))).alias("need"), F.struct(*b.columns).alias("r"))
    return x.join(y, ["value", "need"]).select("l", "r")


def _joint_pairs(l: pa.StructArray, r: pa.StructArray, threshold: int, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell, a block of each side: n, and both keys or, if best, both rows of the least (i, j). Keys of the left side come in runs of 2**JOINT_BITS joint rows at most; their pairs are sorted."""
    codes = lambda x, y: np.split(pa.concat_arrays([x, y]).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64), [len(x)])
    order = lambda x, y: np.split(pc.rank(pa.concat_arrays([x, y]), tiebreaker="dense").to_numpy().astype(np.int64), [len(x)])
    v1, v2 = codes(l.field("value"), r.field("value"))
    k1, k2 = codes(l.field("key"), l.field("key")[:0])[0], codes(r.field("key"), r.field("key")[:0])[0]
    by_key, by_value = np.argsort(k1, kind="stable"), np.argsort(v2, kind="stable")
    k1, v1, k2, sorted2 = k1[by_key], v1[by_key], k2[by_value], v2[by_value]
    n1, n2 = l.field("n").to_numpy()[by_key], r.field("n").to_numpy()[by_value]
    low = np.searchsorted(sorted2, v1)
    met = np.searchsorted(sorted2, v1, "right") - low
    i, j = (order(l.field("i"), l.field("i")[:0])[0][by_key], order(r.field("i"), r.field("i")[:0])[0][by_value]) if best else (None, None)
    wide, ends = int(k2.max()) + 1, np.cumsum(met)
    starts = np.append(np.flatnonzero(np.diff(k1, prepend=-1)), len(k1))  # where each key begins
    before = np.append(0, ends)[starts]
    at = 0
    while at < len(starts) - 1:
        to = min(max(int(np.searchsorted(before, before[at] + (1 << JOINT_BITS), "right")) - 1, at + 1), at + 4096)
        lo, hi = starts[at], starts[to]
        at, total = to, int(ends[hi - 1] - (ends[lo] - met[lo]))
        if not total:
            continue
        left = np.repeat(np.arange(lo, hi), met[lo:hi])
        right = np.arange(total) + np.repeat(low[lo:hi] - (ends[lo:hi] - met[lo:hi] - (ends[lo] - met[lo])), met[lo:hi])
        bits = total.bit_length()
        packed = ((k1[left] - k1[lo]) * wide + k2[right] << bits) | np.arange(total)
        packed.sort()
        first = np.flatnonzero(np.diff(packed >> bits, prepend=-1))
        place = packed & ((1 << bits) - 1)
        if n1[lo:hi].max() > 1 or n2.max() > 1:
            n = np.add.reduceat((n1[left] * n2[right])[place], first)
        else:
            n = np.diff(first, append=total)
        hit = np.flatnonzero(n >= threshold)
        if not len(hit):
            continue
        chosen = place[first[hit]]
        if best:
            size = np.diff(first, append=total)[hit]
            of = np.repeat(np.arange(len(hit)), size)
            rows = place[np.arange(len(of)) + np.repeat(first[hit] - (np.cumsum(size) - size), size)]
            least = np.lexsort((j[right[rows]], i[left[rows]], of))
            chosen = rows[least[np.cumsum(size) - size]]
        x, y = pa.array(by_key[left[chosen]]), pa.array(by_value[right[chosen]])
        if best:
            yield pa.RecordBatch.from_arrays([l.field("row").take(x), r.field("row").take(y), pa.array(n[hit])], ["x", "y", "n"])
        else:
            yield pa.RecordBatch.from_arrays([l.field("key").take(x), r.field("key").take(y), pa.array(n[hit])], ["key1", "key2", "n"])


def _packed(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """df in blocks of keys, each as bytes in one row of the column `name` and alone in its partition; they are written once."""

    def pack(t: pa.Table) -> pa.Table:
        sink, own = pa.BufferOutputStream(), t.drop_columns(["block"])
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own)
        return pa.table({"block": t["block"][:1], name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    block = F.pmod(F.xxhash64("key"), F.lit(blocks).cast("long")).alias("block")
    packed, _ = materialize(df.select(block, "*").repartition(blocks, "block").groupBy("block").applyInArrow(pack, f"block long, {name} binary"), name)
    return packed.repartitionByRange(blocks, "block").select(name)


def _joint(a: DataFrame, b: DataFrame, threshold: int, schema: StructType, best: bool) -> DataFrame:
    """Pairs of keys of a and b, counted in cells of a block of keys of each side, so that joint rows and pairs below the threshold are never shuffled or written.

    The values of one key must fit in a task; blocks are of about BLOCK_ROWS rows. A block is written once, and the task of each of its cells reads it from there, so
    what is on the disk grows with the rows and not with the cells.
    """
    spark = a.sparkSession
    (a, path1, rows1), (b, path2, rows2) = materialize_counted(a, "left"), materialize_counted(b, "right")
    l, r = (_packed(df, max(LEAST_BLOCKS, -(-rows // BLOCK_ROWS)), name) for df, rows, name in ((a, rows1, "l"), (b, rows2, "r")))
    discard(spark, path1, path2)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for row in range(t.num_rows):
                left, right = (pa.ipc.open_stream(t[c][row].as_buffer()).read_all().combine_chunks().to_struct_array().combine_chunks() for c in ("l", "r"))
                yield from _joint_pairs(left, right, threshold, best)

    return l.hint("shuffle_replicate_nl").crossJoin(r).mapInArrow(pairs, schema)


def threshold_join(left: DataFrame, key1: str, on1: str, right: DataFrame, key2: str, on2: str, threshold: int, per_value: bool = False) -> DataFrame:
    """Rows (key1, key2[, value], n): key pairs whose rows meet in at least `threshold` joint rows (of one join value if per_value).

    Both sides are counted by (key, value) first, so a joint row is a product of counts and repeated rows aren't multiplied out.
    """
    a, b = _sides(left, key1, on1, right, key2, on2, {}, {})
    if per_value:
        return _same_value(a, b, threshold).select(F.col("l.key").alias("key1"), F.col("r.key").alias("key2"), F.col("l.value").alias("value"), (F.col("l.n") * F.col("r.n")).alias("n"))
    schema = StructType([StructField("key1", a.schema["key"].dataType), StructField("key2", b.schema["key"].dataType), StructField("n", LongType())])
    return _joint(a, b, threshold, schema, False)


def threshold_join_rows(left: DataFrame, key1: str, on1: str, id1: str, right: DataFrame, key2: str, on2: str, id2: str, threshold: int, per_value: bool = False) -> DataFrame:
    """threshold_join's pairs as one joint row each, with all columns of both sides: the one of least id1, and then of least id2. Ids tell a table's rows apart.

    The least row of each (key, value) travels with its count, so the pairs aren't joined with the tables again.
    """
    rows = [{"i": F.min(i), "row": F.min_by(F.struct(*df.columns), F.col(i))} for df, i in ((left, id1), (right, id2))]
    a, b = _sides(left, key1, on1, right, key2, on2, *rows)
    if per_value:
        out = _same_value(a, b, threshold).select(F.col("l.row").alias("x"), F.col("r.row").alias("y"))
    else:
        out = _joint(a, b, threshold, StructType([StructField("x", a.schema["row"].dataType), StructField("y", b.schema["row"].dataType), StructField("n", LongType())]), True)
    x, y = _suffixed(left, right)
    return out.select(*(F.col("x").getField(c).alias(d) for c, d in zip(left.columns, x.columns)), *(F.col("y").getField(c).alias(d) for c, d in zip(right.columns, y.columns)))


def bottom(df: DataFrame, weight: str, key: str, k: int) -> DataFrame:
    """The k rows of least weight; ties go to the least key."""
    return df.orderBy(weight, key).limit(k)


def exponential_bins(df: DataFrame, value: str, factor: float = 2.0, least: float = 1.0) -> DataFrame:
    """Rows (low, high, n, pdf, cdf): values from `least` on in bins that widen by a factor; pdf is a bin's share over its width, cdf the share up to its end."""
    at = F.floor(F.log(F.col(value) / least) / F.log(F.lit(float(factor)))).cast("int")
    low = lambda i: F.lit(float(least)) * F.pow(F.lit(float(factor)), i)
    bins = df.where(F.col(value) >= least).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")  # a row a bin
    total, up_to = F.sum("n").over(Window.partitionBy()), F.sum("n").over(w)
    wide = low(F.col("bin") + 1) - low(F.col("bin"))
    return bins.select(low(F.col("bin")).alias("low"), low(F.col("bin") + 1).alias("high"), "n", (F.col("n") / total / wide).alias("pdf"), (up_to / total).alias("cdf"))


def similarity_join(left: DataFrame, columns1: Sequence[str], right: DataFrame, columns2: Sequence[str], distance: str, threshold: float, metric: str = "l2") -> DataFrame:
    """Pairs of rows within a distance, both sides' columns with suffixes where names clash.

    l2: rows fall into cells as wide as the threshold along each of the first GRID columns, and a row meets its own cell and those next to it, which turns the
    nested loop into an equi-join. haversine: (latitude, longitude) in degrees; cells are bands of latitude.
    """
    a, b = _suffixed(left, right)
    c1 = [f"{c}-1" if c in right.columns else c for c in columns1]
    c2 = [f"{c}-2" if c in left.columns else c for c in columns2]
    width = max(float(threshold), 1e-12) if metric == "l2" else max(float(threshold) / fn.EARTH_RADIUS * 57.29577951308232, 1e-9)
    width *= 1 + 1e-9  # guards against rounding of the division
    cell = lambda c: F.floor(F.col(f"`{c}`") / width)
    axes = range(min(GRID, len(c1)) if metric == "l2" else 1)
    for i in axes:
        a = a.withColumn(f"__cell{i}", F.explode(F.array(*(cell(c1[i]) + j for j in (-1, 0, 1)))))
        b = b.withColumn(f"__cell{i}", cell(c2[i]))
    x, y = [F.col(f"`{c}`") for c in c1], [F.col(f"`{c}`") for c in c2]
    if metric == "l2":
        d = fn.euclidean(x, y)
    elif metric == "haversine":
        d = fn.haversine(x[0], x[1], y[0], y[1])
    else:
        raise ValueError("metric is l2 or haversine")
    cells = [f"__cell{i}" for i in axes]
    return a.join(b, cells).withColumn(distance, d).where(F.col(distance) <= threshold).drop(*cells)


#: Groups of a block at most, and blocks at least; a task holds the counts of a cell of two blocks, and there are tasks for about MEETINGS meetings each.
LIST, LEAST_LISTS, MEETINGS = 2048, 16, 4_000_000
#: Meetings that a task spreads out at once, but for those of one value.
SPREAD = 1 << 21
#: Up to so many rows of two numbers are broadcast; beyond that, they are joined.
NUMBERS = 1_000_000


def numbered_groups(own: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows (g, v) with groups as numbers, groups (key, n, g), how many) of distinct rows (key, v): dense numbers in the order of keys, and n rows a group.

    A null v counts in n, but is in no row of members.
    """
    groups = row_numbers(own.groupBy("key").agg(F.count("*").alias("n")), ["key"], "g")
    rows, _ = materialize(own.where("v is not null").join(groups, "key").select("g", "v"), "members")
    return rows, groups, groups.count()


def _cell_counts(batches: Iterator[pa.RecordBatch], width: int, n: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (g1, g2, c) of cells in order of (b1, b2), both ways round; a row has a value's groups in both blocks, or in the one block of a cell that is its own mirror."""

    def pieces() -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        for t in batches:
            b1, b2 = t["b1"].to_numpy(), t["b2"].to_numpy()
            cuts = np.flatnonzero((np.diff(b1, prepend=-1) != 0) | (np.diff(b2, prepend=-1) != 0))
            for lo, hi in zip(cuts, [*cuts[1:], len(b1)]):
                yield (int(b1[lo]), int(b2[lo])), t.slice(lo, hi - lo)

    for (b1, b2), own in groupby(pieces(), key=lambda p: p[0]):
        counts = np.zeros(width * width, dtype=np.int64)
        for _, t in own:
            l1, l2 = t["l1"], t["l1" if b1 == b2 else "l2"]
            n1, n2 = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (l1, l2))
            x, y = (v.flatten().to_numpy().astype(np.int64) for v in (l1, l2))
            ends, at1, at2 = np.cumsum(n1 * n2), np.append(0, np.cumsum(n1)), np.append(0, np.cumsum(n2))
            lo = 0
            while lo < len(n1):
                hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SPREAD, "right")), lo + 1)
                times, first = np.repeat(n2[lo:hi], n1[lo:hi]), np.repeat(at2[lo:hi], n1[lo:hi])
                right = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
                counts += np.bincount(np.repeat(x[at1[lo] : at1[hi]] * width, times) + y[right], minlength=width * width)
                lo = hi
        for row in range(0, width, max(1, (1 << 20) // width)):
            some = counts[row * width : (row + max(1, (1 << 20) // width)) * width]
            if every:
                hit = np.arange(len(some)).reshape(-1, width)[: max(0, n - b1 * width - row), : n - b2 * width].ravel()
            else:
                hit = np.flatnonzero(some)
            g1, g2, c = (pa.array(v.astype(np.int64)) for v in (b1 * width + row + hit // width, b2 * width + hit % width, some[hit]))
            for one, two in ((g1, g2), (g2, g1))[: 1 + (b1 != b2)]:
                yield pa.RecordBatch.from_arrays([one, two, c], ["g1", "g2", "c"])


def shared_values(rows: DataFrame, n: int, every: bool = False) -> DataFrame:
    """Rows (g1, g2, c) for groups that share a value, each with itself too: how many of rows(g, v), which are distinct, they share. every: pairs that share none, too; n: how many groups.

    Groups fall into blocks by their numbers. A value's groups in two blocks go to the cell of both as two lists of 2 bytes a group, so a list is sent once a block and not once
    a group; a task counts a cell's pairs where they arise, and no pair is shuffled. The number of tasks follows the number of meetings.
    """
    spark, width = rows.sparkSession, min(LIST, max(1, -(-n // LEAST_LISTS)))
    rows = dealt(rows, "v")
    met = rows.groupBy("v").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-met // MEETINGS))
    lists = rows.groupBy("v", F.floor(F.col("g") / width).alias("b")).agg(F.collect_list((F.col("g") % width).cast("short")).alias("l"))
    one, two = (lists.select("v", F.col("b").alias(f"b{i}"), F.col("l").alias(f"l{i}")) for i in (1, 2))
    cells = one.join(two, "v").where("b1 <= b2").select("b1", "b2", "l1", F.when(F.col("b1") < F.col("b2"), F.col("l2")).alias("l2"))
    if every:
        blocks, none = spark.range(-(-n // width)), F.array().cast("array<smallint>")
        grid = blocks.select(F.col("id").alias("b1")).crossJoin(blocks.select(F.col("id").alias("b2"))).where("b1 <= b2")
        cells, tasks = cells.unionByName(grid.select("b1", "b2", none.alias("l1"), none.alias("l2"))), max(tasks, -(-n * n // (16 * MEETINGS)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cell_counts(batches, width, n, every)

    return cells.repartition(tasks, "b1", "b2").sortWithinPartitions("b1", "b2").mapInArrow(counts, "g1 long, g2 long, c long")


def jaccard_pairs(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """shared_values with both groups' numbers of values, n1 and n2."""
    small = (lambda df: F.broadcast(df)) if n <= NUMBERS else (lambda df: df)
    one, two = groups.select(F.col("g").alias("g1"), F.col("n").alias("n1")), groups.select(F.col("g").alias("g2"), F.col("n").alias("n2"))
    return shared_values(rows, n).join(small(one), "g1").join(small(two), "g2")


def group_jaccard(df: DataFrame, group: Sequence[str], value: str, threshold: float, distance: str = "distance") -> DataFrame:
    """Ordered pairs of groups (each with itself too) whose sets of values are within a Jaccard distance.

    Rows (<column>-1, <column>-2, distance). Below threshold 1 only groups that share a value can qualify (see shared_values); from 1 on, all pairs do, and those
    that share nothing have distance 1: every cell gives all of its pairs, and nothing is written. Names are broadcast there, as the result is their square.
    """
    own = dealt(df.select(F.struct(*(F.col(g) for g in group)).alias("key"), F.col(value).alias("v")).where("v is not null"), "key", "v").distinct()
    rows, groups, n = numbered_groups(own)
    apart = (F.lit(1.0) - F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias(distance)
    one, two = (groups.select(F.col("g").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("key").alias(f"k{i}")) for i in (1, 2))
    names = [F.col(f"k{i}.{g}").alias(f"{g}-{i}") for i in (1, 2) for g in group]
    if threshold < 1:
        near = jaccard_pairs(rows, groups, n).select("g1", "g2", apart).where(F.col(distance) <= threshold)
        return near.join(one.drop("n1"), "g1").join(two.drop("n2"), "g2").select(*names, distance)
    return shared_values(rows, n, every=True).join(F.broadcast(one), "g1").join(F.broadcast(two), "g2").select(*names, apart)


def update_from(df: DataFrame, key: str, column: str, other: DataFrame, other_key: str, read: str, order: str, default=0.0) -> DataFrame:
    """`column` read from another table by key; the last row (by order) of a repeated key wins, and rows without a match get the default."""
    last = other.groupBy(F.col(other_key).alias("__k")).agg(F.max_by(F.col(read), F.col(order)).alias("__v"))
    return df.join(last, df[key] == last["__k"], "left").withColumn(column, F.coalesce("__v", F.lit(default))).drop("__k", "__v")
