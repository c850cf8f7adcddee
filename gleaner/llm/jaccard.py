"""Exact Jaccard join of documents on word shingles, as a blocked product of the sparse document by n-gram incidence.

Documents that share one of their rarest shingles, or are joined by a chain of such, form a family. A family is cut into blocks, and the overlaps of
a pair of blocks are worked out as a product of the incidence matrix with its transpose, for pairs whose sizes allow a link. A family of too many
blocks is compared pair by pair instead, where sizes and the places of the shared shingle allow a link; as only what links connect is asked for,
its documents are first compared with a few pivots of each shingle, and pairs that links connect already aren't looked at, so that
neither a large group of copies nor a long chain of documents with little in common takes all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import chunks as ck
from gleaner.llm import textkit as tk
from gleaner.llm.common import components, discard, free_shuffles, join_counted, materialize, materialize_counted, parts, reached

SHINGLE = 5
PERCENT = 75
#: N-grams a step of the product.
COLUMNS = 4096
#: Pivots of a shingle that all its other documents are compared with first, and how often at most that is done anew.
PIVOTS = 3
ROUNDS = 4
#: Pairs for each prefix entry that are worth enumerating without another round of pivots.
ENOUGH = 64
#: Documents of a shingle that are paired by a join; more are paired in blocks.
FEW = 4096
#: Documents a side of a block of the product; families of more than MANY blocks are compared pair by pair.
BLOCK, MANY = 1024, 8
#: An n-gram that so many documents of a side have is a column of a dense product; the others' pairs are counted one by one.
DENSE = 16
#: The comparisons with a document are dealt to so many tasks at least, and to one more for each 100,000 pairs there are.
SPLITS = 64


def _shingles(c: ck.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a chunk, sorted by text and shingle: two arrays, shingles and texts."""
    w = tk.Words(c.raw, c.off)
    h = w.hashes(tk.lower_ascii(c.raw))
    at = np.flatnonzero(tk.inside(w.doc, SHINGLE))
    key, doc = tk.windows(h, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64), w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            has = w.count[short] > j
            own[has] = own[has] * np.uint64(0x9FB21C651E98DF25) + h[w.cut[short[has]] + j]
        key = np.concatenate([key, tk.mix(own + w.count[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def survivors(docs: DataFrame, key: str, text: str, mark: str | None = None) -> tuple[DataFrame, str, int]:
    """Rows (node, key, n_shingles, sign, keys, counts, mark) for each row of docs, written to the shared folder.

    keys are the shingles that other documents have too, with how many do; both are null if they are too few for any link:
    an overlap never exceeds them, and a link needs an overlap of PERCENT of n_shingles at least. sign stands for the whole set.
    mark: a bigint column of docs that goes along; null without one.
    """
    n_parts = parts(docs)
    chunks, packed = ck.pack(docs, key, text, carry=[mark] if mark else None)
    counts, counts_path = materialize(ck.count_shared(chunks, _shingles, n_parts), "counts")

    def send(batches):
        for c in ck.each(batches):
            k, doc = _shingles(c)
            n = len(c.ids)
            cut = np.searchsorted(doc, np.arange(n + 1))
            size = np.diff(cut)
            count = ck.values_of(c)[np.searchsorted(ck.distinct(k, doc)[0], k)] if len(k) else np.zeros(0, np.uint8)
            shared = count >= 2
            keep = (100 * tk.per_text(shared, cut) >= PERCENT * size) & (size > 0)
            sums = np.zeros((2, len(k) + 1), np.uint64)
            np.cumsum(k, out=sums[0, 1:])
            np.cumsum(tk.mix(k ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            sign = sums[:, cut[1:]] - sums[:, cut[:-1]]
            rows = [(k[a:b][shared[a:b]], count[a:b][shared[a:b]]) if ok else None for a, b, ok in zip(cut, cut[1:], keep)]
            cols = [
                c.key_column(), pa.array(size.astype(np.int64)),
                pa.array([sign[:, i].tobytes() + int(size[i]).to_bytes(8, "little") if keep[i] else None for i in range(n)], pa.binary()),
                pa.array([r and r[0].tobytes() for r in rows], pa.binary()), pa.array([r and r[1].tobytes() for r in rows], pa.binary()),
                c.row.field(mark) if mark else pa.nulls(n, pa.int64()),
            ]
            names = ["key", "n_shingles", "sign", "keys", "counts", "mark"]
            whole = pa.RecordBatch.from_arrays(cols, names)
            for a in range(0, n, 256):
                yield whole.slice(a, 256)

    found = ck.answered(chunks, counts).mapInArrow(tk.lean(send), "key long, n_shingles long, sign binary, keys binary, counts binary, mark long")
    out = materialize_counted(found.withColumn("node", F.monotonically_increasing_id()), "sets")
    ck.release(docs.sparkSession, packed)
    discard(docs.sparkSession, counts_path)
    return out


def prefixes(sets: DataFrame) -> DataFrame:
    """Rows (gram, node, size, place): of each set the rarest shingles, enough that two sets that link share one (ties by hash), and their places in that order."""

    def run(batches):
        for b in batches:
            out = []
            for node, n, k, c in zip(b.column("node").to_pylist(), b.column("n_shingles").to_pylist(), b.column("keys"), b.column("counts")):
                k, c = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint8)
                alone = n - len(k)  # these come first in the order, and nothing shares them
                take = n - (PERCENT * n + 99) // 100 + 1 - alone
                if take > 0:
                    pick = k[np.lexsort((k, c))[:take]]
                    out.append((pick.view(np.int64), np.full(len(pick), node), np.full(len(pick), n), alone + np.arange(len(pick))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["gram", "node", "size", "place"])

    return sets.select("node", "n_shingles", "keys", "counts").mapInArrow(tk.lean(run), "gram long, node long, size long, place long")


def may_link(size_a, place_a, size_b, place_b):
    """Whether sizes, and the places of the first shingle that both sets have, allow a link; of columns or arrays.

    What comes before that place is not shared, so the overlap is at most what is left of either set.
    """
    least = F.least if isinstance(size_a, Column) else np.minimum
    most = F.greatest if isinstance(size_a, Column) else np.maximum
    rest = least(size_a - place_a, size_b - place_b)
    return (100 * least(size_a, size_b) >= PERCENT * most(size_a, size_b)) & ((100 + PERCENT) * rest >= PERCENT * (size_a + size_b))


def product(rows: list[np.ndarray], size: np.ndarray, pivot_of: np.ndarray, pivots: list[np.ndarray], pivot_size: np.ndarray) -> np.ndarray:
    """Which rows link with their pivot: the wanted entries of the product of two incidence matrices.

    Overlap counts accumulate over blocks of n-grams; after each block the rows whose overlap can't reach its bound any more are discarded.
    """
    need = -(-PERCENT * (size + pivot_size[pivot_of]) // (100 + PERCENT))
    overlap = np.zeros(len(rows), np.int64)
    grams = np.unique(np.concatenate(pivots)) if pivots else np.zeros(0, np.uint64)
    if not len(grams) or not len(rows):
        return np.zeros(len(rows), bool)
    column = np.searchsorted(grams, np.concatenate(pivots))
    entry = np.sort(column * len(pivots) + np.repeat(np.arange(len(pivots)), [len(p) for p in pivots]))
    keys, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
    real = grams[at] == keys
    at, owner = at[real], owner[real]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    left = np.bincount(owner, minlength=len(rows))
    alive = left >= need
    for first in range(0, len(grams), COLUMNS):
        mine = slice(*np.searchsorted(at, [first, first + COLUMNS]))
        a, o = at[mine], owner[mine]
        left -= np.bincount(o, minlength=len(rows))
        a, o = a[alive[o]], o[alive[o]]
        wanted = a * len(pivots) + pivot_of[o]
        found = np.minimum(np.searchsorted(entry, wanted), len(entry) - 1)
        overlap += np.bincount(o[entry[found] == wanted], minlength=len(rows))
        alive &= overlap + left >= need
        if not alive.any():
            break
    return alive & (overlap >= need) & (overlap > 0)


def verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, n_parts: int) -> DataFrame:
    """The pairs (a, b) whose sets link. The comparisons with one a are dealt to several tasks by b, and a task takes them batch by batch."""
    pairs = pairs.withColumn("split", F.pmod(F.xxhash64("b"), F.lit(SPLITS + n_pairs // 100_000)).cast("int"))
    own = sets.select("node", F.col("n_shingles").alias("size"), "keys")
    heads = pairs.select("a", "split").distinct().join(own, F.col("a") == F.col("node")).select("a", "split", F.lit(0).alias("role"), "node", "size", "keys")
    others = pairs.join(own, F.col("b") == F.col("node")).select("a", "split", F.lit(1).alias("role"), "node", "size", "keys")

    def run(batches):
        pivots, sizes, names = [], [], []
        for b in batches:
            pivots, sizes, names = pivots[-1:], sizes[-1:], names[-1:]  # the last one's others may go on
            rows, size, pivot_of, node = [], [], [], []
            for a, role, v, n, k in zip(b.column("a").to_pylist(), b.column("role").to_pylist(), b.column("node").to_pylist(), b.column("size").to_pylist(), b.column("keys")):
                k = np.frombuffer(k.as_buffer(), np.uint64)
                if role == 0:
                    pivots.append(k.copy())
                    sizes.append(n)
                    names.append(a)
                else:
                    rows.append(k)
                    size.append(n)
                    pivot_of.append(len(pivots) - 1)
                    node.append(v)
            pivot_of = np.array(pivot_of, np.int64)
            link = product(rows, np.array(size, np.int64), pivot_of, pivots, np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[pivot_of[link]]), pa.array(np.array(node, np.int64)[link])], ["a", "b"])

    both = heads.union(others).repartition(n_parts, "a", "split").sortWithinPartitions("a", "split", "role")
    return both.mapInArrow(tk.lean(run), "a long, b long")


def _pivot_pairs(entries: DataFrame, total: int, turn: int) -> DataFrame:
    """Pairs (a, b): of each shingle that more than one component has in its prefixes, some documents by a random rank, with all others that they may link with."""
    rank = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(turn * PIVOTS + i)).alias("rank"), "node", "size", "place", "component"))
    grams = entries.groupBy("gram").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.array(*(rank(i) for i in range(PIVOTS))).alias("pivots"))
    met = join_counted(entries, grams.where("lo < hi").select("gram", "n", "pivots"), "gram", total, "node").withColumn("p", F.explode("pivots"))
    fits = may_link(F.col("p.size"), F.col("p.place"), F.col("size"), F.col("place"))
    return met.where((F.col("p.component") != F.col("component")) & fits).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()


def _all_pairs(entries: DataFrame, total: int, n_parts: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, of each shingle; a shingle of many documents is split into pairs of blocks."""
    grams = entries.groupBy("gram").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram", "n", F.col("n").alias("m"))
    live = join_counted(entries, grams, "gram", total, "node")
    few = live.where(F.col("m") <= FEW)
    x, y = (few.select("gram", *(F.col(c).alias(f"{c}{i}") for c in ("node", "size", "place", "component"))) for i in (1, 2))
    fits = may_link(F.col("size1"), F.col("place1"), F.col("size2"), F.col("place2")) & (F.col("component1") != F.col("component2")) & (F.col("node1") < F.col("node2"))
    joined = x.join(y, (x["gram"] == y["gram"]) & fits).select(F.col("node1").alias("a"), F.col("node2").alias("b"))

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = live.where(F.col("m") > FEW).withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("cell", F.xxhash64("gram", "i", "j"))
    dealt = dealt.select("cell", "gram", "i", "j", "own", "node", "size", "place", "component")

    def run(batches):
        for group in ck.grouped(batches, "cell"):
            for gram in {(r["gram"], r["i"], r["j"]) for r in group}:  # one, unless hashes of cells are equal
                rows = [r for r in group if (r["gram"], r["i"], r["j"]) == gram]
                one = {c: np.array([r[c] for r in rows if r["own"] == gram[1]], np.int64) for c in ("node", "size", "place", "component")}
                two = {c: np.array([r[c] for r in rows if r["own"] == gram[2]], np.int64) for c in ("node", "size", "place", "component")}
                for k in range(len(one["node"])):
                    ok = may_link(one["size"][k], one["place"][k], two["size"], two["place"]) & (two["component"] != one["component"][k])
                    b = two["node"][ok & (two["node"] > one["node"][k]) if gram[1] == gram[2] else ok]
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, one["node"][k])), pa.array(np.maximum(b, one["node"][k]))], ["a", "b"])

    many = dealt.repartition(n_parts, "cell").sortWithinPartitions("cell").mapInArrow(tk.lean(run), "a long, b long")
    return joined.union(many).distinct()


def pair_links(sets: DataFrame, entries: DataFrame, total: int, n_parts: int) -> tuple[DataFrame | None, list[str]]:
    """links_between for sets of large families, given their prefixes: by pivots, and then by all pairs that aren't connected yet and may link."""
    spark = sets.sparkSession
    entries, entries_path = materialize(entries, "prefixes")
    n_sets = sets.count()
    paths, links, found = [], None, None

    def compared(pairs: DataFrame) -> int:
        """Verify pairs; how many of them link."""
        nonlocal links, found
        pairs, pairs_path, n = materialize_counted(pairs, "pairs")
        new, new_path, n_links = materialize_counted(verified(pairs, n, sets, n_parts), "links") if n else (None, "", 0)
        discard(spark, pairs_path, *([new_path] if n and not n_links else []))
        free_shuffles(spark)
        if n_links:
            links = new if links is None else links.union(new)
            paths.append(new_path)
            old, found = found, materialize(components(links), "found")
            discard(spark, *([old[1]] if old else []))
        return n_links

    own, own_path = entries.withColumn("component", F.col("node")), ""
    for turn in range(ROUNDS):
        added = compared(_pivot_pairs(own, total, turn))
        if added:
            discard(spark, *([own_path] if own_path else []))
            own = entries.join(found[0].select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
            own, own_path = materialize(own, "entries")
        each = own.groupBy("gram", "component").agg(F.count("*").cast("double").alias("k")).groupBy("gram").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("inner"))
        work = each.agg(F.sum(F.col("n") * F.col("n") - F.col("inner"))).first()[0] or 0.0  # twice the pairs of different components
        if work <= ENOUGH * total or 4 * added < n_sets or turn == ROUNDS - 1:  # another round of pivots wouldn't connect much
            if work:
                compared(_all_pairs(own, total, n_parts))
            break
    discard(spark, entries_path, *([own_path] if own_path else []), *([found[1]] if found else []))
    return links, paths


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of a shares with each one of b: a product of two sparse incidence matrices, accumulated over blocks of n-grams.

    An n-gram of few sets adds one to each pair of them; those of many make columns of dense blocks.
    """
    out = np.zeros((len(a), len(b)), np.int32)
    ka, kb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(ka, kb)
    if not len(both):
        return out

    def entries(k, r):
        at = np.minimum(np.searchsorted(both, k), len(both) - 1)
        real = both[at] == k
        order = np.argsort(at[real], kind="stable")
        return at[real][order], r[real][order]

    (ia, ra), (ib, rb) = entries(ka, ra), entries(kb, rb)
    na, nb = np.bincount(ia, minlength=len(both)), np.bincount(ib, minlength=len(both))
    dense = (na >= DENSE) & (nb >= DENSE)
    first_b = np.cumsum(nb) - nb
    flat = out.reshape(-1)
    light = np.flatnonzero(~dense[ia])
    for at in range(0, len(light), 1 << 16):  # each entry of a with all of b's in its column
        own = light[at : at + (1 << 16)]
        times = nb[ia[own]]
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pair = np.repeat(ra[own], times) * len(b) + rb[np.repeat(first_b[ia[own]], times) + within]
        cell, n = np.unique(pair, return_counts=True)
        flat[cell] += n.astype(np.int32)
    column = np.cumsum(dense) - 1
    keep_a, keep_b = dense[ia], dense[ib]
    ca, ra, cb, rb = column[ia[keep_a]], ra[keep_a], column[ib[keep_b]], rb[keep_b]
    for at in range(0, int(dense.sum()), COLUMNS):
        width = min(COLUMNS, int(dense.sum()) - at)
        sa, sb = slice(*np.searchsorted(ca, [at, at + width])), slice(*np.searchsorted(cb, [at, at + width]))
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ma[ra[sa], ca[sa] - at] = 1
        mb[rb[sb], cb[sb] - at] = 1
        out += np.rint(ma @ mb.T).astype(np.int32)  # at most COLUMNS, so exact
    return out


def linked(a: list[np.ndarray], size_a: np.ndarray, b: list[np.ndarray], size_b: np.ndarray) -> np.ndarray:
    """Which sets of a and b link, as a matrix. Sets that no other's size allows a link with take no part in the product."""
    fit = (100 * np.minimum.outer(size_a, size_b) >= PERCENT * np.maximum.outer(size_a, size_b)) & (np.minimum.outer(size_a, size_b) > 0)
    rows, cols = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
    out = np.zeros(fit.shape, bool)
    if len(rows) and len(cols):
        o = overlaps([a[i] for i in rows], [b[i] for i in cols])
        out[np.ix_(rows, cols)] = ((100 + PERCENT) * o.astype(np.int64) >= PERCENT * np.add.outer(size_a[rows], size_b[cols])) & (o > 0)
    return out & fit


def forest(node_a: np.ndarray, node_b: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what the matrix connects: at most one a node."""
    n, m = link.shape
    i, j = np.nonzero(link)
    label = np.arange(n + m)
    while True:
        now = label.copy()
        np.minimum.at(now, i, label[n + j])
        np.minimum.at(now, n + j, label[i])
        now = np.minimum(now, now[now])
        if (now == label).all():
            break
        label = now
    nodes = np.concatenate([node_a, node_b])
    return nodes, nodes[label]


def block_links(rows: DataFrame, n_parts: int) -> DataFrame:
    """Rows (a, b) that connect the sets of each family; rows: (node, family, blocks, size, keys).

    A pair of blocks is a task's work; a set goes to as many as its family has blocks, MANY at most.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "keys")
    )
    dealt = dealt.withColumn("cell", F.struct("family", "i", "j"))

    def run(batches):
        for group in ck.grouped(batches, "cell"):
            i, j = group[0]["i"], group[0]["j"]
            side = [[r for r in group if r["own"] == x] for x in ((i,) if i == j else (i, j))]
            if not all(side):
                continue
            take = lambda rows: ([np.frombuffer(r["keys"], np.uint64) for r in rows], np.array([r["size"] for r in rows]), np.array([r["node"] for r in rows]))
            (ka, sa, na), (kb, sb, nb) = take(side[0]), take(side[-1])
            x, y = forest(na, nb, linked(ka, sa, kb, sb))
            real = x != y
            yield pa.RecordBatch.from_arrays([pa.array(x[real]), pa.array(y[real])], ["a", "b"])

    return dealt.repartition(n_parts, "cell").sortWithinPartitions("cell").mapInArrow(tk.lean(run), "a long, b long")


def links_between(sets: DataFrame, n_sets: int, n_parts: int) -> tuple[DataFrame, list[str]]:
    """Rows (a, b): links enough to connect what all links between sets (node, n_shingles, keys, counts) connect. Also the tables that they are read from."""
    entries, entries_path, total = materialize_counted(prefixes(sets), "prefixes")
    star = entries.groupBy("gram").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.count("*").alias("n")).where("last > a").select("gram", "a", "n")
    touching = join_counted(entries.select("gram", "node"), star, "gram", total, "node").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found, found_path = materialize(components(touching), "families")
    sizes = found.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tagged = join_counted(found.select(F.col("id").alias("node"), F.col("component").alias("family")), sizes, "family", n_sets, "node")
    tagged, tagged_path = materialize(tagged, "families")
    small = sets.select("node", F.col("n_shingles").alias("size"), "keys").join(tagged.where(F.col("blocks") <= MANY), "node")
    links, path = materialize(block_links(small, n_parts), "links")
    paths = [path]
    if not tagged.where(F.col("blocks") > MANY).isEmpty():
        large, large_path = materialize(sets.join(tagged.where(F.col("blocks") > MANY).select("node"), "node", "left_semi"), "large")
        more, more_paths = pair_links(large, entries.join(large.select("node"), "node", "left_semi"), total, n_parts)
        links = links.union(more) if more is not None else links
        paths += more_paths
        discard(sets.sparkSession, large_path)
    discard(sets.sparkSession, entries_path, found_path, tagged_path)
    free_shuffles(sets.sparkSession)
    return links, paths


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """Rows (node, key, n_shingles, component_id, first_node[, mark]), one for each row of docs.

    Two rows link when 100 * overlap >= 75 * union of their sets of distinct 5-word shingles (A-Z lower-cased; a text of fewer words
    is one shingle; a text without words, or null, links with nothing). component_id is the smallest key that links reach,
    the row's own included (null only if all of them are null); first_node is the same number for all rows that links connect.
    Rows with equal keys are rows of their own. Equal sets count once, and shingles are told apart by 64 bits; the rest is exact.
    A text of any length is one set; a task holds the sets of a batch of rows and those of a chunk's texts (CHUNK_BYTES, or one text).
    """
    spark = docs.sparkSession
    n_parts = parts(docs)
    sets, _, total = survivors(docs, key, text, mark)
    live = sets.where("sign is not null")
    classes, classes_path = materialize(live.groupBy("sign").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "classes")
    reps, _ = materialize(join_counted(live.select("node", "sign"), classes, "sign", total, "node").select("node", "rep"), "reps")
    unique = live.join(classes.select(F.col("rep").alias("node")), "node", "left_semi").select("node", "n_shingles", "keys", "counts")
    unique, unique_path, n_sets = materialize_counted(unique, "unique")
    links, paths = links_between(unique, n_sets, n_parts)
    found = components(links)
    rows = sets.select("node", "key", "n_shingles", *["mark"] * bool(mark)).join(reps, "node", "left").withColumn("rep", F.coalesce("rep", "node"))
    out = reached(rows, total, found)
    discard(spark, classes_path, unique_path, *paths)
    return out.select("node", F.col("key").alias(key), "n_shingles", "component_id", "first_node", *([F.col("mark").alias(mark)] if mark else []))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group that links connect: its smallest key (nulls last). Rows without links, also empty ones, stay.

    Keys and 64-bit hashes of texts are joined back, so of rows with one key, or null, exactly those go that the join drops. Rows with
    equal keys and equal texts link with each other, unless they have no words; one of them stays at most.
    """
    marked = docs.withColumn("__mark", F.xxhash64(text))
    rows = join(marked, key, text, "__mark")
    best = F.min(F.struct(F.col(key).isNull(), F.col(key), F.col("node"))).alias("best")
    heads = rows.groupBy("first_node").agg(best).select(F.col("best.node").alias("node"), F.lit(1).alias("stays"))
    by_text = rows.join(heads, "node", "left").groupBy(F.col(key).alias("__key"), F.col("__mark").alias("__text")).agg(F.count("*").alias("rows"), F.count("stays").alias("stay"))
    by_text, _ = materialize(by_text.where("stay < rows"), "dropped")
    same = lambda other: marked[key].eqNullSafe(other["__key"]) & (marked["__mark"] == other["__text"])
    gone = by_text.hint("shuffle_hash")
    kept = marked.join(gone, same(gone), "left_anti").select(*docs.columns)
    some = by_text.where("stay > 0")
    if some.isEmpty():
        return kept
    return kept.unionByName(marked.join(some, same(some)).dropDuplicates(["__key", "__text"]).select(*docs.columns))
