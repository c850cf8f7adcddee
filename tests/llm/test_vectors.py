"""Near-duplicate vectors and the induced sort against brute force."""

import numpy as np
import pytest

from gleaner.llm import embeddings, induction
from gleaner.llm import suffixes as suffixes_module
from gleaner.llm.induction import suffixes


def make(seed=0, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    x = centres[rng.integers(30, size=n)] + rng.normal(size=(n, dim)) * 0.25
    rows = [(int(i), [float(v) for v in x[i].astype(np.float32)], int(rng.integers(3)) if i % 50 else None) for i in range(n)]
    rows += [(n + i, rows[1][1], rows[1][2]) for i in range(5)]
    rows += [(n + 10, None, 1), (n + 11, [0.0] * dim, 1), (n + 12, [float("nan")] * dim, 1), (n + 13, [None] + [1.0] * (dim - 1), 1), (n + 14, [], 1), (n + 15, [float("inf")] * dim, 1), (n + 16, [1.0], 1), (n + 17, [2.0], 1)]
    return rows


def brute(rows, cosine):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                link[a, b] = link[b, a] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine
    label = np.array([r[0] for r in rows])
    while True:
        now = np.minimum(label, np.where(link, label[None, :], 10**9).min(1))
        if (now == label).all():
            return sorted((r[0], int(link[i].sum()), int(label[i]), bool(label[i] == r[0])) for i, r in enumerate(rows))
        label = now


@pytest.mark.parametrize("block", [1024, 40])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as node", "'y' as key", "1 as rep")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert got == brute(rows, embeddings.COSINE)
    assert sum(g[1] for g in got) > 100


def test_repeated_and_null_keys(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_extreme_doubles(spark):
    """Vectors whose squares under- or overflow are compared as any others."""
    rows = [(1, [1e-170, 0.0], 0), (2, [3e-170, 1e-180], 0), (3, [1e200, 0.0], 0), (4, [0.0, 5e-324], 0), (5, [1e-320, 1e300], 0), (6, [1.0, 1.0], 0), (7, [1.0, 1e-9], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 3, 1)]


def test_tree_covers():
    x = np.random.default_rng(1).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    todo = [embeddings.cover_tree(x)]
    while todo:
        node = todo.pop()
        assert (np.linalg.norm(x[node.members] - x[node.centre], axis=1) <= node.radius + 1e-7).all()
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children]).tolist()) == sorted(node.members.tolist())
            assert node.centre in [c.centre for c in node.children]
        todo += node.children


def test_a_shard_larger_than_its_memory(monkeypatch):
    """Strings of texts some ten times what queues, runs and mapped arrays may hold in memory; the smallest holders are those of a dictionary."""
    rng = np.random.default_rng(5)
    for name, value in (("IN_MEMORY", 2000), ("RUN", 2000), ("STEP", 5000), ("MAPPED", 4096)):
        monkeypatch.setattr(induction, name, value)
    monkeypatch.setattr(suffixes_module, "suffixes", lambda text, depth, last: suffixes(text, depth, last, in_memory=2000, run=2000, step=5000))
    base = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    texts = sorted({base[a : a + n] for a, n in zip(rng.integers(0, 19_000, 60).tolist(), rng.integers(60, 900, 60).tolist())} | {b"ab" * 200, b"ab" * 150, b"x" * 300})
    first = rng.permutation(len(texts)).astype(np.int64)
    want = {}
    for t, f in zip(texts, first.tolist()):
        for a in range(len(t) - 49):
            want[t[a : a + 50]] = min(want.get(t[a : a + 50], f), f)
    got = suffixes_module.smallest_holders(texts, first)
    assert got.tolist() == [want[t[a : a + 50]] for t in texts for a in range(len(t) - 49)] and isinstance(got, np.memmap)


@pytest.mark.parametrize("seed", range(60))
def test_induced_sort(seed):
    """Suffixes come in order to the depth, with their common prefixes, also when queues spill."""
    rng = np.random.default_rng(seed)
    depth = int(rng.integers(2, 9))
    parts = [rng.integers(1, 1 + int(rng.integers(1, 4)), int(rng.integers(1, 30))).astype(np.uint8) for _ in range(int(rng.integers(1, 6)))]
    text = np.concatenate([np.append(p, 0) for p in parts + parts[:1]]).astype(np.uint8)
    starts = np.append(0, np.flatnonzero(text == 0)[:-1] + 1)
    sizes = [len(p) for p in parts + parts[:1]]
    last = starts + np.array([int(rng.integers(0, n)) for n in sizes])
    wanted = {p for a, b in zip(starts, last) for p in range(a, b + 1)}

    def head(p):
        end = p
        while text[end]:
            end += 1
        return bytes(text[p : min(end, p + depth)])

    got = list(suffixes(text, depth, last, in_memory=4 if seed % 2 else 1000, run=3 if seed % 3 else 1000, step=7 if seed % 5 else 1000))
    pos, common = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    heads = [head(p) for p in pos]
    assert wanted <= set(pos.tolist()) and len(set(pos.tolist())) == len(pos)
    assert heads == sorted(heads, reverse=True)
    for a, b, c in zip(heads, heads[1:], common[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert c == same
