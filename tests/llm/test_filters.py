"""The filter audit against a plain audit of every row in every order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from gleaner.llm import filters

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Names that the operator uses itself; they must not get in its way.
SCHEMA = "doc_id long, text string, source string, key string, part string, mask string, digest string, n string, first string, least string, good string, __key string, __none string"
LONG = " ".join(f"word{i}" for i in range(250))
TEXTS = [
    LONG, LONG, LONG + " & more", "Ab " * 300, "", "", None, " \n\t ", "one", "ONE TWO", "x" * 3_000_000, "漢字 " * 210, "É" * 10 + " " + LONG, LONG.upper(), "w # " * 120,
    " ".join(f"w{i % 120}" for i in range(240)), " ".join(f"w{i % 119}" for i in range(240)), "\x0b".join(f"v{i}" for i in range(200)), "\xa0".join(f"v{i}" for i in range(200)), "a" * 98 + "BC", "a" * 97 + "BCD",
]


def rows():
    out = [(i, t, [None, "", "s", "t", "hot"][min(i % 7, 4)]) for i, t in enumerate(TEXTS)]
    out += [(100 + i, LONG, "hot") for i in range(40)] + [(50, "tail", "s"), (50, "tail", "s"), (50, "tail", "t"), (3, "tail", "s"), (None, "tail", "s"), (None, LONG, None), (None, "alone", "s"), (None, "alone", "hot"), (None, None, "s")]
    return [(*r, *["z"] * 10) for r in out]


LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, None, 1), (50, 1, None), (100, 0, 1), (None, 1, 1), (999, 1, 1)]


def plain(docs, labels):
    def fails(r):
        t = r[1] or ""
        w = WORD.findall(t)
        dup = any((o[1] or "") == t and o[0] is not None and (r[0] is None or o[0] < r[0]) for o in docs)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": dup}

    marks = {k: (any(i == k and q == 1 for i, q, _ in labels), any(i == k and t == 1 for i, _, t in labels)) for k in {x[0] for x in labels} - {None}}
    judged = [(r[2] or "", fails(r), *marks.get(r[0], (False, False))) for r in docs]
    want, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                out = [j for j in left if j[0][x]]
                left = [j for j in left if not j[0][x]]
                want[part, "".join(order), step] = (len(left), len(out), sum(j[0][x] for j in gone), sum(j[0][x] and sum(j[0].values()) == 1 for j in own), sum(j[1] for j in out), sum(j[2] for j in out))
                gone = gone + out
                shapley[part, x] += len(out)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_equals_a_plain_audit(spark):
    docs, own = rows(), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filters.audit(spark.createDataFrame(docs, SCHEMA).repartition(7), own).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}
    assert len(got) == len(found)
    assert got == plain(docs, LABELS)
    assert {k[0] for k in got} == {"", "s", "t", "hot"} and len(got) == 4 * 600


def test_empty_tables(spark):
    no_labels, no_docs = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], SCHEMA)
    assert filters.audit(no_docs, no_labels).count() == 0
    one = filters.audit(spark.createDataFrame([(1, None, None, *["z"] * 10)], SCHEMA), no_labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120  # too short, and nothing else


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a#"), (2, "a#"), (3, "b")], "doc_id long, text string").selectExpr("*", "'s' AS source")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.removed, r.redundant, r.good_lost, r.shapley) for r in filters.audit(docs, labels, lambda t: {"S": t.rlike("#")}, duplicates="D").collect()}
    assert got == {("SD", 1): (2, 0, 1, 3), ("SD", 2): (0, 1, 0, 1), ("DS", 1): (1, 0, 1, 1), ("DS", 2): (1, 1, 0, 3)}
    with pytest.raises(ValueError):
        filters.audit(docs, labels, lambda t: {"D": t.rlike("#")}, duplicates="D")
