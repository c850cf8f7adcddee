"""Column expressions: comparisons, aggregation policies, distances, encodings, text and URL helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres.
EARTH_RADIUS = 6373.0


def compare(left: Column, op: str, right: Column) -> Column:
    """LT LTE EQ NEQ GTE GT; SUBSTR: right contains left; SUPERSTR: left contains right."""
    ops = {
        "LT": lambda: left < right,
        "LTE": lambda: left <= right,
        "EQ": lambda: left == right,
        "NEQ": lambda: left != right,
        "GTE": lambda: left >= right,
        "GT": lambda: left > right,
        "SUBSTR": lambda: F.contains(right, left),
        "SUPERSTR": lambda: F.contains(left, right),
    }
    return ops[op]()


def tree(node: tuple) -> Column:
    """A predicate tree: ("AND", a, b, ...), ("OR", a, b, ...), ("NOT", a), or an atom (column, op, column or value).

    A column of an atom is named by a string; a value is wrapped as ("=", value), which also tells a string from a column.
    String atoms work at any depth.
    """
    if node[0] == "AND":
        return reduce(lambda a, b: a & b, (tree(n) for n in node[1:]))
    if node[0] == "OR":
        return reduce(lambda a, b: a | b, (tree(n) for n in node[1:]))
    if node[0] == "NOT":
        return ~tree(node[1])
    left, op, right = node
    return compare(F.col(left), op, F.lit(right[1]) if isinstance(right, tuple) else F.col(right) if isinstance(right, str) else F.lit(right))


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted array, counting from 0; no interpolation."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


#: Aggregation policies of a group: name to (value column, order column) -> aggregate. First and last follow the order column.
POLICIES = {
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "first": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, o),
    "mean": lambda v, o: F.avg(v),
    "median": lambda v, o: upper_median(F.collect_list(v)),
    "sum": lambda v, o: F.sum(v),
    "count": lambda v, o: F.count(v),
}


def integer_mean(values: Column) -> Column:
    """The mean of integers by integer division, as integer columns have it; mean in POLICIES is the true one."""
    return F.call_function("div", F.sum(values), F.count(values))


def across(columns: Sequence[str], policy: str) -> Column:
    """A policy over the columns of one row."""
    own = [F.col(c) for c in columns]
    whole = F.array(*own)
    return {
        "min": lambda: F.array_min(whole),
        "max": lambda: F.array_max(whole),
        "first": lambda: own[0],
        "last": lambda: own[-1],
        "mean": lambda: reduce(lambda a, b: a + b, own) / len(own),
        "median": lambda: upper_median(whole),
        "sum": lambda: reduce(lambda a, b: a + b, own),
        "count": lambda: F.lit(len(own)),
    }[policy]()


def arithmetic(op: str, a: Column, b: Column, integer: bool) -> Column:
    """add sub mul div mod min max; integers divide and take remainders truncating towards zero."""
    if op == "div":
        return F.call_function("div", a, b) if integer else a / b
    if op == "mod":
        if not integer:
            raise ValueError("mod needs integers")
        return a % b
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}[op]()


def arithmetic_with(op: str, a: Column, number: float, integer: bool) -> Column:
    """arithmetic with a literal; for an integer column the literal is cut to an integer (pass integer=False to compute in doubles)."""
    return arithmetic(op, a, F.lit(int(number)), True) if integer else arithmetic(op, a.cast("double"), F.lit(float(number)), False)


def euclidean(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, ((x - y) * (x - y) for x, y in zip(left, right, strict=True))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres between points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def one_hot(value: Column, domain: Sequence, add_none: bool = False, is_list: bool = False) -> Column:
    """0/1 for each value of the domain (several for a list value); add_none: a last slot for what matched nothing."""
    hit = (lambda v: F.coalesce(F.array_contains(value, F.lit(v)), F.lit(False))) if is_list else (lambda v: F.coalesce(value == F.lit(v), F.lit(False)))
    slots = [hit(v).cast("int") for v in domain]
    if add_none:
        slots.append((reduce(lambda a, b: a + b, slots) == 0).cast("int"))
    return F.array(*slots)


def histogram_slot(value: Column, bins: int) -> Column:
    """Which of `bins` equal bins of [0, 1] a value is in; the last one is closed."""
    return F.least(F.floor(value * bins), F.lit(bins - 1))


def domain_name(url: Column) -> Column:
    """Host of a URL without port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\d*\.", "")


def normalized_url(url: Column) -> Column:
    """Lower-cased scheme and host, without www, default page, fragment and closing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/(?:index|default)\.(?:html?|php|aspx?)$", "/")
    rest = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+", "")
    return F.regexp_replace(F.concat(F.lit("http://"), domain_name(url), rest), r"/$", "")


def without_tags(html: Column) -> Column:
    """Text of an HTML string: scripts, styles and tags go, blanks are squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def clean_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(clean_words(text))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def is_latin(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]"))


def site_name(url: Column) -> Column:
    """The last two labels of a URL's host, three where the last but one is a short second-level domain such as co.uk."""
    host = F.split(domain_name(url), r"\.")
    n = F.when((F.size(host) > 2) & (F.length(F.element_at(host, -2)) <= 3) & (F.length(F.element_at(host, -1)) == 2), F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.slice(host, F.greatest(F.size(host) - n + 1, F.lit(1)), n), ".")


def standard_name(text: Column) -> Column:
    """Lower-case words of letters and digits joined by underscores."""
    return F.array_join(clean_words(text), "_")


def lines(text: Column) -> Column:
    """Lines with something in them, without blanks at their ends."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda s: s != "")


def time_of(text: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")) -> Column:
    """A time by the first of some formats that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
