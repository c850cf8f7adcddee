"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of all words, and the usual form of each.

A word that is one edit from another holds its first half at the beginning or its second half at the end, as the edit is in one half. Halves
are dealt to shards, and so are the words that may hold them; a shard builds an automaton of its halves and scans its words once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.llm import textkit as tk
from gleaner.llm.common import discard, join_counted, materialize, materialize_counted

#: What words are made of, and what is lower-cased.
LETTERS = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least this many times the occurrences of the word.
FACTOR = 5
#: Stands between the end and the beginning of a word that is written round; no letter.
MARK = " "
#: Pairs of a half's owners and the words that hold it, from which the half and half of the rest are looked for instead.
PAIRS = 1 << 15
#: Halves and words of a shard, which a task holds.
SHARD_ROWS = 200_000


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip_every: int | None = None) -> DataFrame:
    """Rows (word, n): runs of letters of whole texts, A-Z lower-cased, of least_length code points at least, and how often each occurs (least_count at least).

    slip_every: makes slips of the pen to look for. Where it divides the crc32 of `<key>:<run>`, the run loses the code point at that crc32 modulo its length. A null key
    counts as the empty string; a null text has no words. Occurrences are counted before they are shuffled, so a frequent word is a row a task.
    """
    runs = F.regexp_extract_all(F.translate(F.coalesce(docs[text], F.lit("")), _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))
    rows = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("key"), F.explode(F.filter(runs, lambda r: F.length(r) >= least_length)).alias("run"))
    word: Column = F.col("run")
    if slip_every:
        h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
        rows = rows.withColumn("h", h).withColumn("at", F.pmod("h", F.length("run")).cast("int"))
        slipped = F.concat(F.substring(F.col("run"), F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.length("run")))
        word = F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("run"))
    found = rows.select(word.alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (word, n, size, low, high) with group: the size, and what a word of that size has outside of low..high, the end first."""
    length = F.length("word")
    end = F.substring(F.col("word"), length - (F.col("size") - F.col("high")) + 1, F.col("size") - F.col("high"))
    return rows.withColumn("group", F.concat(F.col("size").cast("string"), F.lit(":"), end, F.lit(MARK), F.substring(F.col("word"), F.lit(1), F.col("low"))))


def _halved(rows: DataFrame) -> DataFrame:
    """Two rows for each: the edit is in the second half of low..high, or in the first."""
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(mid.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), mid.alias("high")))
    return rows.select("word", "n", "size", F.explode(halves).alias("half")).select("word", "n", "size", "half.low", "half.high")


def segments(words: DataFrame) -> DataFrame:
    """Rows (group, word, n, size, low, high): the halves of each word (size is its length), and those that words one longer or shorter would have of it.

    Rows of a group agree in size and outside of low..high. A group of which owners times rows exceeds PAIRS is dealt anew by halves of low..high, level by
    level, until it is small or one place is left, where a group has a row a letter: no more than the alphabet, squared for words with one more letter.
    So a half that a third of all words share is no task of its own, and pairs don't grow with its square. Groups that can't hold a pair are left out.
    """
    spark, length = words.sparkSession, F.length("word")
    rows = words.select("word", "n", F.explode(F.sequence(length - 1, length + 1)).alias("size")).where("size > 0")
    rows = rows.select("word", "n", "size", F.lit(0).alias("low"), F.col("size").alias("high"))
    out, temporary = None, []
    while True:
        level, path, total = materialize_counted(_grouped(_halved(rows)), "segments")
        temporary.append(path)
        counts = level.groupBy("group").agg(F.count("*").alias("n"), F.sum((length == F.col("size")).cast("long")).alias("owners"), (F.first("high") - F.first("low")).alias("room"))
        large = (F.col("owners") * F.col("n") > PAIRS) & (F.col("room") > 1)
        counts, path = materialize(counts.where("owners >= 1 AND n >= 2").select("group", "n", large.alias("large")), "groups")
        temporary.append(path)
        told = join_counted(level, counts, "group", total, "word")
        done = told.where("NOT large").select(*level.columns)
        out = done if out is None else out.union(done)
        if not counts.where("large").limit(1).count():
            break
        rows = told.where("large").select("word", "n", "size", "low", "high")
    out, _ = materialize(out, "dealt")
    discard(spark, *temporary)
    return out


def _common(a: str, b: str) -> int:
    """How many code points a and b have in common at the beginning."""
    most = min(len(a), len(b))
    for i in range(most):
        if a[i] != b[i]:
            return i
    return most


def one_edit(a: str, b: str, same: int) -> bool:
    """Whether a and b, unlike, with `same` code points in common at the beginning, differ by one code point inserted, deleted or replaced."""
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def _scan(rows: pa.Table) -> pa.Table:
    """Rows (word, near, near_n) of a shard."""
    import ahocorasick

    owners: dict[str, list[tuple]] = defaultdict(list)
    words: set[str] = set()
    for group, word, n, size, low, high in zip(*(rows.column(c).to_pylist() for c in ("group", "word", "n", "size", "low", "high"))):
        words.add(word)
        if len(word) == size:
            owners[group.partition(":")[2]].append((word, n, low, high))
    automaton = ahocorasick.Automaton()
    for piece, own in owners.items():
        automaton.add_word(piece, own)
    found: tuple[list, list, list] = ([], [], [])
    if owners:
        automaton.make_automaton()
        for b in words:
            for _, own in automaton.iter(f"{b}{MARK}{b}"):  # the mark holds pieces to the end and the beginning of b
                for a, n, low, high in own:
                    if -1 <= len(a) - len(b) <= 1 and low + len(a) - high <= len(b) and a != b:
                        same = _common(a, b)
                        # what begins with a[:high] is found once more where the edit is behind it
                        if (same < high or high == len(a)) and one_edit(a, b, same):
                            for column, value in zip(found, (b, a, n)):
                                column.append(value)
    return pa.table([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, near, near_n), both ways: all pairs of words(word, n), unlike and without MARK, that differ by one inserted, deleted or replaced code point."""
    rows = segments(words)
    shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(pa.Table.from_batches(list(batches))).to_batches()
        tk.give_back()

    return rows.withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards))).groupBy("shard").applyInArrow(scan, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for forms(word, form): the end of each chain of forms, by pointers that reach twice as far each round.

    Counts grow FACTOR times along a chain, so chains have a logarithmic length and no circles.
    """
    paths = []
    now, path = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    paths.append(path)
    while True:
        further = now.select(F.col("word").alias("__at"), F.col("root").alias("__further"))
        moved = Observation()
        step = now.join(further, now["root"] == further["__at"], "left").observe(moved, F.count("__further").alias("n")).select("word", F.coalesce("__further", "root").alias("root"))
        now, path = materialize(step, "chains")
        paths.append(path)
        if not moved.get["n"]:
            discard(forms.sparkSession, *paths[:-1])
            return now


def group(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each row of words(word, n), whose words are different, not null, and without white space.

    n_near: how many words are one edit away. form: the most frequent of them (ties: the smallest in code-point order) if it occurs factor times as often
    as the word, and form_n its count; else null. root: the end of the chain of forms, the word itself if it has none. No words give no rows.
    Other columns of words are ignored.
    """
    words, _ = materialize(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    clear = -F.col("best.n") >= factor * F.col("n")
    formed, _ = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(clear, F.col("best.near")).alias("form"), F.when(clear, -F.col("best.n")).alias("form_n")), "formed")
    found = formed.join(roots(formed.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, slip_every: int | None = None) -> DataFrame:
    """group of the vocabulary of docs: its spelling variants. Repeated rows count as often as they stand there; other columns of docs are ignored."""
    return group(vocabulary(docs, key, text, least_length, least_count, slip_every), factor)
