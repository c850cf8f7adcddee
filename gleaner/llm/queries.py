"""The queries of the operators, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import classifier, embeddings, filters, jaccard, language, mixing, packing, pieces, quality, sharding, spelling, substrings, suffixes
from gleaner.llm.common import held_out, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1; null and empty texts have no bytes, null ids come after all others, rows of one id do not cut each other."""
    return suffixes.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2; null labels and vectors without a direction link with nothing, repeated rows link with each other."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3; null and empty texts have no words and fail the base rules, null is a language of its own."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4; null and empty texts get a score as all others, equal texts equal scores."""
    found = classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes, round trip and parity of each document; null and empty texts have no tokens."""
    return pieces.encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6; texts without words link with nothing, rows of one id are rows of their own."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read of each document in a mix of nearly equal source weights, no source more than twice; a null source is one of its own."""
    return mixing.weigh(table(spark, sf_dir, "documents"), mixing.Target(entropy=0.9999, repetition=2.0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8, with the spans of one language; null texts and those without letters are und."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return language.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), "spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9; null texts have no words, null ids come after all others, rows of one id do not cut each other."""
    return substrings.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 by the law `key`; null texts have size 1, equal and null ids go to one shard each and get slots of their own."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=16)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11; null texts are empty, null ids come after all others, an id of several labels counts if one of them is 1."""
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 12; null texts have no words, a null id counts as the empty string, repeated rows count each."""
    return spelling.variants(table(spark, sf_dir, "documents"), slip_every=199)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13; null and empty texts are the end token alone, repeated rows and null ids are pieces like any others."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


QUERIES = [op1_suffix_array_dedup, op2_embedding_near_dedup, op3_quality_rules, op4_quality_classifier, op5_sentencepiece, op6_ngram_jaccard, op7_source_mixing, op8_language_id, op9_substring_dedup, op10_rendezvous_sharding, op11_filter_audit, op12_spelling_variants, op13_best_fit_packing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The least id that each one reaches over links(a, b) both ways, of all(id).
_REACH = """reach(id, c) AS (SELECT id, id FROM every UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id WHERE reach.c < links.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)"""

ORACLES = {
    "op2_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
    every AS (SELECT vec_id AS id FROM embeddings), {_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, id = c AS kept FROM comp LEFT JOIN n ON n.a = comp.id""",
    "op6_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
    every AS (SELECT doc_id AS id FROM documents), {_REACH}
    SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM comp LEFT JOIN n ON n.doc_id = comp.id""",
    "op9_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) t(i)),
    f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN f USING (k), range(13) r(j) WHERE m < doc_id),
    word AS (SELECT doc_id, i AS pos, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
    kept AS (SELECT doc_id, count(*) AS n, count(gone.pos) AS r, string_agg(word, ' ' ORDER BY word.pos) FILTER (gone.pos IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op11_filter_audit": rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_WORDS.format("t")} AS ws FROM d), mark AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    x AS (SELECT part, doc_id, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
    cell AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM x LEFT JOIN mark USING (doc_id) GROUP BY part, mask),
    l(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o AS (SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31),
    s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS prior FROM o, range(1, 6) t(i)),
    r AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & prior = 0 AND mask & bit > 0), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (mask & prior > 0 AND mask & bit > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (mask & prior = 0 AND mask & bit > 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & prior = 0 AND mask & bit > 0), 0) AS BIGINT) AS toxic_lost
        FROM cell, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}


#: crc32 of UTF-8 by its table of 256 steps, which is made by the rule of the polynomial.
_CRC = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

ORACLES["op12_spelling_variants"] = rf"""WITH RECURSIVE {_CRC},
    run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
    own AS (SELECT k, r, hex(encode(k || r)) AS x, count(*) AS n FROM run WHERE length(r) >= 6 GROUP BY k, r),
    hash AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM own, crc),
    word AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, CAST(sum(n) AS BIGINT) AS n FROM hash GROUP BY w HAVING sum(n) >= 5 AND length(w) >= 6),
    cut AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS d FROM word, unnest(range(1, length(w) + 1)) t(i)),
    less AS (SELECT DISTINCT cut.w AS a, word.w AS b FROM cut JOIN word ON word.w = cut.d),
    near AS (SELECT x.w AS a, y.w AS b FROM cut x JOIN cut y ON x.i = y.i AND x.d = y.d AND x.w <> y.w UNION SELECT a, b FROM less UNION SELECT b, a FROM less),
    best AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN word ON word.w = near.b),
    form AS (SELECT w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * word.n THEN b END AS form, CASE WHEN best.n >= 5 * word.n THEN best.n END AS form_n FROM word LEFT JOIN best ON best.a = w AND k = 1),
    chain AS (SELECT w, w AS tip FROM form UNION ALL SELECT chain.w, form.form FROM chain JOIN form ON form.w = chain.tip WHERE form.form IS NOT NULL),
    root AS (SELECT chain.w, tip FROM chain JOIN form ON form.w = tip WHERE form.form IS NULL)
    SELECT form.w AS word, form, tip AS root, n, n_near, form_n FROM form JOIN root ON root.w = form.w"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
