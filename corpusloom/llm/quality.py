"""Quality rules: plain counts of a text, and the log-likelihood ratio of its hashed n-grams.

Words and pairs of words hash to a fixed number of buckets. Two multinomials over the buckets, one of
trusted documents and one of the whole corpus, give each bucket the logarithm of the ratio of its
probabilities as a fixed-point integer. A document's score is the sum over its n-grams; a document goes if
the score is below a threshold times its n-grams. Integers make every verdict the same in any order of
the rows. Only DataFrame functions are used, and all of a document's work stays in its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words.
SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Buckets for words, and as many again for pairs of words; a power of two. Few enough that a bucket holds
#: hundreds of n-grams of even a small corpus, so that words new to the target aren't held against a text.
BUCKETS = 1 << 12
#: Counts that each bucket of the target borrows from the corpus, on average.
BORROWED = 20
#: Weights are whole millionths of a natural logarithm.
SCALE = 1_000_000
#: A document goes if its mean weight, with SHRINK n-grams of weight 0 added, is below this.
THRESHOLD, SHRINK = -0.05, 20
#: Trusted documents that the target is learnt from, at most; those with the least hashes of their ids.
TARGET_ROWS = 20_000
WINDOW = 5


def words_of(text: Column) -> Column:
    """Longest runs of characters other than the separators; none for null."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(trimmed != "", F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+", -1)).otherwise(F.array().cast("array<string>"))


def _head(x: str, drop: int) -> Column:
    """``x`` without its last ``drop`` values."""
    return F.slice(x, F.lit(1), F.greatest(F.size(x) - drop, F.lit(0)))


def _tail(x: str, drop: int, most: Column | None = None) -> Column:
    """``x`` without its first ``drop`` values."""
    return F.slice(x, F.lit(drop + 1), F.greatest(F.size(x) - drop, F.lit(0)) if most is None else most)


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_words``, and ``_h1`` and ``_h2``: the hashes of its words and pairs of words."""
    df = df.withColumn("_words", words_of(F.col(text)))
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_h2", F.zip_with(_head("_h1", 1), _tail("_h1", 1), lambda a, b: F.xxhash64(a, b)))


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """The weight of each bucket, from all ``docs`` and those of them whose ids are in ``trusted``.

    ``trusted`` has a column ``id_col``; of more than TARGET_ROWS ids, those with the least hashes serve,
    so the broadcast is bounded. The target leans on the corpus by BORROWED counts for each bucket: with no
    trusted document every weight is 0. The first half of the weights is for words, the second for pairs.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(TARGET_ROWS).withColumn("_target", F.lit(1))
    held = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    held = _hashed(held.join(F.broadcast(ids), "_id", "left").select("_target", "_text"), "_text")
    halves = F.array(F.struct("_h1", F.lit(0).alias("_at")), F.struct(F.col("_h2").alias("_h1"), F.lit(buckets).alias("_at")))
    held = held.select("_target", F.explode(halves).alias("_half")).select("_target", "_half._at", F.explode("_half._h1").alias("_gram"))
    bucket = F.col("_gram").bitwiseAND(F.lit(buckets - 1)) + F.col("_at")
    counts = held.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count("_target").alias("t"))
    found = {row.bucket: (row.n, row.t) for row in counts.collect()}  # a row for each bucket at most
    n, t = (sum(x[i] for x in found.values()) for i in (0, 1))
    out = []
    for b in range(2 * buckets):
        raw, target = found.get(b, (0, 0))
        p = (raw + 1) / (n + 2 * buckets)
        q = (target + 2 * BORROWED * buckets * p) / (t + 2 * BORROWED * buckets)
        out.append(round(SCALE * (math.log(q) - math.log(p))))
    return out


def judged(docs: DataFrame, bucket_weights: list[int], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    A null or empty text has no words and fails; whole texts are read, however long. ``score`` is the
    length-normalised ratio in nats for an n-gram. Each row is judged alone: ids may repeat or be null, and equal
    rows have equal results. An empty table gives no rows. Input columns with the names of results are replaced.
    """
    found = _judged(docs, bucket_weights, text_col, threshold)
    return found.select(*(F.col("own")[c].alias(c) for c in docs.columns if c not in MADE), *MADE)


def kept_rows(docs: DataFrame, bucket_weights: list[int], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Those rows of ``docs`` that are kept, as they came; columns may have any names."""
    found = _judged(docs, bucket_weights, text_col, threshold).where("kept")
    return found.select(*(F.col("own")[c].alias(c) for c in docs.columns))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _judged(docs: DataFrame, bucket_weights: list[int], text_col: str, threshold: float) -> DataFrame:
    """``own`` (a struct of the row as it came) and the results."""
    df = _hashed(docs.select(F.struct(*docs.columns).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), "_text")
    # runs of WINDOW words, from pairs of pairs
    df = df.withColumn("_h4", F.zip_with(_head("_h2", 2), _tail("_h2", 2), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h5", F.zip_with(_head("_h4", 1), _tail("_h1", 4, F.greatest(F.size("_h4") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    # equal runs stand side by side once sorted; most texts have none
    pairs = F.sort_array(F.transform("_h5", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    df = df.withColumn("_pairs", F.when(F.size(F.array_distinct("_h5")) < F.size("_h5"), pairs).otherwise(none))
    same = lambda x, i: F.coalesce(F.get("_pairs", i)["x"] == x["x"], F.lit(False))
    found = F.transform("_pairs", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
    df = df.withColumn("_found", F.sort_array(F.filter(found, lambda i: i.isNotNull())))
    steps = F.zip_with("_found", _tail("_found", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    plain = F.col("_text")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    table = F.split(F.lit(",".join(map(str, bucket_weights))), ",").cast("array<bigint>")
    half = len(bucket_weights) // 2

    def weighed(hashes: str, at: int) -> Column:
        step = lambda total, x: total + F.get(table, x.bitwiseAND(F.lit(half - 1)).cast("int") + at)
        return F.aggregate(hashes, F.lit(0).cast("long"), step)

    df = df.withColumn("_lines", lines).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.char_length("_text") - F.char_length(plain)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long"),
            "_sum": weighed("_h1", 0) + weighed("_h2", half),
            "_grams": (F.size("_h1") + F.size("_h2") + SHRINK).cast("long"),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    good = ~F.col("base_failed") & (F.col("_sum") >= F.lit(round(SCALE * threshold)) * F.col("_grams"))
    # always true; it keeps a filter on the verdict above the steps, where it would work each of them out again
    df = df.withColumn("kept", good & (F.monotonically_increasing_id() >= 0))
    return df.select("own", *MADE[:6], (F.col("_sum") / F.col("_grams") / SCALE).alias("score"), "kept")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1").select("doc_id")


def learnt(spark, docs: DataFrame, sf_dir: str) -> list[int]:
    """Weights from ``docs`` themselves, with those that are labelled good as target."""
    from .common import read

    return weights(docs, trusted_ids(read(spark, sf_dir, "labels")))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The plain counts and the verdict of every document."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, learnt(spark, docs, sf_dir)).drop("text")


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The plain counts of every document, and whether they fail it; no model has a say."""
    from .common import read

    return judged(read(spark, sf_dir, "documents").select("doc_id", "text"), [0] * 2).select("doc_id", *MADE[:6])


_BASE = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs
), places AS (SELECT row, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM split),
windows AS (SELECT row, i, word || {" || ".join(f"' ' || lead(word, {k}) OVER w" for k in range(1, WINDOW))} AS gram FROM places WINDOW w AS (PARTITION BY row ORDER BY i)),
grams AS (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS times FROM windows WHERE gram IS NOT NULL),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM grams, range(0, {WINDOW}) t(k) WHERE times > 1 GROUP BY row),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (row)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""

QUERIES = {"op1_quality_rules": op1_quality_rules, "quality_base": quality_base}
ORACLE_SQL = {"quality_base": _BASE}
