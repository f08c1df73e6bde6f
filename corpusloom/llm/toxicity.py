"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-cased characters, present or absent. Training counts
in how many texts of either class each occurs; the logarithm of the ratio of the smoothed rates scales the
feature, and a logistic regression with a ridge penalty learns the weights of the most telling ones. The fit
uses a bounded sample of labelled rows and runs as one task; all texts are then scored where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_in_worker, small_batches

SIZES = (3, 4, 5, 6)
#: Bits of a feature's hash.
BITS = 21
#: Labelled rows of either class that the fit uses, at most; those with the least hashes of their ids.
SAMPLE = 3000
#: The model's size, chosen like its penalty: features with a weight, the most telling ones; the texts of the
#: sample that one must occur in. All n-grams of a text are looked at, whatever the model has of them.
FEATURES, LEAST_TEXTS = 2000, 8
RIDGE, STEPS = 20.0, 400


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and text of each place of all texts: what ``hashed`` reads."""
    rows = [f" {text.lower()} " for text in texts]
    chars = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.array([len(row) for row in rows], np.int64)


def hashed(chars: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the hash of the n-gram from each place on, and whether the n-gram ends in its text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    h, power = np.zeros(len(chars), np.uint32), 1
    for n in range(1, max(SIZES) + 1):
        if n > len(chars):
            return
        power = power * 0x01000193 & 0xFFFFFFFF
        h[: len(chars) - n + 1] += chars[n - 1 :] * np.uint32(power)
        if n in SIZES:
            whole = np.arange(n, len(chars) + 1) <= ends[: len(chars) - n + 1]
            mixed = h[: len(chars) - n + 1] * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77) + np.uint32(2 * n)
            yield mixed >> np.uint32(32 - BITS), whole


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of the text, feature), each once, by text; only features that are ``wanted``, if given."""
    chars, lengths = grams(texts)
    place = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    found = []
    for h, whole in hashed(chars, lengths):
        at = np.flatnonzero(whole if wanted is None else wanted[h] & whole)
        found.append((place[at] << BITS) | h[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The bias, and features with their weights. Of one class alone, only the bias says anything."""
    positive, negative = int(toxic.sum()), int((~toxic).sum())
    none = np.zeros(0, np.int64), np.zeros(0)
    if not positive or not negative:
        return (4.0 if positive else -4.0), *none
    size = 1 << BITS
    p, q = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for at in range(0, len(texts), 64):
        row, column = features(texts[at : at + 64])
        bad = toxic[row + at]
        p += np.bincount(column[bad], minlength=size)
        q += np.bincount(column[~bad], minlength=size)
    ratio = np.log((p + 1) / (positive + 2)) - np.log((q + 1) / (negative + 2))
    # what a feature says over the whole sample: its ratio times the difference of its rates
    telling = np.where(p + q >= LEAST_TEXTS, np.abs(ratio * (p / positive - q / negative)), 0)
    chosen = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    chosen = chosen[telling[chosen] > 0]
    if not len(chosen):
        return 0.0, *none
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    rows, columns = [], []
    for at in range(0, len(texts), 64):
        row, column = features(texts[at : at + 64], place >= 0)
        rows.append(row + at)
        columns.append(place[column])
    row, column = np.concatenate(rows), np.concatenate(columns)
    scale = ratio[chosen]
    x = scale[column]
    y, n = toxic.astype(float), len(toxic)
    balance = np.where(toxic, 0.5 / positive, 0.5 / negative) * n
    w, bias, step = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen))
    # gradient descent, each feature's step by the bound of its own curvature and of those it occurs with
    reach = np.bincount(row, np.abs(x), n)
    step = 1.0 / (0.25 * np.bincount(column, np.abs(x) * (reach[row] + 1) * balance[row], len(chosen)) + RIDGE)
    bias_step = 1.0 / (0.25 * float((balance * (reach + 1)).sum()))
    for _ in range(STEPS):
        z = bias + np.bincount(row, x * w[column], n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        w -= step * (np.bincount(column, x * error[row], len(chosen)) + RIDGE * w)
        bias -= bias_step * error.sum()
    return float(bias), chosen, w * scale


def _table(model: tuple[float, tuple[int, ...], tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray]:
    return kept_in_worker(("toxicity", model), lambda: _dense(model))


def _dense(model: tuple[float, tuple[int, ...], tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray]:
    wanted, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
    wanted[list(model[1])] = True
    weight[list(model[1])] = model[2]
    return wanted, weight


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple:
    """A model from rows with a label 0 or 1; others have no say. It is a small tuple that tasks carry."""
    rows = labelled.where(F.col(label_col).isin(0, 1))
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(8))
    parts = [rows.where(F.col(label_col) == kind).select(key.alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.lit(kind).alias("_toxic")).orderBy("_key", "_text").limit(sample) for kind in (0, 1)]

    def run(table):
        import pyarrow as pa

        bias, chosen, weight = fit(table["_text"].to_pylist(), np.asarray(table["_toxic"]) == 1)
        return pa.table({"feature": np.append(chosen, -1), "weight": np.append(weight, bias)})

    found = parts[0].union(parts[1]).withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(run, "feature long, weight double").collect()
    bias = next((row.weight for row in found if row.feature < 0), -4.0)
    found = sorted((row.feature, row.weight) for row in found if row.feature >= 0)
    return bias, tuple(f for f, _ in found), tuple(w for _, w in found)


def scored(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row; a null text counts as empty, other columns as absent.

    Whole texts are scored, however long. Ids may repeat or be null, equal texts have equal scores. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted, weight = _table(model)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            row, feature = features(texts, wanted)
            z = model[0] + np.bincount(row, weight[feature], len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document, by a model of the labels that aren't held out."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where("toxic IN (0, 1)").where(~_held_out("doc_id"))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(8))
    # the rows that train() would take, found before the texts are looked up: 2 * SAMPLE ids at most
    picked = [labels.where(F.col("toxic") == kind).orderBy(key, "doc_id").limit(SAMPLE) for kind in (0, 1)]
    model = train(docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id"))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
