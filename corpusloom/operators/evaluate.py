"""A bigram model over training windows, its loss on fixed validation windows, and what a resumed run must share."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import epochs
from corpusloom.sources.files import InvalidFile, atomic


def target_counts(windows: DataFrame) -> DataFrame:
    """``left``, ``right`` and ``n``: how often a target follows an input in ``ids`` of windows.

    Tasks sum their own pairs first; what leaves them is bounded by the pairs that there are.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            ids, ends = np.asarray(column.flatten(), np.int64), np.cumsum([len(x) if x.is_valid else 0 for x in column])
            inside = np.ones(max(len(ids) - 1, 0), bool)
            inside[ends[(ends > 0) & (ends < len(ids))] - 1] = False
            found, n = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_counts=True)
            every, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, np.concatenate([sums, n]))
            keys, sums = every, total
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], ["left", "right", "n"])

    pairs = windows.select(F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "left int, right int, n long")
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))


def validation_windows(windows: DataFrame, chunks: int, seed: int, batch: int, batches: int) -> DataFrame:
    """The windows of ``batches`` fixed batches: the first ones of a sampler with its own ``seed``.

    They may go over the end of an epoch, when a window comes again.
    """
    rows, _ = epochs.batches(windows, chunks, seed, batch * batches, batch=batch, accumulation=1)
    return rows


def bigram_loss(trained: DataFrame, windows: DataFrame, vocabulary: int) -> DataFrame:
    """One row: ``windows``, ``tokens``, ``loss`` (the mean cross-entropy of the targets, in nats) and ``perplexity``.

    The model gives a target (n + 1) / (n of its input + ``vocabulary``), from ``trained``, the counts of
    ``target_counts``. Both sides meet as counts of pairs, so no token is a row.
    """
    totals = trained.groupBy("left").agg(F.sum("n").alias("_all"))
    asked = target_counts(windows).withColumnRenamed("n", "times")
    met = asked.join(trained, ["left", "right"], "left").join(totals, "left", "left")
    chance = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("_all", F.lit(0)) + F.lit(vocabulary))
    sums = met.agg(F.sum("times").alias("tokens"), F.sum(-F.log(chance) * F.col("times")).alias("_sum"))
    return windows.agg(F.count(F.lit(1)).alias("windows")).crossJoin(sums).select("windows", "tokens", (F.col("_sum") / F.col("tokens")).alias("loss"), F.exp(F.col("_sum") / F.col("tokens")).alias("perplexity"))


@dataclass(frozen=True)
class Plan:
    """How a run trains; a resumed one must have the same."""

    steps: int
    top_rate: float
    low_rate: float
    warmup: int
    weight_decay: float
    clip: float
    batch: int
    accumulation: int
    context: int


@dataclass(frozen=True)
class Run:
    """Where a run stands, and what it reads: fingerprints of its data and of its tokenizer, if it has any yet."""

    plan: Plan
    step: int = 0
    seed: int = 0
    sampler: epochs.State = field(default_factory=epochs.State)
    data: str | None = None
    tokenizer: str | None = None

    def resumed(self, plan: Plan, data: str, tokenizer: str) -> Run:
        """The run, ready to go on; an error if it was made in another way, from other data or with other ids."""
        if not data.strip() or not tokenizer.strip():
            raise ValueError("data and tokenizer need fingerprints")
        if self.data not in (None, data):
            raise InvalidFile("the data aren't those that the run began with")
        if self.tokenizer not in (None, tokenizer):
            raise InvalidFile("the tokenizer isn't the one that the run began with")
        if plan != self.plan:
            other = [k for k, v in asdict(plan).items() if v != getattr(self.plan, k)]
            raise InvalidFile(f"the run was planned with another {', '.join(other)}")
        if self.step > plan.steps:
            raise InvalidFile(f"the run is at step {self.step}, beyond {plan.steps}")
        return Run(plan, self.step, self.seed, self.sampler, data, tokenizer)

    def save(self, path: str) -> None:
        with atomic(path, keep=True) as part:
            Path(part).write_text(json.dumps(asdict(self), sort_keys=True))

    @staticmethod
    def load(path: str) -> Run:
        try:
            found = json.loads(Path(path).read_text())
            return Run(**(found | {"plan": Plan(**found["plan"]), "sampler": epochs.State(**found["sampler"])}))
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidFile("the run's file is malformed") from e
