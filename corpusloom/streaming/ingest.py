"""Corpora that grow: new shards are extracted, split and encoded as they arrive; chats are decoded as they come."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import bytepair as B
from corpusloom.operators import bpe_encode, corpus


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, merges=B.MERGES):
    """A query that encodes the rows of new Parquet files in ``source`` and appends them to ``target`` by split.

    No state is kept between rows, so no watermark is needed; the checkpoint says which files are done.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    index = bpe_encode.encoded(corpus.indexed(rows), merges, carried=["doc_bytes", "is_validation", "sample_key"])
    index = index.withColumn("ids", F.array_append("ids", F.lit(256 + len(merges))))
    out = index.select("doc_bytes", "is_validation", F.col("sample_key").cast("string").alias("sample_key"), corpus.checked_ids(F.col("ids")).alias("ids"))
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("is_validation").trigger(availableNow=True).start()


def decoded(chunks: DataFrame, flush: bool = False) -> DataFrame:
    """``key``, ``part`` and ``text`` of a stream of bytes by key: characters come out once they are whole.

    ``chunks`` has key (string), part (long, the order of the chunks of a key) and bytes. Bytes that can't be
    UTF-8 become the replacement character; an unfinished character waits in the key's state for the next
    chunk, or with ``flush`` is replaced at the end of each batch.
    """

    def run(key, frames: Iterator, state):
        import pandas as pd

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        if state.exists:
            decoder.setstate((bytes(state.get[0]), 0))
        rows = pd.concat(list(frames)).sort_values("part")
        texts = [decoder.decode(bytes(x)) for x in rows["bytes"]]
        if flush:
            texts[-1] += decoder.decode(b"", True)
        state.update((decoder.getstate()[0],))
        yield pd.DataFrame({"key": key[0], "part": rows["part"].to_numpy(), "text": texts})

    return chunks.groupBy("key").applyInPandasWithState(run, "key string, part long, text string", "held binary", "append", "NoTimeout")


def decode_chunks(df: DataFrame) -> DataFrame:
    """The same for a finished table: ``key`` and the whole ``text`` of its chunks in order."""
    joined = F.transform(F.sort_array(F.collect_list(F.struct("part", "bytes"))), lambda x: F.hex(x["bytes"]))
    return df.groupBy("key").agg(F.decode(F.unhex(F.array_join(joined, "")), "UTF-8").alias("text"))
