"""Reading and writing corpora: shards, token files, tokenizer files, manifests and their safe publication."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_VERSION = 2


class InvalidFile(ValueError):
    """What was read isn't what its format says."""


def list_shards(entries: list[dict], take: int | None = None) -> list[dict]:
    """Entries of type ``file`` whose path ends in .parquet, by path, at most ``take``; an error if none."""
    found = sorted((x for x in entries if x.get("type") == "file" and x["path"].endswith(".parquet")), key=lambda x: x["path"])
    if not found:
        raise InvalidFile("the listing has no parquet shards")
    return found[:take]


def local_shards(folder: str, take: int | None = None) -> list[dict]:
    entries = [{"type": "file" if p.is_file() else "directory", "path": str(p), "size": p.stat().st_size} for p in Path(folder).rglob("*")]
    return list_shards(entries, take)


def reusable(shard: dict, local: str) -> bool:
    """Whether a local copy has the size that the listing says."""
    return os.path.isfile(local) and os.path.getsize(local) == shard["size"]


def copied(shard: dict, source: str, local: str) -> bool:
    """Bring a shard's file to ``local``, unless a copy of the listed size is there; whether anything was copied.

    The copy is written beside its target and takes its name once it has the size that the listing says.
    """
    from pyarrow import fs

    if reusable(shard, local):
        return False
    files, place = fs.FileSystem.from_uri(source) if ":/" in source else (fs.LocalFileSystem(), os.path.abspath(source))
    with atomic(local) as part:
        with files.open_input_stream(place) as f, open(part, "wb") as out:
            while block := f.read(8 << 20):
                out.write(block)
        if os.path.getsize(part) != shard["size"]:
            raise InvalidFile(f"{source} has {os.path.getsize(part)} bytes, not the {shard['size']} listed")
    return True


def scan_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``text`` and ``url`` of all shards, with the shard's path and the row's place; a missing url is null."""
    df = spark.read.parquet(*paths)
    if "text" not in df.columns:
        raise InvalidFile("the shards have no column text")
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    return df.select("text", url.alias("url"), F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row"))


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """One text file as one row."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_tokens(df: DataFrame, path: str) -> int:
    """Write ``ids`` of rows with doc_id, in that order, as little-endian 16-bit integers; returns the tokens.

    Tasks write ranges, and put them into their places in the one local file, which takes its name once it is whole.
    A corpus that stays on the cluster is better kept as streams.
    """
    from corpusloom.sources import positional, shared

    held = shared.scratch(df.sparkSession)
    try:
        found = positional.write_streams(positional.in_order(df.select("doc_id", "ids"), "doc_id").select("ids"), held)
    except Exception as e:
        if "a token id is out of range" in str(e):
            raise InvalidFile("a token id is out of range") from e
        raise
    positional.join_stream(df.sparkSession, positional.parts_of(held, "ids"), path)
    return found["bytes"]["ids"] // 2


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``ids`` of token files."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                if len(content) % 2 or len(content) < 4:
                    raise InvalidFile("a token file needs an even number of bytes and two tokens")
                rows.append(np.frombuffer(content, "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["path", "ids"])

    files = spark.read.format("binaryFile").load(path)
    if files.where(F.col("length") >= 2**31 - 1).isEmpty():
        return files.select("path", "content").mapInArrow(run, "path string, ids array<int>")
    raise InvalidFile("token files of 2 GB or more are read by token_documents of sources.positional")


def documents_of(tokens: DataFrame, eos: int) -> DataFrame:
    """``path``, ``doc_id`` and ``ids`` (with the end) of token files; an error if one ends inside a document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.asarray(ids.values)
                ends = np.flatnonzero(own == eos) + 1
                if not len(ends) or ends[-1] != len(own):
                    raise InvalidFile("a token file ends inside a document")
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int64()), pa.ListArray.from_arrays(offsets, own.astype(np.int32))], ["path", "doc_id", "ids"])

    return tokens.select("path", "ids").mapInArrow(run, "path string, doc_id long, ids array<int>")


class atomic:
    """A path to write to; on success it takes the place of ``path``, whose last content becomes ``.bak``."""

    def __init__(self, path: str, keep: bool = False):
        self.path, self.keep = path, keep

    def __enter__(self) -> str:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        handle, self.part = tempfile.mkstemp(prefix=f".{os.path.basename(self.path)}-", dir=os.path.dirname(os.path.abspath(self.path)))
        os.close(handle)
        return self.part

    def __exit__(self, kind, *_):
        if kind:
            os.unlink(self.part)
        else:
            if self.keep and os.path.exists(self.path):
                os.replace(self.path, f"{self.path}.bak")
            os.replace(self.part, self.path)


def save_tokenizer(merges: list[tuple[int, int]], path: str) -> None:
    content = {"Version": TOKENIZER_VERSION, "Merges": [[a, b, 256 + k] for k, (a, b) in enumerate(merges)], "EosTokenId": 256 + len(merges)}
    with atomic(path) as part:
        Path(part).write_text(json.dumps(content))


def load_tokenizer(path: str) -> list[tuple[int, int]]:
    """The merges of a tokenizer file, checked as a whole."""
    try:
        content = json.loads(Path(path).read_text())
        version, merges, eos = content["Version"], content.get("Merges") or [], content["EosTokenId"]
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidFile("the tokenizer file is malformed") from e
    if version != TOKENIZER_VERSION:
        raise InvalidFile(f"tokenizer version {version} isn't supported")
    for k, merge in enumerate(merges):
        if len(merge) != 3:
            raise InvalidFile(f"merge {k} must have three entries")
        if not all(0 <= x < 256 + k for x in merge[:2]):
            raise InvalidFile(f"merge {k} names an unknown id")
        if merge[2] != 256 + k:
            raise InvalidFile(f"merge {k} has id {merge[2]}")
    if eos != 256 + len(merges):
        raise InvalidFile(f"the end token has id {eos}")
    return [(a, b) for a, b, _ in merges]


def file_digest(path: str) -> str:
    """SHA-256 of a file's content, as upper-case hex."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest().upper()


def combined_identity(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest().upper()


def manifest_id(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest().upper()


def write_manifest(manifest: dict, path: str) -> None:
    with atomic(path, keep=True) as part:
        Path(part).write_text(json.dumps(manifest, sort_keys=True, indent=1))


def read_manifest(path: str) -> dict | None:
    """The manifest, or None if there is none; a malformed one is an error, as it vouches for files."""
    if not os.path.exists(path):
        return None
    try:
        found = json.loads(Path(path).read_text())
    except ValueError as e:
        raise InvalidFile("the manifest is malformed") from e
    if not isinstance(found, dict):
        raise InvalidFile("the manifest is malformed")
    return found


def fresh(manifest_path: str, wanted: dict, files: dict[str, str]) -> bool:
    """Whether the manifest says ``wanted`` and each of ``files`` (name to path) still has the content it had."""
    found = read_manifest(manifest_path)
    if found is None or any(found.get(k) != v for k, v in wanted.items()):
        return False
    digests = found.get("files", {})
    return all(os.path.isfile(path) and digests.get(name) == file_digest(path) for name, path in files.items())


def mixture_spec(text: str) -> dict:
    """A mixture's JSON, with names in any case: version, trainTokens, validationTokens and sources."""
    try:
        raw = {k.lower(): v for k, v in json.loads(text).items()}
        sources = [{k.lower(): v for k, v in x.items()} for x in raw["sources"]]
        spec = {"version": raw.get("version", 1), "trainTokens": int(raw["traintokens"]), "validationTokens": int(raw["validationtokens"]), "sources": [{"name": x["name"], "path": x["path"], "weight": float(x["weight"])} for x in sources]}
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise InvalidFile("the mixture is malformed") from e
    names, paths = ([x[k].lower() for x in spec["sources"]] for k in ("name", "path"))
    if not names or len(set(names)) < len(names) or len(set(paths)) < len(paths):
        raise InvalidFile("a mixture needs sources of different names and paths")
    if any(not (0 < x["weight"] < float("inf")) or not x["name"].strip() for x in spec["sources"]) or spec["trainTokens"] < 1 or spec["validationTokens"] < 1:
        raise InvalidFile("weights and token counts must be positive, and names not blank")
    return spec
