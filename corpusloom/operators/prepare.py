"""A corpus made ready for training: extracted, split, without what earlier corpora had, tokenizer learnt, encoded, written."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import bpe_encode, bpe_train, corpus
from corpusloom.operators.fingerprint import fingerprint
from corpusloom.sources import files, keystore, positional
from corpusloom.sources.shared import discard, stored


def prepare(rows: DataFrame, out: str, order: Sequence[str], merges: int = 16_000, sample_bytes: int = 200 << 20, tokenizer: Sequence[tuple[int, int]] | None = None, store: str | None = None, batch: int | None = None, entries: int = positional.ENTRIES) -> dict:
    """Make the files of a corpus in the folder ``out`` and return its manifest.

    ``rows`` has text, perhaps url, and the columns of ``order``, along which documents are written. Streams ``corpus``
    and ``index`` keep the documents, streams ``train`` and ``validation`` their 16-bit ids, each document with its end;
    ``tokenizer.json`` has the merges, learnt from a sample of about ``sample_bytes`` unless they are given. Documents whose
    keys are in ``store`` are left out; with ``batch``, those that stay are added to it. ``out`` is a mounted path.

    The manifest is written last. If it says that ``out`` was made from the same rows in the same way, and the files
    still have the sizes it names, nothing is done again.
    """
    path = f"{out}/manifest.json"
    given = [list(x) for x in tokenizer] if tokenizer is not None else None
    columns = ["text", "url"] if "url" in rows.columns else ["text"]
    wanted = {"source": fingerprint(rows, columns), "order": list(order), "merges": merges if given is None else given, "sampleBytes": sample_bytes if given is None else None, "excluded": store, "batch": batch}
    found = files.read_manifest(path)
    if found and all(found.get(k) == v for k, v in wanted.items()) and _whole(out, found):
        _recorded(rows.sparkSession, out, store, batch)
        return found
    if store and batch is not None and keystore.has_batch(rows.sparkSession, store, batch):
        # its own keys would leave out all documents
        raise files.InvalidFile(f"the store already has batch {batch}, made from something else")
    os.makedirs(out, exist_ok=True)
    index = corpus.indexed(rows)
    if store and os.path.isdir(f"{store}/keys"):
        index = keystore.excluded(index, store)
    index = stored(index.select(*order, "text", "doc_bytes", "is_validation", "sample_key"))
    written = positional.write_corpus(index, f"{out}/corpus", *order)
    learnt = given
    if learnt is None:
        learnt = [[a, b] for a, b, _ in bpe_train.train_by_passes(corpus.tokenizer_sample(index, sample_bytes), merges, framed=True)]
    files.save_tokenizer([tuple(x) for x in learnt], f"{out}/tokenizer.json")
    # the documents come in order, and encoding leaves them there
    docs = positional.read_indexed(rows.sparkSession, positional.parts_of(f"{out}/corpus", "index"), positional.parts_of(f"{out}/corpus", "corpus"), entries)
    docs = bpe_encode.encoded(docs, learnt, "content", framed=False, carried=["is_validation"])
    ids = F.array_append("ids", F.lit(256 + len(learnt)))
    tokens = positional.write_streams(docs.select(F.when(~F.col("is_validation"), ids).alias("train"), F.when(F.col("is_validation"), ids).alias("validation")), f"{out}/tokens")
    discard(index)
    made = wanted | {"documents": written["rows"], "bytes": written["bytes"] | tokens["bytes"], "tokens": {k: n // 2 for k, n in tokens["bytes"].items()}, "tokenizer": files.file_digest(f"{out}/tokenizer.json")}
    files.write_manifest(made, path)
    _recorded(rows.sparkSession, out, store, batch)
    return made


def _recorded(spark, out: str, store: str | None, batch: int | None) -> None:
    """Add the keys of a finished corpus to the store, unless they are there."""
    if store and batch is not None and not keystore.has_batch(spark, store, batch):
        index = positional.read_indexed(spark, positional.parts_of(f"{out}/corpus", "index"), positional.parts_of(f"{out}/corpus", "corpus"))
        keystore.append(index.select("sample_key"), store, batch)


def _whole(out: str, manifest: dict) -> bool:
    """Whether the files are there in the sizes, and the tokenizer with the content, that a manifest names."""
    tokenizer = f"{out}/tokenizer.json"
    if not os.path.isfile(tokenizer) or files.file_digest(tokenizer) != manifest.get("tokenizer"):
        return False
    for stream, size in manifest.get("bytes", {}).items():
        folder = "corpus" if stream in ("corpus", "index") else "tokens"
        try:
            parts = positional.parts_of(f"{out}/{folder}", stream)
        except (OSError, files.InvalidFile):
            return False
        place = lambda x: f"{out}/{folder}/{x.file.rsplit('/', 2)[-2]}/{x.file.rsplit('/', 1)[-1]}"
        if positional.total(parts) != size or any(not os.path.isfile(place(x)) or os.path.getsize(place(x)) != x.size for x in parts):
            return False
    return True


def shared_tokenizer(folders: Sequence[str]) -> str:
    """The digest of the tokenizer that all prepared corpora share; an error if they differ, as ids then mean other things."""
    digests = {files.file_digest(f"{x}/tokenizer.json") for x in folders}
    if len(digests) != 1:
        raise files.InvalidFile("the sources don't share one tokenizer")
    return digests.pop()
