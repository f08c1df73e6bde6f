"""The stages keep the columns, work on what came before, and leave clean documents alone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_stages(spark, data):
    import corpus_pipeline as P

    from corpusloom.llm.common import materialize, read

    docs = read(spark, data, "documents")
    r = random.Random(1)
    clean = " ".join("".join(r.choice("abcdefghi") for _ in range(r.randrange(2, 8))) for _ in range(150)) + "."
    rows = [(10**6, clean + " password=abcdefgh99"), (10**6 + 1, clean + " password=abcdefgh99"), (10**6 + 2, "#### " * 50), (10**6 + 3, None), (None, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = materialize(docs.unionByName(more.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.char_length("text").cast("long").alias("n_chars"))))
    seen = []
    for name, stage in P.STAGES:
        new = materialize(stage(spark, docs, data))
        seen.append({x[0] for x in new.select("doc_id").collect()})
        if name != "packing":
            assert new.columns == docs.columns and new.count() <= docs.count()
        docs = new
        if name == "secret scans":
            texts = {x.doc_id: x for x in new.collect()}
            assert texts[10**6].text == clean + " [SECRET]" and texts[10**6].n_chars == len(clean) + 9
    assert 10**6 + 2 not in seen[0] and 10**6 + 3 not in seen[0] and None not in seen[0]
    assert 10**6 in seen[1] and 10**6 + 1 not in seen[1]
    assert seen[1] == seen[2] == seen[3] == seen[4]
    assert len(seen[0]) > 0.6 * read(spark, data, "documents").count()


def test_run(spark, data):
    import corpus_pipeline as P

    out = P.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_odd_tables(spark, data):
    """Empty tables, repeated rows, very long texts, nulls and columns with the names that stages use."""
    import corpus_pipeline as P

    from corpusloom.llm.common import materialize

    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n)) + "."
    one = text(120)
    rows = [(1, one), (1, one), (2, text(150_000)), (None, text(90)), (3, None), (4, ""), (None, None)]
    clash = ["own", "words", "base", "spans", "file", "row", "key", "bands", "digest", "kept", "score", "n_words", "piece"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *[c.upper() for c in clash]) for i, t in rows], schema)
    empty = docs.limit(0)
    kept = []
    for name, stage in P.STAGES:
        none = stage(spark, empty, data)
        assert none.count() == 0, name
        new = materialize(stage(spark, docs, data))
        if name != "packing":
            assert new.columns == docs.columns == none.columns, name
            assert all(x[c] == c.upper() for x in new.collect() for c in clash)
            docs = new
        kept.append(sorted((x.doc_id or 0) for x in new.select("doc_id").distinct().collect()))
    assert kept == [[0, 1, 2]] * 5
    assert docs.count() == 3 and max(len(x.text) for x in docs.collect()) > 500_000
