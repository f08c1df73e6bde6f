"""Source divergence audit: how far apart the sources of a language are in their use of terms, and by which terms.

Tasks count terms by language and source over whole texts, in counters of bounded size that they pass on when full.
One shuffle then brings the counts of a term together as a *wide vector*: an array with a place for each source of
the language, in the order of their names. Higher-order functions turn the vector into smoothed shares and emit, for
each pair of places, what the term adds to the distance of the two sources; the sums are formed in the tasks first.
All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_runs, discard, materialize, read, salted, small_batches

#: Terms that fewer documents of the language have are left out.
LEAST_DOCUMENTS = 30
#: Terms that are reported for a group.
TOP = 50
#: Shares are whole parts of this; each count is raised by SMOOTHING.
SCALE, SMOOTHING = 1_000_000_000, 5
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: A-Z become a-z; bytes that are neither ASCII letters nor part of a character beyond ASCII become blanks.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``docs``: partial counts by term, to be summed.

    ``docs`` has lang, source and text, without nulls. A term is a longest run of ASCII letters and characters
    beyond ASCII; only A-Z are lower-cased.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed():
            for (lang, source), (times, within) in found.items():
                n = len(times)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(times), pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64()), pa.array(list(map(within.__getitem__, times)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.large_binary())
            for group, text in zip(zip(langs, sources), texts):
                times, within = found.setdefault(group, (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in byte_runs(text.as_py(), _TABLE):
                    times.update(terms)
                    own.update(terms)
                within.update(own)
            if sum(len(x) for x, _ in found.values()) > HELD:
                yield from flushed()
        yield from flushed()

    small_batches(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + SCALE * (n + SMOOTHING) div (total + SMOOTHING * terms), beyond 64 bits within."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, (total + SMOOTHING * terms).cast("decimal(20,0)"))


def wide_vectors(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``term`` and ``by_source`` (structs of source and n) of terms in at least ``least`` documents.

    ``counts`` are those of ``term_counts``; they travel once.
    """
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # one entry for each source of the language
    terms = by_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("by_source"), F.sum("docs").alias("docs"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "by_source")


def _languages(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each ``lang``: ``slots`` (source and total, by name), ``terms`` and ``total``."""
    totals = vectors.select("lang", F.explode("by_source").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    terms = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    slots = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    slots = slots.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("slots"), F.sum("total").alias("total"))
    return slots.join(terms, "lang", "left").select("lang", "slots", "total", F.coalesce("terms", F.lit(0)).alias("terms"))


def _dense(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``q`` (the language's share) and ``cells`` (source, n and share p, for each slot)."""
    rows = salted(vectors, languages, "lang", ["term"]).withColumn("_n", F.map_from_entries("by_source"))
    whole = F.aggregate("by_source", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    n = lambda s: F.coalesce(F.try_element_at("_n", s["source"]), F.lit(0).cast("long"))
    cells = F.transform("slots", lambda s: F.struct(s["source"].alias("source"), n(s).alias("n"), _share(n(s), s["total"], F.col("terms")).alias("p")))
    return rows.select("lang", "term", _share(whole, F.col("total"), F.col("terms")).alias("q"), cells.alias("cells"))


def source_distances(dense: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source) and ``value``, the sum of abs(p - q) over all terms."""
    rows = dense.select("lang", F.transform("cells", lambda x: x["p"]).alias("p"))
    # a vector of s places emits s arrays, each of them its differences from later places
    rows = rows.select("lang", "p", F.posexplode("p").alias("i", "own"))
    rows = rows.select("lang", "i", F.posexplode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.col("own")))).alias("j", "value"))
    rows = rows.select("lang", "i", (F.col("i") + F.col("j") + 1).alias("j"), "value")
    # all pairs that there are, also of languages without terms
    slots = languages.select("lang", F.size("slots").alias("n"), F.posexplode("slots").alias("i", "_slot")).where("i + 1 < n")
    every = slots.select("lang", "i", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j"), F.lit(0).cast("long").alias("value"))
    sums = rows.unionByName(every).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    named = salted(sums, languages.select("lang", "slots"), "lang", ["i", "j"])
    name = lambda at: F.get("slots", F.col(at))["source"]
    both = F.array(F.struct(name("i").alias("source"), name("j").alias("item")), F.struct(name("j").alias("source"), name("i").alias("item")))
    return named.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def telling_terms(dense: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (a term of the source, used more than in the language) and ``value`` = p - q."""
    rows = dense.select("lang", "term", "q", F.explode(F.filter("cells", lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))).alias("x"))
    return rows.select("lang", "x.source", F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for each source of each language.

    Part ``pair`` has every other source of the language and the distance to it, 0 if the language has no kept
    terms; part ``term`` the ``top`` terms that the source uses more than its language. Ranks begin at 1, highest
    value first, then by item. Nulls in the three columns read as ''; repeated rows count each; an empty or very
    long text is like any other; a table without rows gives none. Other columns, whatever their names, are ignored.
    """
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*plain)
    vectors = materialize(wide_vectors(term_counts(docs), least))
    languages = materialize(_languages(docs.select("lang", "source").distinct(), vectors))
    dense = materialize(_dense(vectors, languages))
    discard(vectors)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_distances(dense, languages).withColumn("rank", F.row_number().over(best))
    terms = telling_terms(dense).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    both = [rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, rows in (("pair", pairs), ("term", terms))]
    return both[0].unionByName(both[1])


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All sources of all documents: their distances, and the terms that set each apart from its language."""
    return audited(read(spark, sf_dir, "documents"))


_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS whole FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
cells AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (s.total + {SMOOTHING} * l.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.whole + {SMOOTHING})) // (l.total + {SMOOTHING} * l.v) AS q
  FROM sized s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE_SQL = {"op11_source_divergence": _SQL}
