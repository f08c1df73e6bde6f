"""Secret scans: known forms of secrets, and strings whose characters are too evenly mixed for words.

Candidate strings go through a sliding window. The window keeps a count of each character and the sum of
c * log2(c) over the counts; a step changes two counts and adds the difference of their terms, so that the
Shannon entropy of every window costs a few operations, however long the string is. What counts as high depends on the class of
characters the string is made of. An allow-list names harmless strings. Only DataFrame functions are used,
and all of a document's work stays in its row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The known kinds in the order that breaks ties, the pattern, the group measured, its least length.
KNOWN = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A longest run of these characters, 20 or more with a digit and a letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Terms are whole millionths.
SCALE = 1_000_000


@dataclass(frozen=True)
class CharacterClass:
    """Strings that ``pattern`` fits as a whole are secrets from ``bits`` of entropy in some window."""

    name: str
    pattern: str
    bits: float


#: The first class that fits a string is its class.
CLASSES = (
    CharacterClass("hex", r"^[0-9a-fA-F]+$", 3.0),
    CharacterClass("upper", r"^[A-Z0-9]+$", 3.6),
    CharacterClass("lower", r"^[a-z0-9]+$", 3.6),
    CharacterClass("alphanumeric", r"^[A-Za-z0-9]+$", 3.7),
    CharacterClass("base64", r"^.*$", 3.9),
)
#: Harmless strings: samples and fillers, version and date names, and UUIDs, which are no keys. A group that
#: repeats is possessive, so that it takes a loop, not a call for each turn.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}|0{8,}|12345678|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?:[a-z]++[-_/])++[0-9]{1,8}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_BLOCK = 512


def _running(lengths: Column) -> Column:
    """Sums of the values before each value, by blocks, so that many values stay cheap."""
    grow = lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + x))
    zero = F.array(F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(_BLOCK)))
    before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), zero, grow)
    within = lambda b, s: F.slice(F.aggregate(b, F.array(s), grow), F.lit(1), F.size(b))
    return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), within))


def _spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> dict[str, tuple]:
    """Steps that find the matches of ``pattern`` with their places, as structs start, kind, end, found."""
    has, p = f"_has{kind}", F.lit(pattern)
    some = lambda x, of: F.when(F.col(has), x).otherwise(F.array().cast(of))
    return {
        "has": (has, F.col(text).rlike(pattern)),
        "match": (f"_match{kind}", some(F.regexp_extract_all(text, p, F.lit(0)), "array<string>")),
        "group": (f"_group{kind}", some(F.regexp_extract_all(text, p, F.lit(group)), "array<string>")),
        "gap": (f"_gap{kind}", some(F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)), "array<int>")),
    }


def _placed(kind: int, least: int) -> Column:
    match, group, gap = F.col(f"_match{kind}"), F.col(f"_group{kind}"), F.col(f"_gap{kind}")
    steps = F.zip_with(F.slice(gap, F.lit(1), F.size(match)), match, lambda g, m: g + F.char_length(m))
    first = F.zip_with(_running(steps), F.slice(gap, F.lit(1), F.size(match)), lambda b, g: b + g)
    made = F.zip_with(first, F.arrays_zip(match.alias("m"), group.alias("g")), lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(x["m"])).alias("end"), x["m"].alias("found"), F.char_length(x["g"]).alias("n")))
    kept = F.transform(F.filter(made, lambda x: x["n"] >= least), lambda x: F.struct(x["start"], x["kind"], x["end"], x["found"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(F.size(match) > 0, kept).otherwise(none)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once and not wherever it occurs."""
    return F.get(F.transform(F.array(value), use), 0)


def peak_terms(found: Column, window: int = WINDOW) -> Column:
    """The least sum of c * log2(c) over the windows of a string of ASCII characters, in millionths.

    The entropy of that window, log2(window) - sum / window, is the greatest. A shorter string is one window.
    The counts are a string of 128 characters, one for each code, of which a step replaces two.
    """
    term = F.array(*(F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 1)))
    none = 48  # the character that stands for a count of 0
    codes = F.transform(F.split(found, ""), lambda c: F.ascii(c))
    count = lambda n, c: F.ascii(F.substr(n, c + 1, F.lit(1))) - none
    put = lambda n, c, value: F.overlay(n, F.char(value + none), c + 1, 1)
    start = F.struct(F.lit(chr(none) * 128).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("best"))

    def least(codes: Column) -> Column:
        size = F.size(codes)

        def left(s, i):
            """The counts and the sum once the character that falls out has gone."""
            old = F.get(codes, i - window)
            gone = _bound(count(s["n"], old), lambda c: F.struct(put(s["n"], old, c - 1).alias("n"), (s["sum"] + F.get(term, c - 1) - F.get(term, c)).alias("sum")))
            return F.when(i >= window, gone).otherwise(F.struct(s["n"].alias("n"), s["sum"].alias("sum")))

        def joined(x, s, i):
            new = F.get(codes, i)
            full = (i >= window - 1) | (i == size - 1)

            def added(c):
                total = x["sum"] + F.get(term, c + 1) - F.get(term, c)
                return F.struct(put(x["n"], new, c + 1).alias("n"), total.alias("sum"), F.when(full, F.least(s["best"], total)).otherwise(s["best"]).alias("best"))

            return _bound(count(x["n"], new), added)

        return F.aggregate(F.sequence(F.lit(0), size - 1), start, lambda s, i: _bound(left(s, i), lambda x: joined(x, s, i)), lambda s: s["best"])

    return _bound(codes, least)


def high_entropy(found: Column, classes: tuple[CharacterClass, ...] = CLASSES, window: int = WINDOW) -> Column:
    """Whether some window of a string mixes its characters as its class of characters seldom does."""


    def judged(plain: Column) -> Column:
        bits = F.lit(None).cast("double")
        for kind in reversed(classes):
            bits = F.when(plain.rlike(kind.pattern), F.lit(kind.bits)).otherwise(bits)
        most = F.floor((F.lit(math.log2(window)) - bits) * window * SCALE)
        return peak_terms(plain, window) <= most

    return _bound(F.regexp_replace(found, "=+$", ""), judged)


def _inside(x: Column, spans: Column) -> Column:
    """Whether one of ``spans``, which don't overlap and are in order, holds the span ``x``."""
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    # how many start no later, by halving
    step = lambda at, p: F.when(F.coalesce(F.get(spans, at + p - 1)["start"] <= x["start"], F.lit(False)), at + p).otherwise(at)
    return F.coalesce(F.get(spans, F.aggregate(powers, F.lit(0), step) - 1)["end"] >= x["end"], F.lit(False))


def _scanned(docs: DataFrame, text_col: str, allowed: str) -> DataFrame:
    """``own`` (a struct of the row as it came), base and spans."""
    df = docs.select(F.struct(*docs.columns).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_scan"))
    # only runs of the measured length can count for kinds whose measured group is the whole match
    forms = [(p if group else p[:-1] + f"{{{least - (4 if p.startswith('AKIA') else 0)},}}", group, least) for _, p, group, least in KNOWN]
    forms.append((CANDIDATE, 0, 0))
    steps = [_spans("_scan", pattern, kind, group, least) for kind, (pattern, group, least) in enumerate(forms)]
    df = df.withColumns(dict(x["has"] for x in steps))
    df = df.withColumns(dict(x[k] for x in steps for k in ("match", "group", "gap")))
    df = df.withColumns({f"_placed{kind}": _placed(kind, least) for kind, (_, _, least) in enumerate(forms)})
    df = df.withColumn("base", F.sort_array(F.concat("_placed0", "_placed1", "_placed2")))
    places = F.struct(*(F.col(f"_placed{kind}").alias(f"k{kind}") for kind in range(len(KNOWN))))
    new = lambda known: F.filter("_placed3", lambda x: ~x["found"].rlike(allowed) & ~reduce(or_, (_inside(x, known[f"k{kind}"]) for kind in range(len(KNOWN)))))
    df = df.withColumn("_new", F.when(F.size("_placed3") > 0, F.filter(_bound(places, new), lambda x: high_entropy(x["found"]))).otherwise(F.col("_placed3")))
    return df.select("own", "base", F.when(F.size("_new") > 0, F.sort_array(F.concat("base", "_new"))).otherwise(F.col("base")).alias("spans"))


def scanned(docs: DataFrame, text_col: str = "text", allowed: str = ALLOWED) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end, found), by start, then kind.

    Places count code points, ends are exclusive. ``kind`` is the place in KNOWN, or 3 for high entropy.
    Known forms always stay; a string that is found by its entropy only must not fit ``allowed`` nor lie
    inside a known form. A null or empty text has no spans, an empty table no rows. Whole texts are searched,
    however long; the work grows in proportion. Rows are judged alone, so ids and whole rows may repeat or be
    null. Input columns named base or spans are replaced; all others stay.
    """
    found = _scanned(docs, text_col, allowed)
    return found.select(*(F.col("own")[c].alias(c) for c in docs.columns if c not in ("base", "spans")), "base", "spans")


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(name) for name in (*(k for k, *_ in KNOWN), "entropy")))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(docs: DataFrame, text_col: str = "text", marker: str = "[SECRET]", allowed: str = ALLOWED) -> DataFrame:
    """``docs`` with each found stretch of the text replaced by ``marker``; overlapping spans are one stretch.

    Texts without spans, nulls among them, stay as they are, and so do all other columns, whatever their names.
    """
    found = _scanned(docs, text_col, allowed)
    text = F.col("own")[text_col].cast("string")
    # the end of what came before, for each span; blocks keep the work in proportion to the spans
    last = lambda spans: F.aggregate(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]))

    def parts(before: Column, spans: Column) -> Column:
        """The text from ``before`` to the end of ``spans``, cut out first, since places are counted from its start."""
        start = F.struct(before.alias("at"), F.lit("").alias("out"))

        def joined(own: Column) -> Column:
            def step(s, x):
                apart = (x["start"] >= s["at"]) | (x["start"] == 0)
                out = F.when(apart, F.concat(s["out"], F.substr(own, s["at"] - before + 1, x["start"] - s["at"]), F.lit(marker))).otherwise(s["out"])
                return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

            return F.aggregate(spans, start, step, lambda s: s["out"])

        return _bound(F.substr(text, before + 1, F.greatest(last(spans) - before, F.lit(0))), joined)

    starts = F.sequence(F.lit(1), F.greatest(F.size("spans"), F.lit(1)), F.lit(_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice("spans", i, F.lit(_BLOCK)))
    grow = lambda at, b: F.concat(at, F.array(F.greatest(F.element_at(at, -1), last(b))))
    ends = lambda own: F.aggregate(own, F.array(F.lit(0)), grow)
    whole = _bound(blocks, lambda own: _bound(ends(own), lambda at: F.concat(F.array_join(F.zip_with(own, F.slice(at, F.lit(1), F.size(own)), lambda b, e: parts(e, b)), ""), F.substr(text, F.element_at(at, -1) + 1, F.char_length(text)))))
    new = F.when(F.size("spans") > 0, whole).otherwise(text).alias(text_col)
    return found.select(*(new if c == text_col else F.col("own")[c].alias(c) for c in docs.columns))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The spans of every document, counted and written out."""
    from .common import read

    found = scanned(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


def secret_base(spark, sf_dir: str) -> DataFrame:
    """The known forms in every document, counted, and a digest of their places."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def _base_sql() -> str:
    steps, rows = [], []
    for kind, (name, pattern, group, least) in enumerate(KNOWN):
        p = pattern.replace("'", "''")
        steps.append(f"k{kind} AS (SELECT row, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS g, regexp_split_to_array(text, '{p}') AS gaps FROM docs WHERE regexp_matches(text, '{p}'))")
        steps.append(f"p{kind} AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k{kind})")
        size = lambda of, to: f"coalesce(list_sum(list_transform(list_slice({of}, 1, {to}), lambda x: length(x))), 0)"
        rows.append(f"SELECT row, {kind} AS kind, '{name}' AS name, CAST({size('gaps', 'i')} + {size('m', 'i - 1')} AS BIGINT) AS start, length(m[i]) AS n FROM p{kind} WHERE length(g[i]) >= {least}")
    count = ", ".join(f"count(*) FILTER (WHERE kind = {kind}) AS n_{name}" for kind, (name, *_) in enumerate(KNOWN))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), {", ".join(steps)},
spans AS ({" UNION ALL ".join(rows)})
SELECT any_value(doc_id) AS doc_id, {count}, sha256(coalesce(string_agg(name || ':' || start || ':' || (start + n), ',' ORDER BY start, kind) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256
FROM docs LEFT JOIN spans USING (row) GROUP BY row
"""


QUERIES = {"op7_secret_scan": op7_secret_scan, "secret_base": secret_base}
ORACLE_SQL = {"secret_base": _base_sql()}
