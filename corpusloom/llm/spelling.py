"""Spelling variants: words that differ by one character, and the frequent form of each, found without pairs.

Words that differ by a replacement share a *wildcard group*: a place, what stands before it and what stands after it.
A group knows its size and its two best words, so each member learns how many others there are and which of them is the
best. Words that differ by an insertion meet where the longer one, with a character left out, is the shorter one:
deletions join the vocabulary by their keys. Both kinds of key travel in one shuffle, and each word then adds up what
its groups say.

A group holds at most one word for each character of the alphabet, a deletion's group at most that times the word's
length, whatever the corpus: words in it are distinct.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, discard, materialize, read, small_batches

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run of a document is damaged if its checksum is divisible by this.
DAMAGED = 199
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Words beyond this length have digests as keys, made in time linear in the length.
PLAIN = 64
#: A-Z become a-z; what is neither ASCII letter nor U+00C0 to U+00FF becomes a blank. Latin-1 has a byte for each.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))
_PRIME, _BASES = 2**61 - 1, (0x1F3D5B79A2C4E6F1 % (2**61 - 1), 0x0B5297A4D3E1C68F % (2**61 - 1))


def word_counts(docs: DataFrame, damaged: int = DAMAGED, shortest: int = LEAST_LENGTH) -> DataFrame:
    """``word`` and ``n``: partial counts, to be summed, of runs of letters of at least ``shortest`` code points.

    ``docs`` has doc_id and text. A run whose checksum with the document's id is divisible by ``damaged`` loses
    one code point, as the same run of the same document always does. A null id counts as ''.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # what isn't in Latin-1 is no letter here
                data = (text.as_py() or "").encode("latin-1", "replace")
                own: Counter = Counter()
                for runs in byte_runs(data, _TABLE):
                    own.update(runs)
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        found[word] += n
                if len(found) > HELD:
                    yield flushed()
        yield flushed()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def vocabulary(counts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of words that occur at least ``least`` times in all."""
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def keys_of(word: str) -> Iterator[tuple[int, str]]:
    """The keys under which a word meets those that are near: 0 itself, 1 with a wildcard, 2 with one left out.

    Keys of up to ``PLAIN`` characters are plain. Longer ones are two polynomial hashes modulo 2**61 - 1 with the
    length (and the place), put together from those of the parts before and after.
    """
    n = len(word)
    if n <= PLAIN:
        yield 0, word
        for i in range(n):
            yield 1, f"{word[:i]}*{word[i + 1 :]}"
        for i in range(n):
            # in a run of one character any of them may go
            if not i or word[i] != word[i - 1]:
                yield 2, word[:i] + word[i + 1 :]
        return
    codes = [ord(c) for c in word]
    heads, tails, powers = [], [], []
    for base in _BASES:
        head, tail, power = [0], [0], [1]
        for c in codes:
            head.append((head[-1] * base + c) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        for k, c in enumerate(reversed(codes)):
            tail.append((tail[-1] + c * power[k]) % _PRIME)
        heads.append(head), tails.append(tail), powers.append(power)

    def joined(i: int, rest: int) -> str:
        """The hashes of the first ``i`` and the last ``rest`` characters, joined."""
        return ":".join(f"{(h[i] * p[rest] + t[rest]) % _PRIME:x}" for h, t, p in zip(heads, tails, powers))

    yield 0, f"{n}:{joined(n, 0)}"
    for i in range(n):
        gap = joined(i, n - i - 1)
        yield 1, f"{n}*{i}:{gap}"
        if not i or word[i] != word[i - 1]:
            yield 2, f"{n - 1}:{gap}" if n - 1 > PLAIN else word[:i] + word[i + 1 :]


def _keys(words: DataFrame) -> DataFrame:
    """``key``, ``kind``, ``word``, ``n``: the keys of all words. Deletions and the words themselves share keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(rows):
            kinds, keys, words, counts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["key", "kind", "word", "n"])

        for batch in batches:
            rows, size = [], 0
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, key in keys_of(word):
                    rows.append((kind, key, word, n))
                    size += len(word) + len(key)
                    if size > 1 << 21:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    small_batches(words.sparkSession, 4096)
    return words.select("word", "n").mapInArrow(run, "key string, kind int, word string, n long")


def _ranked(word: Column | str, n: Column | str) -> Column:
    """A struct that sorts by falling ``n``, then by the word."""
    return F.struct((-F.col(n) if isinstance(n, str) else -n).alias("n"), (F.col(word) if isinstance(word, str) else word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (struct of -n and word) of words that have a near one.

    ``words`` has distinct ``word`` with ``n``. Two words are near if one insertion, deletion or replacement of a code
    point leads from one to the other.
    """
    rows = _keys(words)
    none = F.lit(None).cast("struct<n:bigint,word:string>")
    # replacements: a member's best is the group's best, or the second if it is the best itself
    group = rows.where("kind = 1").groupBy("key").agg(F.sort_array(F.collect_list(_ranked("word", "n"))).alias("words")).where(F.size("words") > 1)
    group = group.select(F.size("words").alias("size"), F.get("words", F.lit(0)).alias("first"), F.get("words", F.lit(1)).alias("second"), F.explode(F.transform("words", lambda x: x["word"])).alias("word"))
    replaced = group.select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # deletions: the short word's best is the best of the long ones; each long one has met one short word
    own = F.max(F.when(F.col("kind") == 0, _ranked("word", "n")))
    longer = F.sort_array(F.collect_list(F.when(F.col("kind") == 2, _ranked("word", "n"))))
    meet = rows.where("kind <> 1").groupBy("key").agg(own.alias("own"), longer.alias("longer")).where(F.col("own").isNotNull() & (F.size("longer") > 0))
    told = F.concat(
        F.array(F.struct(F.col("own.word").alias("word"), F.size("longer").alias("n_near"), F.get("longer", F.lit(0)).alias("best"))),
        F.transform("longer", lambda x: F.struct(x["word"].alias("word"), F.lit(1).alias("n_near"), F.coalesce("own", none).alias("best"))),
    )
    joined = meet.select(F.explode(told).alias("x")).select("x.*")
    return replaced.unionByName(joined).groupBy("word").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms that begins at a word. ``forms`` has word and form.

    A form is ``ratio`` times as frequent as its word, so that chains are short: ``most`` is the largest count. Each
    round doubles the steps that are taken.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")))
    steps = max(1, math.ceil(math.log(max(most, ratio), ratio)))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = materialize(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        discard(links)
        links = new
    return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for each row of ``words`` (distinct word, and n).

    ``n_near`` counts the words one insertion, deletion or replacement away. The form is the most frequent of them,
    the first in the order of code points among equals, if it is at least ``ratio`` times as frequent, else null. The
    root is where the chain of forms ends, the word itself without one. Words may have any length.
    """
    words = materialize(words.select("word", "n"))
    found = words.join(near_words(words), "word", "left")
    good = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n")))
    discard(words)
    most = found.agg(F.max("n")).first()[0] or 1
    ends = roots(found.where(F.col("form").isNotNull()), most, ratio)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents, some of them damaged by rule, with the forms that they are variants of.

    Null texts have no words, empty ones neither; repeated rows count each; an empty table gives no rows; other
    columns are not read.
    """
    return variants(vocabulary(word_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))))


# crc32 by its table, which is made from the polynomial
_CRC_TABLE = "(SELECT list(list_reduce([x] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t FROM (SELECT unnest(range(256)) AS x))"
_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
summed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(c >> 8, CAST(t[xor(c, b) % 256 + 1] AS BIGINT))), 4294967295::BIGINT) AS h FROM counted, crc
), damaged AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n) AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, left(word, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS key FROM places),
wild AS (SELECT word, n, i, left(word, CAST(i AS INT) - 1) || '*' || substr(word, CAST(i AS INT) + 1) AS key FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.key = w.word
  UNION ALL SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.key = w.word
), ranked AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM near),
found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * w.n THEN r.other END AS form, CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain(word, root) AS (
  SELECT word, word FROM found UNION ALL SELECT c.word, f.form FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.root FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM found JOIN ends USING (word)
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE_SQL = {"op13_spelling_variants": _SQL}
