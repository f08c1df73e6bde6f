"""URL filters: rules by host and path, and for the rest a naive Bayes vote on segmented names.

Host names run words together. A unigram model of the words on all pages splits them: the Viterbi path over
a name is its likeliest split. The words of host and path are then tokens of a multinomial naive Bayes model
that learns from the urls that rules decide, whose verdicts are its labels.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host, path. A rule fits its host and all subdomains, if the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Letters of a word at most. DNS labels have 63 characters at most, so no longer word can stand in a host name.
LONGEST_WORD = 63
#: Buckets that tokens hash to; a power of two.
BUCKETS = 1 << 14
SCALE = 1_000_000


def host_of(url: Column) -> Column:
    return F.translate(_after_scheme(url, r"^([^/?#]*)"), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return _after_scheme(url, r"^[^/?#]*([^?#]*)")


def _after_scheme(url: Column, pattern: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), pattern, 1)).otherwise("")


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``verdict`` of the longest rule that fits ``host`` and ``path``; else both null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("verdict", verdict)


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """``word`` and ``n`` over all rows: lower-cased runs of letters outside of tags."""
    plain = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]*>", " "))
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.char_length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, logs: dict[str, float], total: float) -> list[str]:
    """The likeliest split of ``name``; a string of n characters that is no word has the chance 10 / (total * 10**n)."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    base = math.log(10.0) - math.log(max(total, 1.0))
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            log = logs.get(name[start:end])
            score = best[start] + (base - (end - start) * math.log(10.0) if log is None else log)
            if score > best[end]:
                best[end], back[end] = score, start
    out, at = [], len(name)
    while at:
        out.append(name[back[at] : at])
        at = back[at]
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``host`` and ``tokens``: the words of each distinct host.

    Only the words that occur in a host travel to it, so the word list may be of any size. Parts of names are
    counted as one however many hosts have them, so that a frequent one, such as a top-level domain, meets the
    word list once; what was found then goes back by name.
    """
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    named = hosts.select("host").distinct().withColumn("names", F.array_distinct(F.regexp_extract_all("host", F.lit(r"\p{L}+"), F.lit(0))))
    names = named.select(F.explode("names").alias("name")).distinct()
    spots = names.select("name", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("at"))
    reach = F.least(F.lit(LONGEST_WORD), F.char_length("name") - F.col("at") + 1)
    parts = spots.select("name", F.explode(F.transform(F.sequence(F.lit(1), reach), lambda n: F.substr("name", F.col("at"), n))).alias("word")).distinct()
    from .common import materialize

    # stored, so that a name of very many hosts can be split over tasks when it is joined
    found = materialize(parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("hits")))
    hits = named.select("host", F.explode("names").alias("name")).join(found, "name").groupBy("host").agg(F.flatten(F.collect_list("hits")).alias("hits"))

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        pieces = regex.compile(r"\p{L}+|\p{N}+").findall
        for batch in batches:
            tokens = []
            for host, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                logs = {x["word"]: math.log(x["n"] / total) for x in own or ()}
                tokens.append([t for piece in pieces(host) for t in (viterbi(piece, logs, total) if piece[0].isalpha() else [piece])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], ["host", "tokens"])

    return hosts.select("host").distinct().join(hits, "host", "left").mapInArrow(split, "host string, tokens array<string>")


def path_tokens(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def bayes(words: DataFrame, labelled: DataFrame, buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """Log-odds of block to allow, as whole millionths: of the classes, and of each bucket's tokens.

    ``words`` has verdict, token and times (how often they occur), ``labelled`` a row with its verdict for each
    labelled url. All rows count; a row for each bucket reaches the driver.
    """
    bucket = F.xxhash64("token").bitwiseAND(F.lit(buckets - 1))
    blocked = F.col("verdict") == "block"
    count = lambda some: F.coalesce(F.sum(F.when(some, F.col("times"))), F.lit(0))
    rows = words.groupBy(bucket.alias("bucket")).agg(count(blocked).alias("b"), count(~blocked).alias("a")).collect()
    ends = labelled.agg(F.count_if(blocked).alias("b"), F.count_if(~blocked).alias("a")).first()
    b, a = sum(r.b for r in rows) + len(rows), sum(r.a for r in rows) + len(rows)
    found = {r.bucket: round(SCALE * (math.log((r.b + 1) / b) - math.log((r.a + 1) / a))) for r in rows}
    prior = round(SCALE * (math.log(ends.b + 1) - math.log(ends.a + 1)))
    return prior, [found.get(i, 0) for i in range(buckets)]


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES) -> DataFrame:
    """``id_col``, host, path, rule, verdict (allow or block) and score of every row.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up
    to ``?``, ``#`` or the end; a null url, or one without ``://``, has neither. The longest rule that fits
    decides; else naive Bayes does: block if its log-odds ``score`` (in nats; null where a rule decides) are
    over 0. Tokens that no labelled url has say nothing; a url without tokens is allowed. Ids may repeat or be
    null, each row is judged by its url alone, however long; other columns are ignored. An empty table gives no
    rows; without labelled urls the verdict is allow.
    """
    urls = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    urls = ruled(urls.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")), rules)
    from .common import materialize

    # read once: the pages' texts make up most of a table
    names = materialize(segmented(urls.select("host"), materialize(word_counts(pages, text_col))))
    held = urls.select("verdict", "host", path_tokens(F.col("path")).alias("more")).where("verdict IS NOT NULL")
    # a host's words count as often as it occurs, so they travel once
    often = held.groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("times")).join(names, "host")
    by_host = often.select("verdict", "times", F.explode("tokens").alias("token"))
    by_path = held.select("verdict", F.lit(1).alias("times"), F.explode("more").alias("token"))
    prior, odds = bayes(by_host.union(by_path), held)
    table = F.split(F.lit(",".join(map(str, odds))), ",").cast("array<bigint>")
    add = lambda total, t: total + F.get(table, F.xxhash64(t).bitwiseAND(F.lit(len(odds) - 1)).cast("int"))
    # the sum of a host is worked out once for all its urls
    hosts = names.select("host", (F.size("tokens") > 0).alias("_any"), F.aggregate("tokens", F.lit(0).cast("long"), add).alias("_sum"))
    own = path_tokens(F.col("path"))
    urls = urls.join(hosts, "host", "left")
    score = F.when(F.col("_any") | (F.size(own) > 0), F.col("_sum") + F.aggregate(own, F.lit(prior).cast("long"), add)).otherwise(F.lit(0).cast("long"))
    urls = urls.withColumn("_score", F.when(F.col("verdict").isNull(), score))
    verdict = F.coalesce("verdict", F.when(F.col("_score") > 0, "block").otherwise("allow"))
    return urls.select(id_col, "host", "path", "rule", verdict.alias("verdict"), (F.col("_score") / SCALE).alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from .common import read

    return judged(read(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path, and the rule that fits, of every page's url."""
    from .common import read

    urls = read(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return ruled(urls)


def _rules_sql() -> str:
    cases = [[], []]
    for kind, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN"
        cases[0].append(f"{fits} '{host}{path}'")
        cases[1].append(f"{fits} '{kind}'")
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {" ".join(cases[0])} END AS rule, CASE {" ".join(cases[1])} END AS verdict FROM urls
"""


QUERIES = {"op3_url_filter": op3_url_filter, "url_rules": url_rules}
ORACLE_SQL = {"url_rules": _rules_sql()}
