"""Queries over the corpus tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import bytepair as B
from corpusloom.functions import identity as I
from corpusloom.functions import schedule as S
from corpusloom.operators import bpe_encode, bpe_train, corpus, mixture, prefix, windows

MERGES_TRAINED, MERGES_MORE, CONTEXT, SEED, BATCH, ACCUMULATION = 8, 64, 128, 17, 4, 4


def _read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark, sf_dir: str) -> DataFrame:
    return corpus.extract(_read(spark, sf_dir, "documents"))


def _pages(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))


# SQL parts

_DOCS = "docs AS (SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL AND text <> '')"


def _le(digest: str, byte: int) -> str:
    pairs = " || ".join(f"substr({digest}, {2 * (byte + k) + 1}, 2)" for k in reversed(range(8)))
    return f"CAST('0x' || {pairs} AS UBIGINT)"


def _chars(text: str) -> str:
    """The Latin-1 view of a text's bytes."""
    return f"array_to_string(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: chr(CAST('0x' || x AS INT))), '')"


def _lit(c: str) -> str:
    return f"chr({ord(c)})"


def _encoded(chars: str) -> str:
    step = lambda s, k: f"replace({s}, {_lit(B.token_char(B.MERGES[k][0]))} || {_lit(B.token_char(B.MERGES[k][1]))}, {_lit(B.token_char(256 + k))})"
    return reduce(step, range(len(B.MERGES)), chars)


def _count_ids(chars: str) -> str:
    return f"length({chars})"


# extraction and identity


def corpus_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", I.framed_bytes(F.col("text")).alias("doc_bytes"), F.char_length("text").cast("long").alias("n_characters"))


_EXTRACT = f"WITH {_DOCS} SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS doc_bytes, CAST(length(text) AS BIGINT) AS n_characters FROM docs"


def identity_split_url(spark, sf_dir):
    index = corpus.indexed(_pages(spark, sf_dir))
    return index.select("page_id", "is_validation")


_PAGES = "pages_ AS (SELECT page_id, coalesce(nullif(url, ''), html) AS identity, html AS text FROM pages WHERE html IS NOT NULL AND html <> ''), hashed AS (SELECT *, sha256(identity) AS h FROM pages_)"
_SPLIT_URL = f"WITH {_PAGES} SELECT page_id, {_le('h', 0)} % 10 = 0 AS is_validation FROM hashed"
_HASHED = f"{_DOCS}, hashed AS (SELECT doc_id, text, source, sha256(text) AS h FROM docs)"


def identity_split_text(spark, sf_dir):
    return corpus.indexed(_docs(spark, sf_dir)).select("doc_id", "is_validation")


_SPLIT_TEXT = f"WITH {_HASHED} SELECT doc_id, {_le('h', 0)} % 10 = 0 AS is_validation FROM hashed"


def document_index(spark, sf_dir):
    return corpus.indexed(_pages(spark, sf_dir)).select("page_id", "doc_bytes", "is_validation", F.col("sample_key").cast("string").alias("sample_key"))


_INDEX = f"WITH {_PAGES} SELECT page_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS doc_bytes, {_le('h', 0)} % 10 = 0 AS is_validation, CAST({_le('h', 8)} AS VARCHAR) AS sample_key FROM hashed"


def split_counts(spark, sf_dir):
    index = corpus.indexed(_docs(spark, sf_dir))
    return index.groupBy("is_validation").agg(F.count(F.lit(1)).alias("documents"), F.sum("doc_bytes").alias("bytes"))


_SPLIT_COUNTS = f"WITH {_HASHED} SELECT {_le('h', 0)} % 10 = 0 AS is_validation, count(*) AS documents, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM hashed GROUP BY 1"


def exclude_prior_identities(spark, sf_dir):
    """Documents of which no document of the first source has the text."""
    index = corpus.indexed(_docs(spark, sf_dir))
    return corpus.excluded(index, index.where("source = 'src0'")).select("doc_id", "source")


_EXCLUDE = f"WITH {_DOCS} SELECT doc_id, source FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs p WHERE p.source = 'src0' AND p.text = d.text)"


def tokenizer_sample(spark, sf_dir):
    """Training documents of about a fifth of the corpus."""
    index = corpus.indexed(_docs(spark, sf_dir))
    total = index.agg(F.sum("doc_bytes")).first()[0] or 0
    return corpus.tokenizer_sample(index, total // 5).select("doc_id", "doc_bytes")


_SAMPLE = f"""WITH {_HASHED}, sized AS (SELECT doc_id, octet_length(encode(text)) + 1 AS n, {_le('h', 0)} % 10 = 0 AS v, {_le('h', 8)} AS k FROM hashed),
total AS (SELECT CAST(sum(n) AS BIGINT) AS all_bytes FROM sized), cut AS (SELECT least(1.0::DOUBLE, (all_bytes // 5) / greatest(1.0::DOUBLE, all_bytes * 0.9::DOUBLE)) * 18446744073709551615::DOUBLE AS c FROM total)
SELECT doc_id, CAST(n AS BIGINT) AS doc_bytes FROM sized, cut WHERE NOT v AND k <= CAST(c AS UBIGINT)"""


def shard_union(spark, sf_dir):
    """Three shards in order; the first two, appended."""
    docs = _docs(spark, sf_dir)
    shards = [docs.where(F.col("doc_id") % 3 == k).select(F.lit(f"shard-{k}").alias("shard"), "doc_id", I.framed_bytes(F.col("text")).alias("doc_bytes")) for k in (2, 0, 1)]
    names = sorted(f"shard-{k}" for k in range(3))[:2]
    return reduce(DataFrame.unionByName, shards).where(F.col("shard").isin(names))


_SHARDS = f"WITH {_DOCS} SELECT 'shard-' || CAST(doc_id % 3 AS VARCHAR) AS shard, doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS doc_bytes FROM docs WHERE doc_id % 3 < 2"


# bytes and pairs


def byte_histogram(spark, sf_dir):
    chars = _docs(spark, sf_dir).select(F.explode(F.split(B.byte_chars(F.concat("text", F.lit("\n"))), "")).alias("c"))
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(F.ascii("c").alias("byte"), "n")


_HISTOGRAM = f"WITH {_DOCS}, cells AS (SELECT unnest(string_split({_chars('text || chr(10)')}, '')) AS c FROM docs) SELECT CAST(unicode(c) AS INT) AS byte, count(*) AS n FROM cells GROUP BY 1"


def _byte_rows(spark, sf_dir):
    return _docs(spark, sf_dir).select(B.byte_chars(F.concat("text", F.lit("\n"))).alias("chars"))


def pair_counts_top(spark, sf_dir):
    """The twenty most frequent pairs of bytes: the report that training reads its next merge from."""
    return bpe_encode.pair_counts(bpe_encode.spread(_docs(spark, sf_dir).select("text")), [], framed=True).orderBy(F.desc("n"), "left", "right").limit(20)


def _pairs_of(relation: str, chars: str) -> str:
    return f"SELECT l, r, count(*) AS n FROM (SELECT unnest(list_zip(t[:len(t) - 1], t[2:])) AS p FROM (SELECT string_split({chars}, '') AS t FROM {relation}) WHERE len(t) > 1), LATERAL (SELECT p[1] AS l, p[2] AS r) GROUP BY l, r"


_FRAMED = f"framed AS MATERIALIZED (SELECT doc_id, {_chars('text || chr(10)')} AS c FROM docs)"
_PAIRS = f"WITH {_DOCS}, {_FRAMED}, counts AS ({_pairs_of('framed', 'c')}) SELECT CAST(unicode(l) AS INT) AS \"left\", CAST(unicode(r) AS INT) AS \"right\", n FROM counts ORDER BY n DESC, 1, 2 LIMIT 20"


def _trained(spark, sf_dir, merges):
    found = bpe_train.train_by_passes(_docs(spark, sf_dir), merges, framed=True)
    return spark.createDataFrame([(k, left, right, 256 + k, n) for k, (left, right, n) in enumerate(found)], "rank int, left int, right int, new_id int, n long")


def bpe_train_k8(spark, sf_dir):
    """Eight merges learnt from all documents."""
    return _trained(spark, sf_dir, MERGES_TRAINED)


def bpe_train_k64(spark, sf_dir):
    """Sixty-four merges learnt from all documents, several of them in a pass."""
    return _trained(spark, sf_dir, MERGES_MORE)


def bpe_encode_learnt(spark, sf_dir):
    """All documents in the ids of merges that were learnt from them in the same run."""
    docs = _docs(spark, sf_dir)
    merges = [(left, right) for left, right, _ in bpe_train.train_by_passes(docs, MERGES_TRAINED, framed=True)]
    rows = bpe_encode.encoded(bpe_encode.spread(docs.select("doc_id", "text")), merges)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_md5"))


def _train_steps(merges: int = MERGES_TRAINED) -> tuple[list[str], str]:
    """The SQL of the merges one after another, and the relation with the text after all of them."""
    steps = [_DOCS, _FRAMED]
    relation = "framed"
    for k in range(merges):
        steps.append(f"best{k} AS MATERIALIZED (SELECT l, r, n FROM ({_pairs_of(relation, 'c')}) WHERE n >= 2 ORDER BY n DESC, unicode(l), unicode(r) LIMIT 1)")
        steps.append(f"step{k} AS MATERIALIZED (SELECT doc_id, replace(c, l || r, chr({256 + k})) AS c FROM {relation}, best{k})")
        relation = f"step{k}"
    return steps, relation


def _train_sql(merges: int = MERGES_TRAINED) -> str:
    steps, _ = _train_steps(merges)
    rows = " UNION ALL ".join(f"SELECT {k} AS rank, CAST(unicode(l) AS INT) AS \"left\", CAST(unicode(r) AS INT) AS \"right\", {256 + k} AS new_id, n FROM best{k}" for k in range(merges))
    return f"WITH {', '.join(steps)} {rows}"


def _learnt_sql() -> str:
    steps, relation = _train_steps()
    return f"WITH {', '.join(steps)} SELECT doc_id, CAST(length(c) AS BIGINT) AS n_tokens, md5({_IDS}) AS ids_md5 FROM {relation}"


def bpe_encode_ids(spark, sf_dir):
    """The ids of all documents by fixed merges."""
    rows = bpe_encode.encoded(bpe_encode.spread(_docs(spark, sf_dir).select("doc_id", "text")), B.MERGES)
    return rows.select("doc_id", F.array_join(corpus.checked_ids(F.col("ids")).cast("array<string>"), " ").alias("ids"))


_ENCODED = f"{_DOCS}, encoded AS (SELECT doc_id, text, source, {_encoded(_chars('text || chr(10)'))} AS c FROM docs)"
_IDS = "array_to_string(list_transform(string_split(c, ''), lambda x: CAST(unicode(x) AS VARCHAR)), ' ')"
_ENCODE = f"WITH {_ENCODED} SELECT doc_id, {_IDS} AS ids FROM encoded"
_EOS = 256 + len(B.MERGES)


def bpe_encode_eos(spark, sf_dir):
    rows = bpe_encode.encoded(bpe_encode.spread(_docs(spark, sf_dir).select("doc_id", "text")), B.MERGES, carried=["doc_id"])
    ids = F.array_append("ids", F.lit(_EOS))
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.element_at(ids, -1).alias("last_id"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


def _token_counts(spark, sf_dir):
    """is_validation, bytes and tokens, the end token among them, of every document."""
    rows = _docs(spark, sf_dir).select("text", I.is_validation(I.digest(F.col("text"))).alias("is_validation"), I.framed_bytes(F.col("text")).alias("bytes"))
    rows = bpe_encode.encoded(bpe_encode.spread(rows), B.MERGES, carried=["is_validation", "bytes"])
    return rows.select("is_validation", "bytes", (F.size("ids") + 1).alias("tokens"))


_ENCODE_EOS = f"WITH {_ENCODED} SELECT doc_id, CAST(length(c) + 1 AS BIGINT) AS n_tokens, {_EOS} AS last_id, CAST(list_sum(list_transform(string_split(c, ''), lambda x: unicode(x))) + {_EOS} AS BIGINT) AS id_sum FROM encoded"


def bpe_decode_roundtrip(spark, sf_dir):
    """All documents with their newlines, encoded and decoded again."""
    rows = bpe_encode.encoded(bpe_encode.spread(_docs(spark, sf_dir).select("doc_id", "text")), B.MERGES, carried=["doc_id"])
    return bpe_encode.decoded(rows, B.MERGES)


_DECODE = f"WITH {_DOCS} SELECT doc_id, text || chr(10) AS text FROM docs"


def bpe_vocab(spark, sf_dir):
    return spark.createDataFrame([(k, x.hex()) for k, x in enumerate(B.vocabulary())], "id int, bytes_hex string")


def _vocab_sql() -> str:
    rows = ", ".join(f"({256 + k}, {left}, {right})" for k, (left, right) in enumerate(B.MERGES))
    return f"""WITH RECURSIVE merges(id, l, r) AS (VALUES {rows}), parts(id, place, part) AS (
SELECT id, '', id FROM merges UNION ALL
SELECT p.id, p.place || s.side, CASE WHEN s.side = '0' THEN m.l ELSE m.r END FROM parts p JOIN merges m ON p.part = m.id CROSS JOIN (VALUES ('0'), ('1')) s(side))
SELECT CAST(i AS INT) AS id, lower(printf('%02x', i)) AS bytes_hex FROM range(0, 256) t(i)
UNION ALL SELECT id, string_agg(printf('%02x', part), '' ORDER BY place) FROM parts WHERE part < 256 GROUP BY id
UNION ALL SELECT {_EOS}, ''"""


# statistics


def token_counts_by_split(spark, sf_dir):
    return _token_counts(spark, sf_dir).groupBy("is_validation").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


_TOKENS_BY_SPLIT = f"WITH {_ENCODED}, hashed AS (SELECT c, sha256(text) AS h FROM encoded) SELECT {_le('h', 0)} % 10 = 0 AS is_validation, count(*) AS documents, CAST(sum(length(c) + 1) AS BIGINT) AS tokens FROM hashed GROUP BY 1"


def compression_stats(spark, sf_dir):
    rows = _token_counts(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("vocabulary", F.lit(_EOS + 1)).withColumn("bytes_per_token", F.round(F.col("bytes") / F.col("tokens"), 6))


_COMPRESSION = f"WITH {_ENCODED}, sums AS (SELECT count(*) AS documents, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(length(c) + 1) AS BIGINT) AS tokens FROM encoded) SELECT documents, bytes, tokens, {_EOS + 1} AS vocabulary, round(bytes / tokens, 6) AS bytes_per_token FROM sums"


def corpus_prepare(spark, sf_dir):
    """Extract, split, encode and count: what a corpus comes to."""
    sums = _token_counts(spark, sf_dir).groupBy("is_validation").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("bytes_per_token", F.round(F.col("bytes") / F.col("tokens"), 6))


_PREPARE = f"WITH {_ENCODED}, hashed AS (SELECT text, c, sha256(text) AS h FROM encoded), sums AS (SELECT {_le('h', 0)} % 10 = 0 AS is_validation, count(*) AS documents, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(length(c) + 1) AS BIGINT) AS tokens FROM hashed GROUP BY 1) SELECT *, round(bytes / tokens, 6) AS bytes_per_token FROM sums"


# streams of tokens


def positional_split_90_10(spark, sf_dir):
    """All documents as one stream of tokens, cut at nine tenths: where each document's tokens go."""
    rows = bpe_encode.encoded(bpe_encode.spread(_docs(spark, sf_dir).select("doc_id", "text")), B.MERGES, carried=["doc_id"])
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    rows = prefix.sums_along(rows, "n", ["doc_id"]).join(F.broadcast(total))
    train = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("total") * F.lit(0.9).cast("double")).cast("long") - F.col("before")))
    return rows.select("doc_id", train.cast("long").alias("train_tokens"), (F.col("n") - train).cast("long").alias("validation_tokens"))


_POSITIONAL = f"""WITH {_ENCODED}, sized AS (SELECT doc_id, length(c) AS n, coalesce(sum(length(c)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(length(c)) OVER () AS total FROM encoded),
cut AS (SELECT doc_id, n, greatest(0, least(n, floor(total * 0.9::DOUBLE)::BIGINT - b)) AS t FROM sized) SELECT doc_id, CAST(t AS BIGINT) AS train_tokens, CAST(n - t AS BIGINT) AS validation_tokens FROM cut"""


def _windows(spark, sf_dir):
    # without merges, ids are bytes
    docs = bpe_encode.encoded(bpe_encode.spread(_docs(spark, sf_dir).select("doc_id", "text")), [], carried=["doc_id"])
    return windows.context_windows(docs.withColumn("ids", F.array_append("ids", F.lit(256))), CONTEXT)


def context_windows(spark, sf_dir):
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return _windows(spark, sf_dir).select(F.col("window_id").cast("long").alias("window_id"), total.alias("id_sum"), F.get("ids", F.lit(0)).alias("first_input"), F.element_at("ids", -1).alias("last_target"))


_STREAM = f"""{_DOCS}, sized AS (SELECT doc_id, octet_length(encode(text)) + 2 AS n, regexp_extract_all(hex(encode(text || chr(10))), '..') AS h FROM docs),
placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sized),
cells AS (SELECT o, n, h, unnest(range(0, n)) AS i FROM placed),
stream AS (SELECT CAST(o + i AS BIGINT) AS p, CASE WHEN i = n - 1 THEN 256 ELSE CAST('0x' || h[i + 1] AS INT) END AS id FROM cells)"""
_WINDOWS = f"""WITH {_STREAM}, shared AS (SELECT p // {CONTEXT} AS w, p % {CONTEXT} AS k, id FROM stream UNION ALL SELECT p // {CONTEXT} - 1, {CONTEXT}, id FROM stream WHERE p > 0 AND p % {CONTEXT} = 0)
SELECT CAST(w AS BIGINT) AS window_id, CAST(sum(id) AS BIGINT) AS id_sum, CAST(max(CASE WHEN k = 0 THEN id END) AS INT) AS first_input, CAST(max(CASE WHEN k = {CONTEXT} THEN id END) AS INT) AS last_target FROM shared GROUP BY w HAVING count(*) = {CONTEXT + 1}"""


def _epoch(spark, sf_dir) -> tuple[int, S.Epoch]:
    n = _docs(spark, sf_dir).agg(F.sum(F.octet_length("text") + 2)).first()[0] or 0
    chunks = (n - 1) // CONTEXT
    return chunks, S.epochs(SEED, chunks, 1)[0]


def sampler_epoch(spark, sf_dir):
    """The order in which one epoch visits the windows."""
    chunks, epoch = _epoch(spark, sf_dir)
    return spark.range(chunks).select(F.col("id").alias("cursor"), epoch.order(F.col("id")).alias("window_id"))


def _epoch_sql() -> str:
    random = S.Pcg32(SEED)
    draws = ", ".join(f"({k}, {random.u32() << 32 | random.u32()}::UHUGEINT)" for k in range(64))
    return f"""{_DOCS}, size AS (SELECT CAST((sum(octet_length(encode(text)) + 2) - 1) // {CONTEXT} AS BIGINT) AS n FROM docs), draws(k, v) AS (VALUES {draws}),
starts AS (SELECT n, min(k) AS k0, arg_min(CAST(v % n::UHUGEINT AS BIGINT), k) AS start FROM draws, size WHERE v >= 18446744073709551616::UHUGEINT % n::UHUGEINT GROUP BY n),
strides AS (SELECT n, start, arg_min(CAST(v % (n - 1)::UHUGEINT AS BIGINT) + 1, k) AS stride FROM draws, starts WHERE k > k0 AND v >= 18446744073709551616::UHUGEINT % (n - 1)::UHUGEINT AND gcd(CAST(v % (n - 1)::UHUGEINT AS BIGINT) + 1, n) = 1 GROUP BY n, start),
epoch AS (SELECT i AS cursor, CAST((i::HUGEINT * stride + start) % n AS BIGINT) AS window_id FROM strides, range(0, (SELECT n FROM size)) t(i))"""


def batch_assignment(spark, sf_dir):
    chunks, epoch = _epoch(spark, sf_dir)
    rows = spark.range(chunks).select(F.col("id").alias("cursor"), epoch.order(F.col("id")).alias("window_id"))
    return rows.select("cursor", "window_id", F.floor(F.col("cursor") / (BATCH * ACCUMULATION)).alias("step"), F.floor(F.col("cursor") / BATCH).alias("microbatch"), F.lit(1.0 / ACCUMULATION).alias("scale"))


# mixtures


def _sources(spark, sf_dir):
    number = F.substring("source", 4, 9).cast("int")
    return _docs(spark, sf_dir).select("doc_id", "source", number.alias("source_index"), (1.0 + number % 3).alias("weight"), (F.octet_length("text") + 2).cast("long").alias("tokens"))


def _target(rows) -> int:
    """Half of what the scarcest source allows."""
    sums = rows.groupBy("source_index").agg(F.first("weight").alias("w"), F.sum("tokens").alias("n"))
    total = sums.agg(F.sum("w").alias("all"))
    return max(1, int(sums.join(F.broadcast(total)).agg(F.floor(0.5 * F.min(F.col("n") * F.col("all") / F.col("w")))).first()[0] or 0))


_SOURCES = f"""{_DOCS}, rows_ AS (SELECT doc_id, source, CAST(substr(source, 4) AS INT) AS source_index, 1.0::DOUBLE + CAST(substr(source, 4) AS INT) % 3 AS weight, CAST(octet_length(encode(text)) + 2 AS BIGINT) AS tokens FROM docs),
sums AS (SELECT source_index, any_value(source) AS source, any_value(weight) AS weight, CAST(sum(tokens) AS BIGINT) AS n FROM rows_ GROUP BY source_index),
goal AS (SELECT greatest(1, CAST(floor(0.5::DOUBLE * min(n * w.all_ / weight)) AS BIGINT)) AS target, any_value(w.all_) AS all_ FROM sums, (SELECT sum(weight) AS all_ FROM sums) w)"""
_ORDERED = """keyed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source_index ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / weight AS score FROM rows_),
ordered AS (SELECT doc_id, source_index, source, tokens, coalesce(sum(tokens) OVER (ORDER BY score, source_index, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM keyed)"""


def mixture_order(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    return mixture.mixed(rows, _target(rows)).select("doc_id", "source_index", "tokens", F.col("before").alias("tokens_before"))


_MIX_ORDER = f"WITH {_SOURCES}, {_ORDERED} SELECT doc_id, source_index, tokens, CAST(b AS BIGINT) AS tokens_before FROM ordered, goal WHERE b < target"


def mixture_shares(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    return mixture.mixed(rows, _target(rows)).groupBy("source_index").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


_MIX_SHARES = f"WITH {_SOURCES}, {_ORDERED} SELECT source_index, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM ordered, goal WHERE b < target GROUP BY source_index"


def mixture_feasible(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    return mixture.feasible(rows, 2 * _target(rows))


_MIX_FEASIBLE = f"WITH {_SOURCES} SELECT source, n AS tokens, CAST(floor(2 * target * (weight / all_)) AS BIGINT) AS required, n >= CAST(floor(2 * target * (weight / all_)) AS BIGINT) AS is_feasible FROM sums, goal"


# numbers


def lr_schedule(spark, sf_dir):
    return spark.range(160).select(F.col("id").alias("step"), F.round(S.learning_rate(F.col("id"), 100, 1.0, 0.1, 10), 6).alias("rate"))


_LR = "SELECT s AS step, round(CASE WHEN s < 10 THEN 1.0::DOUBLE * (s + 1) / 10 WHEN s >= 100 THEN 0.1::DOUBLE ELSE 0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * (s - 10) / 90::DOUBLE)) END, 6) AS rate FROM range(0, 160) t(s)"


def token_budget(spark, sf_dir):
    """Updates of 512 tokens that the byte tokens of each source come to."""
    rows = _sources(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return rows.select("source", "tokens", F.expr("(tokens + 511) DIV 512").alias("updates"), F.ceil((F.col("tokens") - 1) * F.lit(1.5).cast("double")).cast("long").alias("epoch_tokens"))


_BUDGET = f"WITH {_SOURCES} SELECT source, n AS tokens, (n + 511) // 512 AS updates, CAST(ceil((n - 1) * 1.5::DOUBLE) AS BIGINT) AS epoch_tokens FROM sums"


def param_counts(spark, sf_dir):
    rows = [(name, S.parameter_count(S.PRESET_VOCABULARY, context, width, layers), batch * accumulation * context) for name, context, width, layers, _, batch, accumulation, _ in S.PRESETS]
    return spark.createDataFrame(rows, "preset string, parameters long, tokens_per_update long")


_PARAMS = "SELECT p AS preset, CAST(v * d + t * d + l * (12 * d * d + 13 * d) + 2 * d AS BIGINT) AS parameters, CAST(u * t AS BIGINT) AS tokens_per_update FROM (VALUES ('98m', 16257, 512, 768, 12, 64), ('220m', 16257, 1024, 1024, 16, 32), ('320m', 16257, 1024, 1024, 24, 32)) x(p, v, t, d, l, u)"


def lcg_tokens(spark, sf_dir):
    """Synthetic tokens for timing: a linear congruence of their places, one for each document."""
    n = _docs(spark, sf_dir).count()
    value = F.pmod(F.col("id") * 1103515245 + 12345, F.lit(4294967296)) % 512
    return spark.range(n).select(F.col("id").alias("position"), value.cast("int").alias("token"))


_LCG = f"WITH {_DOCS} SELECT i AS position, CAST(((i * 1103515245 + 12345) % 4294967296) % 512 AS INT) AS token FROM range(0, (SELECT count(*) FROM docs)) t(i)"


# conversations


def _histories(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.concat(x["role"], F.lit(": "), x["text"], F.lit("\n")))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(lines, "").alias("history"))


def chat_history(spark, sf_dir):
    """Each conversation's turns in order, a line each, and its last 256 characters."""
    rows = _histories(spark, sf_dir)
    return rows.select("conv_id", "turns", F.char_length("history").cast("long").alias("n_characters"), F.substring("history", -256, 256).alias("tail"))


_LINES = "lines AS (SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"
_CHAT = f"WITH {_LINES} SELECT conv_id, turns, CAST(length(h) AS BIGINT) AS n_characters, right(h, 256) AS tail FROM lines"


def chat_context(spark, sf_dir):
    """Each conversation in tokens from an end token on, and what a model sees of it: the last two contexts' worth."""
    rows = bpe_encode.encoded(_histories(spark, sf_dir), B.MERGES, "history", framed=False, carried=["conv_id"])
    ids = F.concat(F.array(F.lit(_EOS)), "ids")
    seen = F.slice(ids, F.greatest(F.size(ids) - 2 * CONTEXT, F.lit(0)) + 1, F.lit(2 * CONTEXT))
    return rows.select("conv_id", F.size(ids).cast("long").alias("n_tokens"), F.array_join(seen.cast("array<string>"), " ").alias("context"))


_CONTEXT = f"WITH {_LINES}, coded AS (SELECT conv_id, chr({_EOS}) || {_encoded(_chars('h'))} AS c FROM lines), seen AS (SELECT conv_id, c AS whole, right(c, {2 * CONTEXT}) AS c FROM coded) SELECT conv_id, CAST(length(whole) AS BIGINT) AS n_tokens, {_IDS} AS context FROM seen"


QUERIES = {
    f.__name__.removesuffix("_ids"): f
    for f in (
        corpus_prepare, corpus_extract, identity_split_url, identity_split_text, document_index, split_counts, exclude_prior_identities,
        tokenizer_sample, shard_union, byte_histogram, pair_counts_top, bpe_train_k8, bpe_train_k64, bpe_encode_ids, bpe_encode_learnt, bpe_encode_eos, bpe_decode_roundtrip,
        bpe_vocab, token_counts_by_split, compression_stats, positional_split_90_10, context_windows, sampler_epoch, batch_assignment,
        mixture_order, mixture_shares, mixture_feasible, lr_schedule, token_budget, param_counts, lcg_tokens, chat_history, chat_context,
    )
}
ORACLE_SQL = {
    "corpus_prepare": _PREPARE, "corpus_extract": _EXTRACT, "identity_split_url": _SPLIT_URL, "identity_split_text": _SPLIT_TEXT,
    "document_index": _INDEX, "split_counts": _SPLIT_COUNTS, "exclude_prior_identities": _EXCLUDE, "tokenizer_sample": _SAMPLE,
    "shard_union": _SHARDS, "byte_histogram": _HISTOGRAM, "pair_counts_top": _PAIRS, "bpe_train_k8": _train_sql(), "bpe_train_k64": _train_sql(MERGES_MORE), "bpe_encode_learnt": _learnt_sql(), "bpe_encode": _ENCODE,
    "bpe_encode_eos": _ENCODE_EOS, "bpe_decode_roundtrip": _DECODE, "bpe_vocab": _vocab_sql(), "token_counts_by_split": _TOKENS_BY_SPLIT,
    "compression_stats": _COMPRESSION, "positional_split_90_10": _POSITIONAL, "context_windows": _WINDOWS, "mixture_order": _MIX_ORDER,
    "sampler_epoch": f"WITH {_epoch_sql()} SELECT cursor, window_id FROM epoch",
    "batch_assignment": f"WITH {_epoch_sql()} SELECT cursor, window_id, cursor // {BATCH * ACCUMULATION} AS step, cursor // {BATCH} AS microbatch, {1 / ACCUMULATION}::DOUBLE AS scale FROM epoch",
    "mixture_shares": _MIX_SHARES, "mixture_feasible": _MIX_FEASIBLE, "lr_schedule": _LR, "token_budget": _BUDGET, "param_counts": _PARAMS,
    "lcg_tokens": _LCG, "chat_history": _CHAT, "chat_context": _CONTEXT,
}
