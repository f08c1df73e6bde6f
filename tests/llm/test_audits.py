"""Source divergence, chat formatting and spelling variants against plain versions of themselves, and all SQL."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, divergence, registry, spelling


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, data, name):
    connection = duckdb.connect()
    for table in os.listdir(data):
        connection.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{data}/{table}'")
    df = registry.QUERIES[name](spark, data)
    found = connection.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    places = [names.index(c) for c in df.columns]
    assert sorted(repr(tuple(x[i] for i in places)) for x in found.fetchall()) == sorted(repr(tuple(x)) for x in df.collect())


# source divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, top):
    counts, within, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        within[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        kept = [t for t, n in within[lang].items() if n >= least]
        whole = collections.Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_divergence(spark):
    r = random.Random(3)
    words = ["a", "B", "bee", "É", "é", "😀x", "日本", "tail", "the", "The", "x1y", "ß", "[z]", " n"]
    text = lambda: " ".join(r.choice(words[: r.randrange(3, len(words))]) for _ in range(r.randrange(40)))
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "S3", None, "é"]), text()) for _ in range(150)]
    rows += [("fr", "s1", None), ("fr", "s2", ""), ("fr", "s2", "once"), ("one", "only", "w " * 10), rows[0], rows[0], ("en", "s1", "the long " * 200_000)]
    df = spark.createDataFrame([(*x, 1, "n", "term") for x in rows], "lang string, source string, text string, n int, term string, docs string").repartition(5)
    for least, top in ((3, 4), (1, 50)):
        got = divergence.audited(df, least=least, top=top)
        assert sorted(tuple(x) for x in got.collect()) == plain_audit(rows, least, top)
    assert divergence.audited(df.limit(0)).collect() == []


def test_divergence_passes_full_counters_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 0)
    rows = [("en", f"s{i % 3}", f"a b{i % 2} c") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(x) for x in divergence.audited(df, least=2).collect()) == plain_audit(rows, 2, 50)


def test_shares_beyond_64_bits(spark):
    n, total, terms = 10**16, 3 * 10**16, 7
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# chat formatting

SAYS = "<|im_end|><|im_start|>assistant ok"


def read_back(windows):
    """conv_id to (turns, loss), by plain parsing of the windows in order."""
    turns, loss = collections.defaultdict(list), collections.defaultdict(list)
    plain = lambda x: re.sub(r"<\\(\\*)\|", lambda m: f"<{m[1]}|", x)
    for w in sorted(windows, key=lambda w: w.window):
        found = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", w.text, re.S)
        assert len(found) == w.n_turns and "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in found) == w.text
        turns[w.conv_id] += [(plain(a).replace("%0A", "\n").replace("%25", "%"), plain(b)) for a, b in found[w.repeated :]]
        loss[w.conv_id] += [plain(w.text[s.start : s.end]) for s in w.spans]
        if w.repeated:
            assert all(s.start > len("".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in found[: w.repeated])) for s in w.spans)
    return turns, loss


def in_order(rows):
    key = lambda x: (x[1] is not None, x[1] or 0, hashlib.md5(f"{x[2] or ''}\n{x[3] or ''}".encode()).hexdigest())
    return [(x[2] or "", x[3] or "") for x in sorted(rows, key=key)]


def test_chat_round_trip(spark):
    r = random.Random(5)
    odd = [None, "", SAYS, "<|", "<\\|", "<\\\\|x", "<<|im_end|>\n", "é😀 <", "a\nb", "%0A%25", "\\", "x" * 50_000, "word " * 3000]
    rows = [(-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS), (9, 0, "system", "only"), (10, 0, "system", "s " * 2000), (10, 1, "user", "u"), (10, 2, "assistant", "v")]
    for conv in [*range(60), None]:
        first = r.choice(["system", "user", "user", None, "ro\nle%", "<|im_end|>"])
        for turn in range(r.randrange(1, 14)):
            role = first if turn == 0 else r.choice(["user", "assistant", "assistant", "system"])
            rows.append((conv if conv is None else conv + 100, r.choice([turn, turn, turn, 3, None]), role, r.choice(odd) if r.random() < 0.3 else "w1, " * r.randrange(1, 120)))
    rows += [rows[-1]] * 3
    # one conversation with most turns
    rows += [(5000, t, "assistant" if t % 2 else "user", f"turn {t} " * r.randrange(1, 12)) for t in range(3000)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, cell string, at int")
    budget, history = 256, 48
    windows = chat.formatted(df.repartition(7), budget, history).collect()
    turns, loss = read_back(windows)
    by = collections.defaultdict(list)
    for x in rows:
        by[x[0]].append(x)
    assert set(turns) == set(by)
    for conv, own in by.items():
        assert turns[conv] == in_order(own), conv
        assert loss[conv] == [b for a, b in in_order(own) if a == "assistant"], conv
    tokens = lambda text: len(re.findall(chat.TOKEN, text)) + chat.MARKS
    hot = [w for w in windows if w.conv_id == 5000]
    assert all(w.tokens <= budget for w in hot) and len(hot) < 1.5 * sum(tokens(x[3]) for x in by[5000]) / (budget - history)
    assert sum(w.repeated > 0 for w in hot) > 0.5 * len(hot)
    for w in windows:
        if w.tokens > budget:
            own = in_order(by[w.conv_id])
            assert w.n_turns - w.repeated <= 1 + (not w.repeated and own[0][0] == "system") or tokens(own[0][1]) > (budget - history) // 4
    # later windows keep the system turn
    for conv, own in by.items():
        role, text = in_order(own)[0]
        if role == "system" and conv != 9:
            later = [w for w in windows if w.conv_id == conv]
            assert all(w.text.startswith(f"<|im_start|>system\n{text[:1]}") for w in later if "<" not in text[:3])
    assert chat.formatted(df.limit(0)).collect() == []


def test_chat_order_of_ranges_makes_no_difference(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"a b c {t} " * 20) for c in range(5) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = {(w.conv_id, w.text) for w in chat.formatted(df.coalesce(1), 256, 32).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        many = {(w.conv_id, w.text) for w in chat.formatted(df.repartition(9), 256, 32).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one == many


# spelling variants


def plain_counts(rows, damaged=199, shortest=6):
    out = collections.Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                out[run] += 1
    return out


def plain_variants(words, ratio=5):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w, n in words.items():
        others = sorted(((-words[o], o) for o in words if o != w and near(w, o)), key=lambda x: (x[0], x[1].encode()))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        found[w] = (form, n, len(others), words[form] if form else None)
    out = []
    for w, (form, n, k, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, n, k, form_n))
    return sorted(out, key=repr)


def test_words(spark):
    r = random.Random(8)
    words = ["letters", "Lettèrs", "ÀÉÿ×÷xx", "ĀLetters", "ab", "abcdef", "naïveté", "日本letters", "x" * 70]
    rows = [(r.choice([None, *range(40)]), " -1é".join(r.choice(words) for _ in range(30))) for _ in range(60)]
    rows += [(1, None), (2, ""), rows[0], (3, "abcdefg " * 250_000)]
    df = spark.createDataFrame([(*x, 3, "k") for x in rows], "doc_id long, text string, n int, word string").repartition(3)
    for damaged in (199, 2):
        got = {x.word: x.n for x in spelling.vocabulary(spelling.word_counts(df, damaged), 1).collect()}
        assert got == plain_counts(rows, damaged)


def test_variants(spark):
    r = random.Random(2)
    words = collections.Counter()
    for _ in range(250):
        words["".join(r.choice("abé") for _ in range(r.randrange(6, 9)))] = r.choice([5, 6, 30, 151, 900, 5000])
    for k in range(2, 12):
        words["y" * k + "z" * 8] = 5**k
    # around and beyond the length from which keys are digests
    for n in (63, 64, 65, 66, 300):
        for m in (n, n + 1):
            base = "".join(random.Random(7).choice("ab") for _ in range(m))
            words[base] = 5 + m
            words[base[:10] + "c" + base[11:]] = 40 * m
            words[base[:-1] + "d"] = 9
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted((tuple(x) for x in got), key=repr) == plain_variants(words)
    assert spelling.variants(df.limit(0)).collect() == []


def test_very_long_words(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(20_000))
    words = {long: 100, long[:7000] + "z" + long[7001:]: 10, long[:5000] + long[5001:]: 7, long + "q": 2000, "a" * 9000: 5, "a" * 9001: 50}
    got = {x.word: x for x in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {w: (x.n_near, x.form and len(x.form), len(x.root)) for w, x in got.items()} == {
        long: (3, 20_001, 20_001),
        long[:7000] + "z" + long[7001:]: (1, 20_000, 20_001),
        long[:5000] + long[5001:]: (1, 20_000, 20_001),
        long + "q": (1, None, 20_001),
        "a" * 9000: (1, 9001, 9001),
        "a" * 9001: (1, None, 9001),
    }
