"""Numeric kernels and sampling steps as relational queries over rows of vectors.

Each embedding is a row of activations, logits or gradients; its label is a class target or a table index.
The reference semantics are 32-bit; here all is computed in 64 bits and rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from .dialect import Duck, Spark

_WIDTH = 64


def _rounded(v: str) -> str:
    return f"round({v}, 6) + 0.0"


def _base(d: Spark) -> str:
    x = d.map("embedding", "c", "CAST(c AS DOUBLE)")
    return f"base AS (SELECT vec_id, label, {x} AS e FROM embeddings)"


def _shift(d: Spark, e: str = "e") -> str:
    """The vector turned by one place, as a second operand."""
    return d.concat(d.cut(e, "2", str(_WIDTH - 1)), d.cut(e, "1", "1"))


def _long(d: Spark, *steps: str, keep: str = "vec_id", out: str = "o") -> str:
    """The last step's array ``out``, a row for each value."""
    chain = ", ".join((_base(d), *steps))
    last = steps[-1].split(" AS ", 1)[0]
    return f"WITH {chain}, cells AS ({d.rows(last, out, keep)}) SELECT {keep}, pos, {_rounded('v')} AS v FROM cells"




def add_bias(d):
    return _long(d, f"made AS (SELECT vec_id, {d.mapi('e', 'x + (i % 7) * CAST(0.1 AS DOUBLE)')} AS o FROM base)")


def sum_rows(d):
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id')}) SELECT pos, round(sum(v), 6) + 0.0 AS total FROM cells GROUP BY pos"


def scale_add(d):
    return _long(d, f"t AS (SELECT vec_id, e, {_shift(d)} AS y FROM base)", f"made AS (SELECT vec_id, {d.map2('e', 'y', 'x * CAST(0.5 AS DOUBLE) + y')} AS o FROM t)")


def copy_block(d):
    return _long(d, f"made AS (SELECT vec_id, {d.concat(d.cut('e', '9', '16'), d.cut('e', '1', '8'))} AS o FROM base)")


def transpose(d):
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id')}) SELECT pos AS row_id, vec_id AS column_id, {_rounded('v')} AS v FROM cells"


_GAMMA = "(1 + (i % 5) * CAST(0.01 AS DOUBLE))"


def _norm_steps(d):
    return (
        f"means AS (SELECT vec_id, e, {d.hold(d.sum('e') + f' / {_WIDTH}')} AS mean FROM base)",
        f"centred AS (SELECT vec_id, e, {d.map('e', 'c', 'c - mean')} AS c FROM means)",
        f"spread AS (SELECT vec_id, e, c, {d.hold('1 / sqrt(' + d.sum(d.map('c', 'q', 'q * q')) + f' / {_WIDTH} + CAST(1e-5 AS DOUBLE))')} AS rs FROM centred)",
        f"normed AS (SELECT vec_id, e, rs, {d.map('c', 'q', 'q * rs')} AS xhat FROM spread)",
    )


def layernorm_fwd(d):
    return _long(d, *_norm_steps(d), f"made AS (SELECT vec_id, {d.mapi('xhat', f'x * {_GAMMA} + CAST(0.1 AS DOUBLE)')} AS o FROM normed)")


def layernorm_bwd(d):
    return _long(
        d,
        *_norm_steps(d),
        f"grads AS (SELECT vec_id, rs, xhat, {d.mapi(_shift(d), f'x * {_GAMMA}')} AS g FROM normed)",
        f"sums AS (SELECT vec_id, rs, xhat, g, {d.hold(d.sum('g') + f' / {_WIDTH}')} AS mg, {d.hold(d.sum(d.map2('g', 'xhat', 'x * y')) + f' / {_WIDTH}')} AS mgx FROM grads)",
        f"made AS (SELECT vec_id, {d.map2('g', 'xhat', 'rs * (x - mg - y * mgx)')} AS o FROM sums)",
    )


def _soft_steps(d, scale: str = "1"):
    return (
        f"scaled AS (SELECT vec_id, label, e, {d.map('e', 'c', f'c * {scale}')} AS z FROM base)",
        f"tops AS (SELECT vec_id, label, e, z, {d.hold(d.max('z'))} AS top FROM scaled)",
        f"exps AS (SELECT vec_id, label, e, z, top, {d.map('z', 'c', 'exp(c - top)')} AS ex FROM tops)",
        f"sums AS (SELECT vec_id, label, e, z, top, ex, {d.hold(d.sum('ex'))} AS total FROM exps)",
        f"probs AS (SELECT vec_id, label, e, z, top, total, {d.map('ex', 'c', 'c / total')} AS p FROM sums)",
    )


def softmax_fwd(d):
    return _long(d, *_soft_steps(d), "made AS (SELECT vec_id, p AS o FROM probs)")


def softmax_bwd(d):
    return _long(
        d,
        *_soft_steps(d),
        f"g AS (SELECT vec_id, p, {_shift(d)} AS dy FROM probs)",
        f"dots AS (SELECT vec_id, p, dy, {d.hold(d.sum(d.map2('p', 'dy', 'x * y')))} AS dot FROM g)",
        f"made AS (SELECT vec_id, {d.map2('p', 'dy', 'x * (y - dot)')} AS o FROM dots)",
    )


def temperature_softmax(d):
    return _long(d, *_soft_steps(d, "(1 / CAST(0.7 AS DOUBLE))"), "made AS (SELECT vec_id, p AS o FROM probs)")


_C, _A = "CAST(0.7978845608028654 AS DOUBLE)", "CAST(0.044715 AS DOUBLE)"


def gelu_fwd(d):
    return _long(d, f"made AS (SELECT vec_id, {d.map('e', 'c', f'CAST(0.5 AS DOUBLE) * c * (1 + tanh({_C} * (c + {_A} * c * c * c)))')} AS o FROM base)")


def gelu_bwd(d):
    t = f"tanh({_C} * (x + {_A} * x * x * x))"
    body = f"y * (CAST(0.5 AS DOUBLE) * (1 + {t}) + CAST(0.5 AS DOUBLE) * x * (1 - {t} * {t}) * {_C} * (1 + 3 * {_A} * x * x))"
    return _long(d, f"t AS (SELECT vec_id, e, {_shift(d)} AS dy FROM base)", f"made AS (SELECT vec_id, {d.map2('e', 'dy', body)} AS o FROM t)")


def _ce_steps(d):
    return (*_soft_steps(d), f"losses AS (SELECT vec_id, label, p, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE ln(total) + top - {d.at('e', 'label')} END AS loss FROM probs)")


def cross_entropy_fwd(d):
    """Rows whose id is divisible by nine stand for ignored targets."""
    return f"WITH {', '.join((_base(d), *_ce_steps(d)))} SELECT vec_id, label, round(loss, 6) AS loss FROM losses"


def cross_entropy_bwd(d):
    grad = f"CASE WHEN loss IS NULL THEN 0 ELSE (x - CASE WHEN i = label THEN 1 ELSE 0 END) / n END"
    steps = (*_ce_steps(d), "counted AS (SELECT CAST(count(loss) AS DOUBLE) AS n FROM losses)", "met AS (SELECT vec_id, label, p, loss, n FROM losses, counted)", f"made AS (SELECT vec_id, {d.mapi('p', grad)} AS o FROM met)")
    return _long(d, *steps)


def loss_mean(d):
    """The mean over batches of 32 rows, each weighted by its rows that count."""
    return f"WITH {', '.join((_base(d), *_ce_steps(d)))}, batches AS (SELECT floor(vec_id / 32) AS batch, avg(loss) AS loss, count(loss) AS n FROM losses GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS counted, round(coalesce(sum(loss * n) / nullif(sum(n), 0), 0), 6) AS mean_loss FROM batches"


def greedy_argmax(d):
    return f"WITH {_base(d)} SELECT vec_id, {d.find('e', d.max('e'))} AS token FROM base"


def topk_filter(d):
    """Logits of at least the tenth best; ties with it stay."""
    return f"WITH {_base(d)}, cuts AS (SELECT vec_id, e, {d.hold(d.at(d.sort('e'), str(_WIDTH - 10)))} AS cut FROM base), made AS (SELECT vec_id, {d.mapi('e', f'CASE WHEN x >= cut THEN i ELSE -1 END')} AS o FROM cuts), cells AS ({d.rows('made', 'o', 'vec_id')}) SELECT vec_id, pos AS token FROM cells WHERE v >= 0"


def categorical_pick(d):
    """The first token whose running sum exceeds u, with u from the row's id."""
    u = "((vec_id * 7919 + 13) % 10007) / CAST(10007 AS DOUBLE)"
    steps = (*_soft_steps(d), f"u AS (SELECT vec_id, p, {u} AS u FROM probs)")
    cells = d.rows("u", "p", "vec_id, u")
    return f"WITH {', '.join((_base(d), *steps))}, cells AS ({cells}), run AS (SELECT vec_id, u, pos, sum(v) OVER (PARTITION BY vec_id ORDER BY pos) AS cdf FROM cells) SELECT vec_id, CAST(coalesce(min(CASE WHEN u < cdf THEN pos END), {_WIDTH - 1}) AS INT) AS token FROM run GROUP BY vec_id"


def _history(d):
    return d.array("label", "label + 3", "label", "label + 5", "label + 3", "label")


def repetition_penalty(d):
    body = f"CASE WHEN {d.has('h', 'i')} THEN CASE WHEN x < 0 THEN x * CAST(1.3 AS DOUBLE) ELSE x / CAST(1.3 AS DOUBLE) END ELSE x END"
    if d.name == "spark":
        body = body.replace("array_contains(h, i)", "array_contains(h, CAST(i AS INT))")
    return _long(d, f"hist AS (SELECT vec_id, e, {d.hold(_history(d))} AS h FROM base)", f"made AS (SELECT vec_id, {d.mapi('e', body)} AS o FROM hist)")


def no_repeat_ngram(d):
    """Tokens that would repeat a bigram of the history, which ends in the label, are banned."""
    starts = d.filter(d.seq(5), "k", f"{d.at('h', 'k')} = {d.at('h', '5')}")
    banned = d.map(starts, "k", d.at("h", "k + 1"))
    steps = f"hist AS (SELECT vec_id, {d.hold(_history(d))} AS h FROM base), bans AS (SELECT vec_id, {banned} AS b FROM hist), cells AS ({d.rows('bans', 'b', 'vec_id')})"
    return f"WITH {_base(d)}, {steps} SELECT DISTINCT vec_id, CAST(v AS INT) AS banned FROM cells"


def matmul_nn(d):
    weight = f"((k * 8 + j) % 11 - 5) * CAST(0.1 AS DOUBLE)"
    inner = d.sum(d.map(d.seq(_WIDTH), "k", f"{d.at('e', 'k')} * {weight}"))
    return _long(d, f"made AS (SELECT vec_id, {d.map(d.seq(8), 'j', inner)} AS o FROM base)")


def matmul_nt(d):
    """Rows times the mean row of each label: a join on the inner place."""
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id, label')}), means AS (SELECT label AS other, pos, avg(v) AS m FROM cells GROUP BY label, pos) SELECT vec_id, other, round(sum(v * m), 6) + 0.0 AS v FROM cells JOIN means USING (pos) GROUP BY vec_id, other"


def matmul_tn(d):
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id')}) SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM cells a JOIN cells b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos"


def _heads(d):
    """Eight heads of eight columns: a row for each row and head."""
    if d.name == "spark":
        return "heads AS (SELECT vec_id, label, head, slice(e, head * 8 + 1, 8) AS q FROM base LATERAL VIEW explode(sequence(0, 7)) AS head)"
    return "heads AS (SELECT vec_id, label, CAST(head AS INT) AS head, list_slice(e, head * 8 + 1, head * 8 + 8) AS q FROM base, (SELECT unnest(range(0, 8)) AS head))"


def pack_heads(d):
    return f"WITH {_base(d)}, {_heads(d)}, cells AS ({d.rows('heads', 'q', 'vec_id, head')}) SELECT vec_id, head, pos, {_rounded('v')} AS v FROM cells"


def batched_matmul(d):
    """The transposed product with itself of each slot, a label and head."""
    return f"WITH {_base(d)}, {_heads(d)}, cells AS ({d.rows('heads', 'q', 'vec_id, label, head')}) SELECT a.label AS slot, a.head AS head, a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.head = b.head GROUP BY a.label, a.head, a.pos, b.pos"


def batched_matmul_nt(d):
    """Scores of each slot, a sequence of sixteen rows and a head: rows times the transposed rows."""
    return f"WITH {_base(d)}, {_heads(d)}, slots AS (SELECT vec_id, head, q, CAST(floor(vec_id / 16) AS BIGINT) AS seq FROM heads) SELECT a.vec_id AS vec_id, b.vec_id AS other, a.head AS head, round({d.sum(d.map2('a.q', 'b.q', 'x * y'))}, 6) + 0.0 AS v FROM slots a JOIN slots b ON a.seq = b.seq AND a.head = b.head"


def batched_matmul_nn(d):
    """The rows of each head times that head's matrix of eight by eight."""
    inner = d.sum(d.mapi("q", "x * ((i * 8 + j + head) % 5 - 2) * CAST(0.1 AS DOUBLE)"))
    return f"WITH {_base(d)}, {_heads(d)}, made AS (SELECT vec_id, head, {d.map(d.seq(8), 'j', inner)} AS o FROM heads), cells AS ({d.rows('made', 'o', 'vec_id, head')}) SELECT vec_id, head, pos, {_rounded('v')} AS v FROM cells"


def unpack_heads(d):
    """Heads back in the columns that they were taken from."""
    return f"WITH {_base(d)}, {_heads(d)}, cells AS ({d.rows('heads', 'q', 'vec_id, head')}) SELECT vec_id, CAST(head * 8 + pos AS INT) AS pos, {_rounded('v')} AS v FROM cells"


def pack_qkv_heads(d):
    """Three parts of two heads of eight columns: slots for queries, keys and values from one row."""
    part, head = "CAST(floor(pos / 16) AS INT)", "CAST(floor(pos % 16 / 8) AS INT)"
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id')}) SELECT vec_id, {part} AS part, {head} AS head, CAST(pos % 8 AS INT) AS place, {_rounded('v')} AS v FROM cells WHERE pos < 48"


def layernorm_bwd_params(d):
    """What the scale and the shift of a layer norm gather from all rows."""
    steps = (*_norm_steps(d), f"grads AS (SELECT vec_id, xhat, {_shift(d)} AS g FROM normed)", f"prods AS (SELECT vec_id, g, {d.map2('g', 'xhat', 'x * y')} AS w FROM grads)")
    cells = f"w AS ({d.rows('prods', 'w', 'vec_id')}), b AS ({d.rows('prods', 'g', 'vec_id')}), dw AS (SELECT pos, sum(v) AS v FROM w GROUP BY pos), db AS (SELECT pos, sum(v) AS v FROM b GROUP BY pos)"
    return f"WITH {', '.join((_base(d), *steps))}, {cells} SELECT dw.pos AS pos, round(dw.v, 6) + 0.0 AS dw, round(db.v, 6) + 0.0 AS db FROM dw JOIN db ON dw.pos = db.pos"


def scaled_softmax_bwd(d):
    """The gradient through a softmax of scaled values: the scale comes back as a factor."""
    scale = "CAST(0.125 AS DOUBLE)"
    return _long(
        d,
        *_soft_steps(d, scale),
        f"grads AS (SELECT vec_id, p, {_shift(d)} AS g FROM probs)",
        f"dots AS (SELECT vec_id, p, g, {d.hold(d.sum(d.map2('p', 'g', 'x * y')))} AS dot FROM grads)",
        f"made AS (SELECT vec_id, {d.map2('p', 'g', f'{scale} * x * (y - dot)')} AS o FROM dots)",
    )


def adamw_step_two(d):
    """The second step, from the moments of the first: both are corrected for their start from zero."""
    one, two, rate = "CAST(0.9 AS DOUBLE)", "CAST(0.95 AS DOUBLE)", "CAST(0.001 AS DOUBLE)"
    after = f"x - {rate} * CAST(0.1 AS DOUBLE) * x - {rate} * y / (sqrt(y * y) + CAST(1e-8 AS DOUBLE))"
    mean = f"(({one} * (1 - {one}) * y + (1 - {one}) * x) / (1 - {one} * {one}))"
    square = f"(({two} * (1 - {two}) * y * y + (1 - {two}) * x * x) / (1 - {two} * {two}))"
    return _long(
        d,
        f"t AS (SELECT vec_id, e, {_shift(d)} AS g FROM base)",
        f"first AS (SELECT vec_id, e, g, {d.map2('e', 'g', after)} AS w FROM t)",
        # the second gradient is the row itself, the first the turned one
        f"moved AS (SELECT vec_id, w, {d.map2('e', 'g', f'{mean} / (sqrt({square}) + CAST(1e-8 AS DOUBLE))')} AS u FROM first)",
        f"made AS (SELECT vec_id, {d.map2('w', 'u', f'x - {rate} * CAST(0.1 AS DOUBLE) * x - {rate} * y')} AS o FROM moved)",
    )


def causal_attention(d):
    """Sequences of sixteen rows; a row sees itself and those before it."""
    steps = (
        f"seqs AS (SELECT vec_id, CAST(floor(vec_id / 16) AS BIGINT) AS seq, e FROM base)",
        f"scores AS (SELECT q.vec_id AS vec_id, k.vec_id AS other, k.e AS e, {d.sum(d.map2('q.e', 'k.e', 'x * y'))} / 8 AS s FROM seqs q JOIN seqs k ON q.seq = k.seq AND k.vec_id <= q.vec_id)",
        "tops AS (SELECT vec_id, other, e, exp(s - max(s) OVER (PARTITION BY vec_id)) AS w FROM scores)",
        "shares AS (SELECT vec_id, other, e, w / sum(w) OVER (PARTITION BY vec_id) AS w FROM tops)",
    )
    cells = d.rows("shares", "e", "vec_id, w")
    return f"WITH {', '.join((_base(d), *steps))}, cells AS ({cells}) SELECT vec_id, pos, round(sum(w * v), 6) + 0.0 AS v FROM cells GROUP BY vec_id, pos"


def embedding_gather(d):
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id, label')}), lookup AS (SELECT label, pos, round(avg(v), 6) + 0.0 AS w FROM cells GROUP BY label, pos) SELECT b.vec_id AS vec_id, l.pos AS pos, l.w AS v FROM base b JOIN lookup l ON b.label = l.label"


def embedding_scatter_add(d):
    return f"WITH {_base(d)}, cells AS ({d.rows('base', 'e', 'vec_id, label')}) SELECT label, pos, round(sum(v), 6) + 0.0 AS v FROM cells GROUP BY label, pos"


def grad_norm_clip(d):
    """The norm over all rows, scaled by the greatest value so that squares can't overflow; clipped to 1."""
    peak = d.max(d.map("e", "c", "abs(c)"))
    steps = (f"peaks AS (SELECT max({peak}) AS top FROM base)", f"squares AS (SELECT sum({d.sum(d.map('e', 'c', '(c / top) * (c / top)'))}) AS s, max(top) AS top FROM base, peaks)", "norms AS (SELECT top * sqrt(s) AS norm FROM squares)")
    met = f"made AS (SELECT vec_id, {d.map('e', 'c', 'c * least(1, 1 / norm)')} AS o FROM base, norms)"
    return _long(d, *steps, met)


def adamw_step(d):
    """The first step from zero moments, rate 0.001, decay 0.1."""
    body = "x - CAST(0.001 AS DOUBLE) * CAST(0.1 AS DOUBLE) * x - CAST(0.001 AS DOUBLE) * (CAST(0.1 AS DOUBLE) * y / CAST(0.1 AS DOUBLE)) / (sqrt(CAST(0.05 AS DOUBLE) * y * y / CAST(0.05 AS DOUBLE)) + CAST(1e-8 AS DOUBLE))"
    return _long(d, f"t AS (SELECT vec_id, e, {_shift(d)} AS g FROM base)", f"made AS (SELECT vec_id, {d.map2('e', 'g', body)} AS o FROM t)")


_ALL: tuple[Callable, ...] = (
    add_bias, sum_rows, scale_add, copy_block, transpose, layernorm_fwd, layernorm_bwd, softmax_fwd, softmax_bwd, temperature_softmax,
    gelu_fwd, gelu_bwd, cross_entropy_fwd, cross_entropy_bwd, loss_mean, greedy_argmax, topk_filter, categorical_pick, repetition_penalty,
    no_repeat_ngram, matmul_nn, matmul_nt, matmul_tn, pack_heads, batched_matmul, causal_attention, embedding_gather, embedding_scatter_add,
    grad_norm_clip, adamw_step, adamw_step_two, batched_matmul_nt, batched_matmul_nn, unpack_heads, pack_qkv_heads, layernorm_bwd_params,
    scaled_softmax_bwd,
)


def _query(build: Callable) -> Callable:
    def query(spark, sf_dir: str):
        text = build(Spark()).replace("FROM embeddings)", "FROM {embeddings})")
        return spark.sql(text, embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

    query.__doc__ = build.__doc__
    return query


QUERIES = {build.__name__: _query(build) for build in _ALL}
ORACLE_SQL = {build.__name__: build(Duck()) for build in _ALL}
