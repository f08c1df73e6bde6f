"""Numbers around training: random draws that can be resumed, sampling orders, rates and budgets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the PCG32 generator.
MULTIPLIER, INCREMENT = 6364136223846793005, 0xDA3E39CB94B95BDB
_M64, _M32 = 2**64 - 1, 2**32 - 1


class Pcg32:
    """A generator whose whole state is one integer."""

    def __init__(self, seed: int):
        self.state = 0
        self.u32()
        self.state = (self.state + (seed & _M32)) & _M64
        self.u32()

    def u32(self) -> int:
        old = self.state
        self.state = (old * MULTIPLIER + INCREMENT) & _M64
        x, turn = ((old >> 18 ^ old) >> 27) & _M32, old >> 59
        return (x >> turn | x << (-turn & 31)) & _M32

    def below(self, bound: int, bits: int = 64) -> int:
        """An unbiased integer from 0 to ``bound`` - 1, of draws of 32 or 64 bits."""
        if bound <= 0:
            raise ValueError("the bound must be positive")
        least = (1 << bits) % bound
        while True:
            value = self.u32() if bits == 32 else self.u32() << 32 | self.u32()
            if value >= least:
                return value % bound


@dataclass(frozen=True)
class Epoch:
    """A pass over all chunks in an order that needs no memory: (cursor * stride + start) mod chunks."""

    chunks: int
    start: int
    stride: int

    def order(self, cursor: Column) -> Column:
        index = (cursor.cast("decimal(38,0)") * F.lit(self.stride).cast("decimal(19,0)") + F.lit(self.start)) % F.lit(self.chunks)
        return index.cast("long")


def epochs(seed: int, chunks: int, count: int) -> list[Epoch]:
    """The first ``count`` epochs of a sampler."""
    if chunks < 1:
        raise ValueError("there aren't enough tokens for one chunk")
    random, out = Pcg32(seed), []
    for _ in range(count):
        start = stride = 0
        if chunks > 1:
            start = random.below(chunks)
            while math.gcd(stride := random.below(chunks - 1) + 1, chunks) != 1:
                pass
        out.append(Epoch(chunks, start, stride))
    return out


def learning_rate(step: Column, total: int, top: float, low: float, warmup: int) -> Column:
    """Linear warm-up, then half a cosine down to ``low``."""
    if total <= 0 or warmup < 0 or warmup >= total:
        raise ValueError("the steps must be positive, and the warm-up shorter than they are")
    t = (step - warmup) / F.lit(float(total - warmup))
    cosine = low + 0.5 * (top - low) * (1 + F.cos(F.pi() * t))
    return F.when(step < warmup, top * (step + 1) / F.lit(float(warmup or 1))).when(step >= total, F.lit(low)).otherwise(cosine)


def updates(tokens: int, tokens_per_update: int) -> int:
    if tokens <= 0:
        raise ValueError("the tokens must be positive")
    return -(-tokens // tokens_per_update)


def epoch_tokens(tokens: int, epochs_: float) -> int:
    return math.ceil((tokens - 1) * epochs_)


#: Name, context, width, layers, heads, batch, accumulation, tokens.
PRESETS = (
    ("98m", 512, 768, 12, 12, 4, 16, 1_024_000_000),
    ("220m", 1024, 1024, 16, 16, 1, 32, 4_400_000_000),
    ("320m", 1024, 1024, 24, 16, 1, 32, 6_400_000_000),
)
PRESET_VOCABULARY = 16257


def parameter_count(vocabulary: int, context: int, width: int, layers: int) -> int:
    return vocabulary * width + context * width + layers * (12 * width * width + 13 * width) + 2 * width
