"""Byte-pair encoding as string expressions: one character stands for one token.

Ids 0-255 are the characters of the Latin-1 view of the UTF-8 bytes, merge k is the character of its id
256 + k. Encoding then replaces pair after pair, leftmost first, in the order of the merges, which Catalyst
compiles into one expression. It suits tables of up to a few hundred merges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The merges that the catalogue's queries encode with, as pairs of ids.
MERGES = (
    (116, 104), (101, 32), (101, 114), (101, 110), (111, 110), (105, 110), (97, 110), (32, 256), (195, 169), (32, 101),
    (101, 97), (114, 101), (116, 105), (265, 32), (97, 116), (115, 116), (111, 117), (101, 100), (110, 100), (258, 32),
    (256, 258), (105, 260), (268, 260), (110, 116), (115, 104), (108, 121), (104, 97), (44, 32), (46, 32), (98, 108),
    (99, 104), (117, 120), (100, 101), (108, 97), (257, 256), (115, 32), (259, 32), (97, 105), (101, 115), (195, 168),
)


def token_char(token: int) -> str:
    """The character of a token id; surrogates are skipped."""
    return chr(token if token < 0xD800 else token + 0x800)


def byte_chars(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def encode_chars(text: Column, merges=MERGES) -> Column:
    """Tokens of the text, one character each."""
    step = lambda s, k: F.replace(s, F.lit(token_char(merges[k][0]) + token_char(merges[k][1])), F.lit(token_char(256 + k)))
    return reduce(step, range(len(merges)), byte_chars(text))


def char_ids(chars: Column) -> Column:
    """Ids of characters of tokens; none for the empty string."""
    code = lambda c: F.when(F.ascii(c) >= 0xE000, F.ascii(c) - 0x800).otherwise(F.ascii(c))
    return F.when(chars == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(chars, ""), code))


def decode_chars(chars: Column, merges=MERGES) -> Column:
    """The text of tokens: the last merge is undone first."""
    step = lambda s, k: F.replace(s, F.lit(token_char(256 + k)), F.lit(token_char(merges[k][0]) + token_char(merges[k][1])))
    plain = reduce(step, reversed(range(len(merges))), chars)
    return F.decode(F.encode(plain, "ISO-8859-1"), "UTF-8")


def vocabulary(merges=MERGES) -> list[bytes]:
    """The bytes of each id; the last, empty, is the end of a document."""
    out = [bytes([b]) for b in range(256)]
    for left, right in merges:
        if not (0 <= left < len(out) and 0 <= right < len(out)):
            raise ValueError(f"merge ({left}, {right}) names an unknown id")
        out.append(out[left] + out[right])
    return [*out, b""]
