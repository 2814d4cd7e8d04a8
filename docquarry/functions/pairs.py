"""Sets of character pairs as bits, so that two texts are compared by a few machine words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
WORDS = -(-(len(LETTERS) ** 2) // 64)
#: Characters that are looked at together, unless one text has more; and texts.
CHARS, TEXTS = 1 << 20, 1 << 10


def _bits(texts: pa.Array) -> pa.Array:
    """For each text of ``LETTERS`` a set bit for each pair of neighbours in it; null for null."""
    code = np.zeros(256, np.int32)
    code[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))
    plain = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
    out, a = np.zeros((len(plain), WORDS), np.int64), 0
    while a < len(plain):
        b = max(a + 1, min(a + TEXTS, int(np.searchsorted(ends, ends[a] + CHARS, "right")) - 1))
        at = code[data[ends[a] : ends[b]]]
        row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[a : b + 1]))
        inside = row[1:] == row[:-1]
        held = np.zeros((b - a, 64 * WORDS), bool)
        held[row[1:][inside], (at[:-1] * len(LETTERS) + at[1:])[inside]] = True
        out[a:b] = np.packbits(held, axis=1, bitorder="little").view("<i8")
        a = b
    offsets = pa.array(np.arange(len(plain) + 1, dtype=np.int32) * WORDS)
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=texts.is_null())


@F.arrow_udf(ArrayType(LongType()))
def pair_bits(texts: pa.Array) -> pa.Array:
    return _bits(texts)


def count_bits(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, w: n + F.bit_count(w))


def shared_bits(a: Column, b: Column) -> Column:
    """How many bits both have; spelt out, so that it compiles to one line of code for each word."""
    return sum((F.bit_count(a[i].bitwiseAND(b[i])) for i in range(WORDS)), F.lit(0))


def dice(query: Column, content: Column, query_pairs: Column, content_pairs: Column, shared: Column) -> Column:
    """``text.dice`` of texts of ``LETTERS`` by the numbers of their pairs and of those they share.
    A text within another has all its pairs there, so only then it is looked for. Null if either is
    null and neither is empty."""
    n = query_pairs + content_pairs
    return (
        F.when((query == "") | (content == ""), 0.0)
        .when((shared == query_pairs) & F.contains(content, query), 1.0)
        .when(n == 0, 0.0)  # two different characters
        .otherwise(2.0 * shared / n)
    )
