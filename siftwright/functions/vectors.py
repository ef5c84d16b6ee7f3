"""Vector and hash expressions: cosine, norms, Hamming distance of hex hashes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), F.lit(0.0)))


def is_hash(h: Column) -> Column:
    """True for a hex hash of 64 digits."""
    return F.coalesce(h.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def _word(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")


def differing_bits(a: Column, b: Column | str) -> Column:
    """Differing bits of two texts that are hashes; each of the eight words of a column is told once, and those of a constant
    before the query runs."""
    other = (lambda i: F.lit(int(b[8 * i : 8 * i + 8], 16))) if isinstance(b, str) else (lambda i: _word(b, i))
    return reduce(lambda x, y: x + y, (F.bit_count(_word(a, i).bitwiseXOR(other(i))) for i in range(HASH_BITS // 32)))


def hamming(a: Column, b: Column | str) -> Column:
    """Differing bits of two hex hashes of 64 digits, the second perhaps a constant; null where either is missing or not of
    that form."""
    if isinstance(b, str):
        return F.when(is_hash(a), differing_bits(a, b)) if re.fullmatch("[0-9a-fA-F]{64}", b) else F.lit(None).cast("int")
    return F.when(is_hash(a) & is_hash(b), differing_bits(a, b))


def hash_similarity(a: Column, b: Column | str) -> Column:
    """1 - Hamming distance / 256, to 4 places."""
    return F.round(1 - hamming(a, b) / HASH_BITS, 4)
