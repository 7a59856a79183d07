"""Vector arithmetic on array columns, and weighted means of vectors in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Draws are whole numbers below this prime, so every product fits 64 bits.
PRIME = 2**31 - 1


def draw(*parts: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that looks random, from whole numbers, by arithmetic that any engine can follow."""
    x = F.lit(seed % PRIME).cast("long")
    for p in parts:
        x = (x * 1664525 + F.pmod(p.cast("long"), F.lit(PRIME)) * 1013904223 + 12345) % PRIME
        x = (x * (x + 48271)) % PRIME
    return (x + 0.5) / float(PRIME)


def draw_sql(*parts: str, seed: int = 0) -> str:
    """The same in SQL, for whole numbers from 0 on."""
    x = f"CAST({seed % PRIME} AS BIGINT)"
    for p in parts:
        x = f"(({x} * 1664525 + CAST({p} AS BIGINT) % {PRIME} * 1013904223 + 12345) % {PRIME})"
        x = f"(({x} * ({x} + 48271)) % {PRIME})"
    return f"(({x} + 0.5) / {float(PRIME)})"


def numbers(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as whole numbers to draw by; text by its checksum."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [F.crc32(F.col(c).cast("binary")) if c in text else F.col(c) for c in columns]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x * by)


def cosine(a: Column | str, b: Column | str, floor: float = 1e-10) -> Column:
    """Cosine with the product of the lengths held above `floor`."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def vector_mean(v: Column | str, weight: Column | None = None) -> Column:
    """Aggregate: mean of vectors, weighted if asked; rows of weight 0 are passed over."""
    vec = array_to_vector(col(v))
    return vector_to_array(Summarizer.mean(vec, weight) if weight is not None else Summarizer.mean(vec))


def relative_error(approx: Column | str, truth: Column | str, floor: float = 1e-10) -> Column:
    """Length of the difference over that of the truth; 0 where the truth is shorter than `floor`."""
    return F.when(norm(truth) < floor, F.lit(0.0)).otherwise(norm(minus(approx, truth)) / norm(truth))


def rotate(x: Column | str, pos: Column | str, dim: int, theta: float) -> Column:
    """Rotary position embedding: halves rotated by pos * theta^(-2i/dim)."""
    half, at = dim // 2, col(pos).cast("double")
    angle = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at * F.pow(F.lit(float(theta)), -2.0 * i / dim))
    a, b = F.slice(col(x), 1, half), F.slice(col(x), half + 1, half)
    turn = lambda p, q, sign: F.zip_with(F.zip_with(p, angle, lambda v, t: v * F.cos(t)), F.zip_with(q, angle, lambda v, t: sign * v * F.sin(t)), lambda s, t: s + t)
    return F.concat(turn(a, b, -1.0), turn(b, a, 1.0))


def vertex(z: Column | str) -> Column:
    """Nearest vertex of the cross-polytope: 2i, or 2i+1 where the largest coordinate is negative; the first of equals."""
    size = F.transform(col(z), F.abs)
    i = F.array_position(size, F.array_max(size)) - 1
    return (2 * i + (F.get(col(z), i.cast("int")) < 0).cast("long")).cast("long")


def vertex_scores(z: Column | str) -> Column:
    """Scores of all vertices: z and -z interleaved."""
    return F.flatten(F.transform(col(z), lambda x: F.array(x, -x)))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(a: Column | str) -> Column:
    """Stable softmax of an array."""
    share = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda s: F.transform(e, lambda y: y / s))
    return bound(col(a), lambda z: bound(F.array_max(z), lambda m: bound(F.transform(z, lambda x: F.exp(x - m)), share)))
