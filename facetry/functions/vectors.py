"""Vector columns (``array<float>``) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(vector: Column, width: int | None = None) -> Column:
    """Present, of the expected width and free of NaN and nulls. Infinities pass."""
    ok = vector.isNotNull() & ~F.exists(vector, lambda x: F.isnan(x) | x.isNull())
    if width is not None:
        ok = ok & (F.size(vector) == width)
    return F.coalesce(ok, F.lit(False))


def nonzero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def all_near_zero(vector: Column, tolerance: float = 1e-8) -> Column:
    return F.forall(vector, lambda x: F.abs(x) <= tolerance)


def trim(vector: Column, mask_size: int) -> Column:
    """First ``mask_size`` entries."""
    return F.slice(vector, 1, mask_size)


def blocks(vector: Column, names: list[str], width: int) -> Column:
    """Cut a vector of ``width`` entries into equal named blocks."""
    if width % len(names):
        raise ValueError(f"width {width} is not divisible into {len(names)} blocks")
    step = width // len(names)
    return F.struct(*[F.slice(vector, i * step + 1, step).alias(n) for i, n in enumerate(names)])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(1e-12))
    return F.transform(vector, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def contrastive_term(cosines: Column, temperature: float = 0.1) -> Column:
    """``log(1 + sum exp(cos / t))`` over an array of anchor-negative cosines.

    The constant 1 stands for the positive pair. The sum is shifted by its largest
    exponent, so small temperatures do not overflow.
    """
    scaled = F.transform(cosines, lambda c: c / F.lit(temperature))
    top = F.greatest(F.array_max(scaled), F.lit(0.0))
    total = F.aggregate(scaled, F.exp(-top), lambda s, x: s + F.exp(x - top))
    return top + F.log(total)


def cross_entropy(logits: Column, target: Column) -> Column:
    """``logsumexp(logits) - logits[target]`` for a 0-based target."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, target.cast("int") + 1)


def best_classes(logits: Column, k: int) -> Column:
    """0-based indices of the ``k`` largest logits, best first, low index on ties."""
    ranked = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["idx"])
