"""Missing-aware metrics on array columns, and the registry of metrics (U1). A coordinate counts where both values are present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column) -> Column:
    return F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _sum(pairs: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p).cast("double"))


def _zip(a: str, b: str) -> tuple[Column, Callable, Callable]:
    z = F.zip_with(F.col(a), F.col(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.filter(z, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), (lambda p: p["x"]), (lambda p: p["y"])


def euclidean(a: str, b: str) -> Column:
    """root of (n * squared differences / valid); NULL where nothing is comparable."""
    p, x, y = _zip(a, b)
    return F.sqrt(F.try_divide(F.size(F.col(a)) * _sum(p, lambda v: (x(v) - y(v)) * (x(v) - y(v))), F.size(p).cast("double")))


def mean_square(a: str, b: str) -> Column:
    """F6 without root and length."""
    p, x, y = _zip(a, b)
    return F.try_divide(_sum(p, lambda v: (x(v) - y(v)) * (x(v) - y(v))), F.size(p).cast("double"))


def manhattan(a: str, b: str) -> Column:
    """n * mean absolute difference."""
    p, x, y = _zip(a, b)
    return F.try_divide(F.size(F.col(a)) * _sum(p, lambda v: F.abs(x(v) - y(v))), F.size(p).cast("double"))


def cosine(a: str, b: str) -> Column:
    """F8: cosine similarity; norms start at 1e-100."""
    p, x, y = _zip(a, b)
    return _sum(p, lambda v: x(v) * y(v)) / F.sqrt((F.lit(1e-100) + _sum(p, lambda v: x(v) * x(v))) * (F.lit(1e-100) + _sum(p, lambda v: y(v) * y(v))))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; NULL where a side is constant."""
    p, x, y = _zip(a, b)

    def centred(q: Column) -> Column:
        n = F.size(q).cast("double")
        return F.struct(q.alias("pairs"), F.try_divide(_sum(q, x), n).alias("mx"), F.try_divide(_sum(q, y), n).alias("my"))

    def value(c: Column) -> Column:
        dot = lambda f, g: F.aggregate(c["pairs"], F.lit(0.0), lambda s, v: s + f(v) * g(v))
        dx, dy = (lambda v: x(v) - c["mx"]), (lambda v: y(v) - c["my"])
        return F.try_divide(dot(dx, dy), F.sqrt(dot(dx, dx) * dot(dy, dy)))

    # arrays of one element bind what is computed once: the pairs, then their means
    return F.transform(F.transform(F.array(p), centred), value)[0]


def arctanh(x: Column) -> Column:
    """of a value clamped to +-0.99."""
    return F.when(x.isNotNull(), F.atanh(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), x))))


#: Metrics by name; add to it to extend.
METRICS: dict[str, Callable[[str, str], Column]] = {"euclidean": euclidean, "mean_square": mean_square, "manhattan": manhattan, "cosine": cosine, "correlation": correlation}


def divide_by_count(a: Column, n: Column) -> Column:
    """a vector over max(n, 1)."""
    return F.transform(a, lambda x: x / F.greatest(n, F.lit(1)))


def array_stats(a: Column) -> dict[str, Column]:
    """Share of missing values, maximum, mean, and mean and deviation (by n) of values in (1e-10, 0.9 * float maximum)."""
    present = F.filter(a, lambda x: x.isNotNull())
    real = F.filter(a, lambda x: x.isNotNull() & (x > 1e-10) & (x < 0.9 * 3.4028234663852886e38))
    n = F.size(real).cast("double")
    mean = F.try_divide(F.aggregate(real, F.lit(0.0), lambda s, x: s + x), n)
    return {
        "missing": F.lit(1.0) - F.size(present) / F.size(a), "maximum": F.array_max(present),
        "mean": F.try_divide(F.aggregate(present, F.lit(0.0), lambda s, x: s + x), F.size(present).cast("double")),
        "mean_real": mean, "sd_real": F.sqrt(F.try_divide(F.aggregate(real, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n)),
    }
