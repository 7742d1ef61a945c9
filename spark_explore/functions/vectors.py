"""Vector expressions over array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double, summed in array order."""
    return F.aggregate(
        F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    A lambda variable is a bound value; a plain column may be inlined at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; null for the zero vector, which has no direction."""
    return let(
        as_doubles(vec),
        lambda v: let(l2_norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))),
    )


def mean_vector(vec: str, dim: int) -> Column:
    """Aggregate: mean of a ``dim``-wide array column.

    One partial average per position, so a hot group is reduced before the shuffle.
    """
    return F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dim)])
