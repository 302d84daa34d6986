"""Column expressions on numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars per million tokens, (model, in, out).
PRICES = [
    ("text-embedding-005", 0.025, 0.0),
    ("text-embedding-004", 0.025, 0.0),
    ("gemini-2.5-flash", 0.075, 0.30),
    ("gemini-2.5-pro", 1.25, 5.00),
    ("mock-embedder", 0.0, 0.0),
    ("mock-generator", 0.0, 0.0),
]
Z = 1.96


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(tokens_in, F.lit(0)) / 1e6 * F.coalesce(rate_in, zero) + F.coalesce(tokens_out, F.lit(0)) / 1e6 * F.coalesce(rate_out, zero)


def noise_floor(p: Column, n: Column) -> Column:
    """Half the width of the 95 % interval of a rate; 1 where there is no sample."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.when(n <= 0, F.lit(1.0)).otherwise(Z * F.sqrt(q * (1 - q) / n))


def number(name: str) -> Column:
    """A text column as a number; blank, None and what isn't one become null."""
    return F.expr(f"try_cast(nullif(nullif(trim(`{name}`), ''), 'None') as double)")
