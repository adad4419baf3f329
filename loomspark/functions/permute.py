"""A keyed permutation of 0 to n - 1 that each row computes for itself.

Numbers are taken as pairs of a grid that is at most one row larger than n.
Rounds add a keyed square of one half to the other, so every round can be undone;
a number that leaves the range goes round again until it is back in it.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
_M = (1 << 31) - 1


def _keys(seed: int) -> list[int]:
    keys, k = [], seed % _M
    for _ in range(ROUNDS):
        k = (k * 48271 + 11) % _M
        keys.append(k)
    return keys


def _grid(n: int) -> tuple[int, int]:
    a = isqrt(n - 1) + 1
    return a, -(-n // a)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _step(x: Column, n: int, seed: int) -> Column:
    a, b = _grid(n)
    keys = _keys(seed)
    pairs = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in zip(keys[::2], keys[1::2], strict=True)))

    def hashed(v: Column, k: Column) -> Column:
        return (v * 69621 + k) % _M * ((v * 69621 + k) % _M) % _M

    def two(s: Column, k: Column) -> Column:
        return _let((s["l"] + hashed(s["r"], k["i"])) % a, lambda left: F.struct(left.alias("l"), ((s["r"] + hashed(left, k["j"])) % b).alias("r")))

    start = F.struct((x % a).cast("long").alias("l"), F.call_function("div", x, F.lit(a).cast("long")).alias("r"))
    return F.aggregate(pairs, start, two, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of ``x`` (a long of 0 to n - 1); every place is taken once. Fails outside the range."""
    if n < 2:
        return x
    x = F.when((x >= 0) & (x < n), x).otherwise(F.raise_error(F.lit(f"a number outside 0 to {n - 1}")).cast("long"))
    lost = F.raise_error(F.lit("no way back into the range")).cast("long")

    def back(once: Column) -> Column:
        # few leave the range: less than 1 in sqrt(n), and at each turn again
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda y, _: F.when(y < n, y).otherwise(_step(y, n, seed)))
        return F.when(once < n, once).otherwise(_let(walk, lambda y: F.when(y < n, y).otherwise(lost)))

    return _let(_step(x, n, seed), back)


def permuted_sql(source: str, n: str, seed: int) -> str:
    """(x, place) of the numbers x of ``source``; ``n`` is SQL for how many there are."""

    def step(rows: str) -> str:
        q = f"SELECT x, n, a, b, y % a AS l, y // a AS r FROM {rows}"
        for i, k in enumerate(_keys(seed)):
            own, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
            h = f"({other} * 69621 + {k}) % {_M}"
            q = f"SELECT x, n, a, b, {other}, ({own} + ({h}) * ({h}) % {_M}) % {size} AS {own} FROM ({q})"
        return f"SELECT x, n, a, b, r * a + l AS y FROM ({q})"

    grid = f"(SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT {n} AS n, ceil(sqrt(({n})::DOUBLE))::BIGINT AS a))"
    return f"""(WITH RECURSIVE walk AS ({step(f'(SELECT x, n, a, b, x AS y FROM {source}, {grid})')} UNION ALL {step('(SELECT * FROM walk WHERE y >= n)')})
  SELECT x, y AS place FROM walk WHERE y < n)"""
