"""Deterministic noise from row ids, the same in any SQL engine.

``normal`` and ``uniform`` mix an id through three rounds of quadratic congruences modulo 2**31 - 1,
one round to a column, so that no product leaves 64 bits. For real use, pass a table of better noise:
every random operator takes its noise as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647
#: Fixed values of the rounds: factor and offset of the start, then the factors of three rounds.
P, Q = (48271, 11, 16807, 39373, 48271), (69621, 1000003, 40014, 40692, 69621)


def _rounds(df: DataFrame, id_col: str, name: str, c: tuple[int, ...]) -> DataFrame:
    x = (F.col(id_col) * c[0] + c[1]) % MODULUS
    df = df.withColumn(name, x.cast("long"))
    for k in c[2:]:
        df = df.withColumn(name, ((F.col(name) * F.col(name) + F.col(name) * k) % MODULUS).cast("long"))
    return df


def with_noise(df: DataFrame, id_col: str, *, uniform: str | None = None, normal: str | None = None) -> DataFrame:
    """``df`` with a uniform column in (0, 1), a standard normal one, or both, by ``id_col``."""
    df = _rounds(df, id_col, "__p", P)
    u = (F.col("__p") + 0.5) / MODULUS
    if normal:
        df = _rounds(df, id_col, "__q", Q)
        df = df.withColumn(normal, F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * (F.col("__q") + 0.5) / MODULUS))
    if uniform:
        df = df.withColumn(uniform, u)
    return df.drop("__p", "__q")


def noise_sql(source: str, id_expr: str, carry: str) -> str:
    """The same as SQL: a query with the columns ``carry``, ``u`` and ``z`` over ``source``."""

    def step(x: str, k: int) -> str:
        return f"({x}*{x} + {x}*{k}) % {MODULUS}"

    sql = f"SELECT {carry}, ({id_expr}*{P[0]}+{P[1]}) % {MODULUS} AS p, ({id_expr}*{Q[0]}+{Q[1]}) % {MODULUS} AS q FROM {source}"
    for a, b in zip(P[2:], Q[2:], strict=True):
        sql = f"SELECT {carry}, {step('p', a)} AS p, {step('q', b)} AS q FROM ({sql})"
    u, v = f"((p+0.5)/{MODULUS})", f"((q+0.5)/{MODULUS})"
    return f"SELECT {carry}, {u} AS u, sqrt(-2*ln({u}))*cos(2*pi()*{v}) AS z FROM ({sql})"
