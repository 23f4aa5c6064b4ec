"""A repeatable Bernoulli draw per session.

``RAND()`` gives a different draw when a task is retried on another executor
or the input arrives in another order, so a lost executor could change which
rows are kept.  Instead the draw is a pure function of the session key and a
seed: the first 32 bits of ``md5(key || ':' || seed)`` compared with
``p * 2^32``.  It is stable under retries, needs no shuffle, and the same
expression runs in any SQL engine with ``md5``, so the oracle can check it.

The key is never NULL: a missing visitor is the text ``?``, and visit, start
time and shard tell such sessions apart.  (The published session id stays
NULL for them.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import c


def draw_key() -> Column:
    """A session's key for the draw, never NULL."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("?"))
             for n in ("fullVisitorId", "visitId", "visitStartTime", "date")]
    return F.concat_ws("-", *parts)


def row_key(key: str, columns: list[str]) -> Column:
    """``key``, or where it is NULL a digest of the whole row."""
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{x}`") for x in columns])))
    return F.coalesce(F.col(key), F.concat(F.lit("?"), whole))


def hash_hex8(key: Column, seed: int | None) -> Column:
    text = key if seed is None else F.concat(key, F.lit(f":{seed}"))
    return F.substring(F.md5(text), 1, 8)


def threshold_hex(p: float) -> str:
    """p as an 8-digit lowercase hex fraction of 2^32."""
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"sampling rate must be in [0, 1], got {p}")
    return format(min(int(round(p * 2 ** 32)), 2 ** 32 - 1), "08x") if p < 1 else "g"


def draw(p: float, seed: int | None = 42, key: Column | None = None) -> Column:
    """True for about a fraction ``p`` of sessions, always the same ones."""
    key = draw_key() if key is None else key
    return hash_hex8(key, seed) < F.lit(threshold_hex(p))


def keep_positives(p: float, seed: int | None = 42, key: Column | None = None,
                   transactions: str | Column = "totals.transactions") -> Column:
    """``transactions IS NOT NULL OR RAND() < p`` with a repeatable draw."""
    return c(transactions).isNotNull() | draw(p, seed, key)


def in_eval_split(fraction: float, seed: int | None = 7, key: Column | None = None) -> Column:
    """Row belongs to the evaluation part of a random train / eval split."""
    return draw(fraction, seed, key)
