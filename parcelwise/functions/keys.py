"""Null-safe composite keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NULL_MARK = "\u0000"
_SEPARATOR = "\u0001"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(*parts: str | Column) -> Column:
    """One string per composite key in which NULL equals NULL and differs from ''."""
    return F.concat_ws(
        _SEPARATOR, *[F.coalesce(_col(p).cast("string"), F.lit(_NULL_MARK)) for p in parts]
    )


def key_id(*parts: str | Column) -> Column:
    """64-bit id of a composite key; NULL parts are marked so (NULL, 1) <> (1, NULL)."""
    return F.xxhash64(*[F.coalesce(_col(p).cast("string"), F.lit(_NULL_MARK)) for p in parts])


def all_of(conditions: Iterable[Column]) -> Column:
    """AND of the given conditions; TRUE when there are none."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row however often ``use`` reads it.

    Conditional branches are not covered by common-subexpression elimination, so a ladder of
    tests on a folded text would otherwise fold the text again for every test.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed_map(mapping: dict) -> Column:
    """A literal map column from a small driver-side table."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)
