"""Random numbers that depend on keys and a seed only, by arithmetic that other engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 32)


def draw(seed: int, *keys: Column | str) -> Column:
    """Uniform number in [0, 1): the first 32 bits of the md5 of the keys and the seed, joined by bars."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / _SPAN


def draw_sql(seed: int, *keys: str) -> str:
    """The same in DuckDB; ``keys`` are SQL expressions."""
    text = " || '|' || ".join([f"cast({k} as varchar)" for k in keys] + [f"'{seed}'"])
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / {_SPAN})"
