"""Name → query and name → oracle SQL, filled by the ``query`` decorator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.session import configure, frozen, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PE = """select event_id,
  epoch_us(ts)/1000000.0 as ts_s,
  'process:' || user_id as src_key,
  case when event_type in ('view','click') then 'file:'
       when event_type = 'purchase' then 'network:'
       else 'process:' end || json_extract_string(props,'$.k') as dst_key,
  event_type, value as score,
  case when event_type='error' and value>60 then 1 else 0 end as label,
  cast(json_extract_string(props,'$.k') as int) as k,
  user_id from events"""


def pe(select: str, ctes: str = "") -> str:
    """Oracle SQL over the provenance events ``pe``."""
    return f"with recursive pe as materialized ({PE}){',' if ctes.strip() else ''}\n{ctes}\n{select}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise KeyError(name)
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            with stage(spark) as made:
                result = fn(spark, sf_dir)
                # a result that reads stage tables is stored before they go
                return frozen(result) if made.paths else result

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column: Column | str) -> Column:
    """Rounded for comparison across engines."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
