"""Query registry: name -> (DataFrame builder, comparison SQL or None)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def out(df: DataFrame, *columns) -> DataFrame:
    """Result columns; doubles rounded to six places so that engines can be compared."""
    picked = df.select(*columns)
    shown = []
    for name, kind in picked.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        shown.append(c.alias(name))
    return picked.select(*shown)
