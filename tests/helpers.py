"""Small tables for tests."""

from pyspark.sql import functions as F

from metricloom import schemas


def make(spark, schema, rows):
    """Rows given as dicts; missing columns are NULL."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def observations(spark, rows, **common):
    full = []
    for i, r in enumerate(rows):
        base = {"report": "大定选配比例", "subject": "M", "grain": "week", "stat": "数量", "category": "数量",
                "source_order": 0, "row_ord": i, "fmt": "0"}
        full.append({**base, **common, **r})
    return make(spark, schemas.OBSERVATIONS, full)


def sheet(spark, grid, file="f", name="s"):
    """A list of rows as cells; None is a missing cell."""
    rows = []
    for r, line in enumerate(grid, 1):
        for c, v in enumerate(line, 1):
            if v is None:
                continue
            cell = {"file": file, "sheet": name, "row": r, "col": c, "fmt": "General", "hidden": False}
            if isinstance(v, bool):
                cell.update(kind="b", s=str(v))
            elif isinstance(v, (int, float)):
                cell.update(kind="n", d=float(v))
            elif isinstance(v, str):
                cell.update(kind="s", s=v)
            else:
                cell.update(kind="d", ts=v)
            rows.append(cell)
    return make(spark, schemas.CELLS, rows)


def value_of(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def lit(v):
    return F.lit(v)
