"""Table contracts. Readers pass these schemas, nothing is inferred."""

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_DAY, _TS = T.DateType(), T.TimestampNTZType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


OBSERVATIONS = _table(
    report=_S, subject=_S, grain=_S, period=_S, metric=_S, stat=_S, category=_S,
    value=_D, raw=_S, fmt=_S, source_file=_S, source_sheet=_S, source_order=_I, row_ord=_I,
)
CHART_OBS = _table(
    report=_S, subject=_S, grain=_S, period=_S, headline=_S, series=_S, value=_D,
    source_file=_S, source_order=_I, row_ord=_I,
)
COVERAGE = _table(source_file=_S, source_order=_I, start=_DAY, end=_DAY)
SUBJECTS = _table(id=_S, name=_S, type=_S, parent=_S, modules=T.ArrayType(_S))
CAMPAIGNS = _table(
    generation=_S, sub_generation=_S, small_start=_DAY, small_end=_DAY,
    order_start=_DAY, convert_end=_DAY, launch_days=_I,
)
STORE_COUNTS = _table(brand=_S, channel=_S, n=_D)
STORE_OVERRIDES = _table(subject=_S, channel=_S, n=_D)
LAUNCH_OBS = _table(
    subject=_S, campaign=_S, phase=_I, grain=_S, step=_S, step_ord=_I, step_date=_DAY,
    metric=_S, value=_D,
)
LAUNCH_HOURLY = _table(subject=_S, campaign=_S, phase=_I, ts=_TS, metric=_S, value=_D)
RETREAT_DAILY = _table(
    subject=_S, campaign=_S, date=_DAY, small_cancel=_D, small_cancel_cum=_D, big_cancel=_D,
    convert_rate=_D, small_rate=_D, big_rate=_D,
)
RETREAT_HOURLY = _table(subject=_S, campaign=_S, date=_DAY, hour=_I, orders=_D, cancel=_D)
RETREAT_BY_OPTION = _table(
    subject=_S, campaign=_S, dimension=_S, label=_S, orders=_D, cancel=_D,
    pre_share=_D, post_share=_D, share=_D, ord=_I,
)
COHORTS = _table(
    subject=_S, grain=_S, period=_S, s1=_D, s2=_D, s3=_D, s4=_D, s5=_D, s6=_D, s7=_D,
    order_to_lock_days=_D, lock_to_delivery_days=_D,
)
SKU_SHARE = _table(
    subject=_S, period=_S, code=_S, version=_S, exterior=_S, interior=_S, wheel=_S,
    share=_D, ord=_I,
)
SKU_TOPK = _table(subject=_S, period=_S, label=_S, rank=_I, share=_D)
FEE_OBS = _table(
    brand=_S, generation=_S, period=_S, band=_S, row_kind=_S, grp=_S, label=_S,
    value=_D, col_ord=_I, row_ord=_I,
)
FEE_RANK = _table(brand=_S, generation=_S, rank=_I, item_text=_S, ord=_I)
NOTES = _table(id=_S, date=_S, subject=_S, text=_S, version=_I)
NOTE_CHANGES = _table(
    id=_S, ord=_L, action=_S, expected_version=_I, date=_S, subject=_S, text=_S,
)
CELLS = _table(
    file=_S, sheet=_S, row=_I, col=_I, kind=_S, s=_S, d=_D, ts=_TS, fmt=_S, hidden=_B,
)
