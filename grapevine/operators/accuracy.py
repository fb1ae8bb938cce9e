"""Mean absolute percentage error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.functions.scaling import ratio


def mape(
    df: DataFrame,
    target: str,
    prediction: str,
    by: Sequence[str] = (),
    remove_zero_targets: bool = True,
    single_row_as_ratio: bool = False,
) -> DataFrame:
    """Mean of |(t - p) / t| times 100, per group.

    Zero targets are left out, or with ``remove_zero_targets=False`` moved by one together
    with their prediction. ``single_row_as_ratio`` gives a group of one row as |t - p| / t,
    not times 100 and with the sign of the target.
    """
    t, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    if remove_zero_targets:
        shifted_t, shifted_p = F.when(t != 0, t), p
    else:
        shifted_t = F.when(t == 0, F.lit(1.0)).otherwise(t)
        shifted_p = F.when(t == 0, p + 1).otherwise(p)
    value: Column = F.avg(F.abs(ratio(shifted_t - shifted_p, shifted_t))) * 100
    if single_row_as_ratio and remove_zero_targets:
        value = F.when(F.count(F.lit(1)) == 1, F.max(ratio(F.abs(t - p), t))).otherwise(value)
    return df.groupBy(*by).agg(value.alias("mape"))
