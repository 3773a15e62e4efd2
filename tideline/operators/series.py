"""Long metric series and the comparisons every report makes on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import EXACT, METRIC, pct_change, round_half_away, round_ratio

BASELINES = (
    "previous_day",
    "last_week",
    "previous_7d_avg",
    "previous_30d_avg",
    "previous_30d_stddev",
)
COMPARISONS = ("dod_pct", "wow_pct", "vs_7d_avg_pct", "vs_30d_avg_pct", "z_score_30d")


def to_long(
    wide: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, str | Column] | Sequence[str],
    available: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Wide to long in one pass over the input; NULL values keep their row.

    ``metrics`` maps metric name to column. With ``available`` (metric name to 1/0
    column) every row also carries ``data_available``.
    """
    if not isinstance(metrics, Mapping):
        metrics = {m: m for m in metrics}
    rows = []
    for name, source in metrics.items():
        fields = [F.lit(name).alias("metric"), _col(source).cast(METRIC).alias("value")]
        if available is not None:
            fields.append(_col(available[name]).cast("int").alias("data_available"))
        rows.append(F.struct(*fields))
    return wide.select(*keys, F.inline(F.array(*rows)))


def baseline_pack(long: DataFrame, dims: Sequence[str] = (), scale: int = 2) -> DataFrame:
    """Previous day, same weekday, trailing means and spread, per series ordered by day.

    Frames count rows, so on a dense axis they count days. All five share one window
    specification: one shuffle, one sort. Sums and means are exact; only the spread is
    floating point.
    """
    series = Window.partitionBy(*dims, "metric").orderBy("dt")
    week = series.rowsBetween(-7, -1)
    month = series.rowsBetween(-30, -1)
    value = F.col("value")

    def trailing_mean(frame) -> Column:
        return round_ratio(F.sum(value).over(frame), F.count(value).over(frame), scale)

    spread = F.stddev_samp(value.cast("double")).over(month)
    packed = long.withColumns(
        {
            "previous_day": F.lag(value, 1).over(series).cast("double"),
            "last_week": F.lag(value, 7).over(series).cast("double"),
            "previous_7d_avg": trailing_mean(week),
            "previous_30d_avg": trailing_mean(month),
            "previous_30d_stddev": round_half_away(spread, scale),
        }
    )
    return packed.withColumn("value", value.cast("double"))


def comparison_pack(packed: DataFrame) -> DataFrame:
    """Percentage changes and z-score against the (already rounded) baselines."""
    value = F.col("value")
    gap = value.try_cast(EXACT) - F.col("previous_30d_avg").try_cast(EXACT)
    return packed.withColumns(
        {
            "dod_pct": pct_change(value, F.col("previous_day")),
            "wow_pct": pct_change(value, F.col("last_week")),
            "vs_7d_avg_pct": pct_change(value, F.col("previous_7d_avg")),
            "vs_30d_avg_pct": pct_change(value, F.col("previous_30d_avg")),
            "z_score_30d": round_ratio(gap, F.col("previous_30d_stddev"), 2),
        }
    )


def anomaly_shortlist(compared: DataFrame, min_abs_z: float, min_abs_pct: float) -> DataFrame:
    """Rows to look at, judged on the week as well as on the spread.

    A row without a weekly or monthly base is kept and marked ``not comparable``
    instead of being passed over silently.
    """
    z, pct = F.abs("z_score_30d"), F.abs("vs_7d_avg_pct")
    status = (
        F.when(F.col("vs_7d_avg_pct").isNull() | F.col("z_score_30d").isNull(), "not comparable")
        .when((z >= min_abs_z) & (pct >= min_abs_pct), "level and spread")
        .when(z >= min_abs_z, "spread")
        .when(pct >= min_abs_pct, "level")
    )
    return compared.withColumn("status", status).where(F.col("status").isNotNull())


def _col(source: str | Column) -> Column:
    return F.col(source) if isinstance(source, str) else source
