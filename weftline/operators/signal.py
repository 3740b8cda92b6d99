"""Signal control rules: thresholds, hysteresis, bands, trailing means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_step(signal: Column, power: Column) -> Column:
    """PF15: below -75 dBm two up, at most 20; above -60 two down, at least 5; else as it is."""
    return F.when(signal < -75, F.least(power + 2, F.lit(20))).when(signal > -60, F.greatest(power - 2, F.lit(5))).otherwise(power)


def trailing_mean(df: DataFrame, by: list[str], order: str, signal: str, n: int = 5, least: int = -100) -> DataFrame:
    """WN9: mean of the last n samples above least, truncated towards zero as integers are divided in C; null without any."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    good = F.col(signal) > least
    total, count = F.sum(F.when(good, F.col(signal))).over(w), F.count(F.when(good, F.lit(1))).over(w)
    return df.withColumn("_t", total).withColumn("_c", count).withColumn("mean_signal", F.when(F.col("_c") > 0, F.expr("_t div _c"))).drop("_t", "_c")


def trailing_quality(df: DataFrame, by: list[str], order: str, quality: str, n: int) -> DataFrame:
    """WN10: mean of the positive ones of the last n qualities, truncated; 0 without any."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    return df.withColumn("_m", F.avg(F.when(F.col(quality) > 0, F.col(quality))).over(w)).withColumn("mean_quality", F.coalesce(F.floor("_m"), F.lit(0)).cast("long")).drop("_m")


def hysteresis(current: Column, mean: Column, power: Column, low: int, optimal: int, least: int, most: int, step: int, aggressive: bool) -> Column:
    """PF21: up a step when the signal is below low (two when aggressive and the mean is too); down one when signal and mean are above optimal; clamped."""
    up = F.when((mean < low) & F.lit(aggressive), F.lit(2 * step)).otherwise(F.lit(step))
    moved = F.when(current < low, power + up).when((current > optimal) & (mean > optimal), power - step).otherwise(power)
    return F.greatest(F.lit(least), F.least(F.lit(most), moved))


def quality_band(signal: Column) -> Column:
    """PF22."""
    return F.when(signal > -50, 100).when(signal > -60, 80).when(signal > -70, 60).when(signal > -80, 40).otherwise(20)


def load_alarm(load: Column) -> Column:
    """PF23."""
    return load > 2.0


def temperature(raw: Column) -> Column:
    """PF23: millidegrees where the value is beyond 1000."""
    return F.when(raw > 1000, raw / 1000).otherwise(raw)


def power_in_range(power: Column, least: Column | int, most: Column | int) -> Column:
    """PF24."""
    return power.between(least, most)
