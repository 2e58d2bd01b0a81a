"""Column expressions over times given as whole days (MJD) and nanoseconds of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NANOS = 86_400_000_000_000

#: MJD (UTC) from which TAI - UTC is so many seconds.
LEAP_SECONDS = [
    (41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19),
    (44786, 20), (45151, 21), (45516, 22), (46247, 23), (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29),
    (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37),
]


def mjd(days: Column, nanos: Column) -> Column:
    return days + nanos / F.lit(float(NANOS))


def carried(days: Column, nanos: Column) -> Column:
    """(days, nanos) with nanoseconds beyond a day carried to the days."""
    whole = F.floor(nanos / F.lit(NANOS))
    return F.struct((days + whole).cast("long").alias("days"), (nanos - whole * NANOS).cast("long").alias("nanos"))


def round_ms(days: Column, nanos: Column) -> Column:
    """The time rounded to milliseconds, half up, with day carry."""
    return carried(days, F.floor((nanos + 500_000) / F.lit(1_000_000)).cast("long") * 1_000_000)


def rescale(days: Column, nanos: Column, source: str, target: str) -> Column:
    """(days, nanos) moved between the utc, tai, tt and tdb scales.

    UTC and TAI differ by the leap seconds; TT is TAI + 32.184 s; TDB adds the largest periodic term.
    """
    if source == target:
        return F.struct(days.alias("days"), nanos.alias("nanos"))

    def bound(value: Column, use) -> Column:
        # A one-element transform computes a value once, however often it is used.
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def leap(day: Column) -> Column:
        def seconds(d: Column) -> Column:
            out = F.lit(0)
            for start, value in LEAP_SECONDS:
                out = F.when(d >= start, F.lit(value)).otherwise(out)
            return out.cast("long")

        return bound(day, seconds)

    def periodic(d: Column, n: Column) -> Column:
        g = F.radians(357.53 + 0.98560028 * (mjd(d, n) - 51544.5))
        return F.round(bound(g, lambda x: 0.001658 * F.sin(x) + 0.000014 * F.sin(2 * x)) * 1e9).cast("long")

    to_tai = {"utc": lambda: leap(days) * 1_000_000_000, "tai": lambda: F.lit(0), "tt": lambda: F.lit(-32_184_000_000), "tdb": lambda: F.lit(-32_184_000_000) - periodic(days, nanos)}[source]()

    def from_tai(n: Column) -> Column:
        shift = {
            # A second either side of a leap is settled by the day of the shifted time.
            "utc": lambda: -leap((days + F.floor((n - 37_000_000_000) / F.lit(NANOS))).cast("long")) * 1_000_000_000,
            "tai": lambda: F.lit(0),
            "tt": lambda: F.lit(32_184_000_000),
            "tdb": lambda: F.lit(32_184_000_000) + periodic(days, n),
        }[target]()
        return (n + shift).cast("long")

    return bound(bound((nanos + to_tai).cast("long"), from_tai), lambda n: carried(days, n))


def observing_night(days: Column, nanos: Column, longitude: Column) -> Column:
    """The MJD of the local noon before the observation; ``longitude`` is east, in degrees."""
    return F.floor(mjd(days, nanos) + longitude / 360.0 - 0.5).cast("long")


def state_hash(days: Column, nanos: Column, code: Column, separator: str = "") -> Column:
    """The key of a (time, observatory) state."""
    return F.md5(F.concat_ws(separator, days.cast("string"), nanos.cast("string"), code))


def state_index(df: DataFrame, days: str = "days", nanos: str = "nanos", code: str = "code", name: str = "state_index") -> DataFrame:
    """``df`` with the dense rank, from 0, of its state in (days, nanos, code) order.

    Ranks are taken within a day and lifted by the number of states of the days before, so that no task
    sorts more than a day.
    """
    per_day = df.groupBy(days).agg(F.countDistinct(nanos, code).alias("__n"))
    before = Window.orderBy(days).rowsBetween(Window.unboundedPreceding, -1)
    lifted = per_day.select(F.col(days), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.dense_rank().over(Window.partitionBy(days).orderBy(nanos, code)) - 1
    return df.withColumn("__rank", within).join(lifted, days).withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__rank", "__before")
