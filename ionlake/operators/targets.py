"""Target rules (section B): windows in time, units, defaults, rejects, duplicates, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.operators.extract import selected_or_all

#: Half a window, in the list's own unit, where only a retention time is given.
HALF_WINDOW = 5.0


def derive_rt_window(rows: DataFrame) -> DataFrame:
    """B1: fill rt, rt_min, rt_max from what is given; ``rt_auto_adjusted`` marks guessed bounds, ``error`` what can't be used."""
    rt, low, high = F.col("rt"), F.col("rt_min"), F.col("rt_max")
    both, one = low.isNotNull() & high.isNotNull(), low.isNotNull() | high.isNotNull()
    new_rt = F.when(rt.isNull() & both, (low + high) / 2).otherwise(rt)
    new_low = F.when(low.isNotNull(), low).when(rt.isNotNull() & high.isNotNull(), rt - (high - rt)).when(rt.isNotNull(), rt - HALF_WINDOW)
    new_high = F.when(high.isNotNull(), high).when(rt.isNotNull() & low.isNotNull(), rt + (rt - low)).when(rt.isNotNull(), rt + HALF_WINDOW)
    error = F.when(rt.isNull() & ~both, F.when(one, "only one bound").otherwise("no retention time"))
    out = rows.withColumns({"_rt": new_rt, "_low": new_low, "_high": new_high, "rt_auto_adjusted": rt.isNotNull() & ~both, "error": error})
    return out.withColumns({"rt": F.col("_rt"), "rt_min": F.col("_low"), "rt_max": F.col("_high")}).drop("_rt", "_low", "_high")


def rt_to_seconds_unit(rows: DataFrame) -> DataFrame:
    """Times to seconds by ``rt_unit``; another unit is an error."""
    unit = F.lower(F.trim("rt_unit"))
    minutes, seconds = unit.isin("min", "minute", "minutes", "m"), unit.isin("s", "sec", "second", "seconds")
    bad = F.when(~F.coalesce(minutes | seconds, F.lit(False)), "unknown unit")
    out = rows.withColumns({c: F.when(minutes, F.col(c) * 60).otherwise(F.col(c)) for c in ("rt", "rt_min", "rt_max")} | {"error": F.coalesce("error", bad)})
    return out.withColumn("rt_unit", F.lit("s"))


def validate_targets(rows: DataFrame) -> DataFrame:
    """B2: an error for an empty label, bounds out of order or a negative bound."""
    checks = [
        (F.trim(F.coalesce("peak_label", F.lit(""))) == "", "empty label"),
        (F.col("rt_min") >= F.col("rt_max"), "rt_min not below rt_max"),
        (F.col("rt_min") < 0, "negative rt_min"),
    ]
    found = reduce(lambda acc, c: acc.when(c[0], c[1]), checks[1:], F.when(*checks[0]))
    return rows.withColumn("error", F.coalesce("error", found))


def recenter_rt(rows: DataFrame) -> DataFrame:
    """A time outside its window becomes the middle, and is marked."""
    out = ~F.col("rt").between(F.col("rt_min"), F.col("rt_max"))
    out = F.coalesce(out, F.lit(False))
    return rows.withColumns({"rt_auto_adjusted": F.col("rt_auto_adjusted") | out, "rt": F.when(out, (F.col("rt_min") + F.col("rt_max")) / 2).otherwise(F.col("rt"))})


def normalize_polarity(column: Column) -> Column:
    """Signs and lower-case words become Positive and Negative; other text stays."""
    out = column
    for old, new in (("+", "Positive"), ("positive", "Positive"), ("-", "Negative"), ("negative", "Negative")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def default_target_fields(rows: DataFrame) -> DataFrame:
    """B5."""
    return rows.withColumns(
        {
            "mz_width": F.coalesce("mz_width", F.lit(10.0)),
            "polarity": normalize_polarity(F.col("polarity")),
            "ms_type": F.when(F.coalesce("filterLine", F.lit("")) != "", "ms2").otherwise("ms1"),
            "peak_selection": F.coalesce("peak_selection", F.lit(True)),
            "bookmark": F.coalesce("bookmark", F.lit(False)),
        }
    )


def dedupe_targets(rows: DataFrame, order: list[str]) -> DataFrame:
    """``duplicate`` is true for all but the first row of a label in ``order``."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("peak_label").orderBy(*order)) > 1)


def target_stats(checked: DataFrame) -> DataFrame:
    """Processed, failed, unique, duplicate, adjusted, from rows with error, duplicate and rt_auto_adjusted."""
    good = F.col("error").isNull()
    return checked.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(~good).alias("failed"), F.count_if(good & ~F.col("duplicate")).alias("unique_labels"),
        F.count_if(good & F.col("duplicate")).alias("duplicates"), F.count_if(good & F.col("rt_auto_adjusted")).alias("adjusted"),
    )


def choose_targets(targets: DataFrame, ms_type: str, bookmark: bool | None = None, labels: list[str] | None = None, chromatograms: DataFrame | None = None) -> DataFrame:
    """By type, bookmark, list (none means all), selected or else all, and with a chromatogram of the type."""
    out = targets.filter(F.col("ms_type") == ms_type)
    if bookmark is not None:
        out = out.filter(F.coalesce("bookmark", F.lit(False)) == bookmark)
    if labels:
        out = out.filter(F.col("peak_label").isin(*labels))
    out = selected_or_all(out)
    if chromatograms is not None:
        out = out.join(chromatograms.filter(F.col("ms_type") == ms_type).select("peak_label").distinct(), "peak_label", "left_semi")
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` that ``new`` has no key of."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def update_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A10: ``new``'s values where they are not null."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(fresh, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def delete_rows(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The tables without rows of the given keys, as far as a table has those keys."""
    return {name: t.join(gone.select(*keys).distinct(), keys, "left_anti") if set(keys) <= set(t.columns) else t for name, t in tables.items()}
