"""Names and spellings: sample types, column aliases, durations, file registration (section A)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Substrings of a file name, in lower case, for each sample type; the first type that matches wins.
SAMPLE_TYPES = [
    ("Blank", "#2B2D42", ["blank", "blk", "solvent", "diluent", "mobilephase", "reagent", "matrix", "background", "zero", "blanco", "blanc"]),
    ("Standard", "#33BBEE", ["std", "standard", "stnd", "calibr", "calibrant", "cal", "ref", "reference", "stock", "workingstandard", "primarystandard", "secondarystandard"]),
    ("QC", "#CC3311", ["qc", "qualitycontrol", "control", "check", "pool", "pqc", "system suitability", "sst", "verification", "crm"]),
]
OTHER_TYPE, OTHER_COLOR = "Sample", "#BBBBBB"

# Source names in order of priority for each column of the target table.
ALIASES = {
    "mz_mean": ["meanmz", "medmz", "parent", "row m/z", "precursor_mz", "precursormz"],
    "peak_label": ["compound", "compoundid", "compoundname", "compound name", "name", "target", "target_name"],
    "rt": ["meanrt", "medrt", "expectedrt", "row retention time", "retention_time", "retentiontime"],
    "rt_min": ["rtmin"],
    "rt_max": ["rtmax"],
}
#: Sources whose times are minutes.
IN_MINUTES = ("medrt", "meanrt")


def _by_name(name: Column, values: list[str], other: str) -> Column:
    text = F.lower(name)
    hits = [reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in patterns]) for _, _, patterns in SAMPLE_TYPES]
    out = F.when(hits[0], values[0])
    for hit, value in zip(hits[1:], values[1:], strict=True):
        out = out.when(hit, value)
    return out.otherwise(other)


def detect_sample_type(name: Column) -> Column:
    """A5: Blank, Standard, QC or Sample."""
    return _by_name(name, [t for t, _, _ in SAMPLE_TYPES], OTHER_TYPE)


def detect_sample_color(name: Column) -> Column:
    return _by_name(name, [c for _, c, _ in SAMPLE_TYPES], OTHER_COLOR)


def rt_to_seconds(text: Column) -> Column:
    """A number as it is, an ISO-8601 time as seconds, anything else 0."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    whole = r"^(?i)P(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)$"
    part = lambda k: F.coalesce(F.regexp_extract(plain, whole, k).try_cast("double"), F.lit(0.0))
    iso = F.when(plain.rlike(whole), part(1) * 3600 + part(2) * 60 + part(3))
    return F.coalesce(plain.try_cast("double"), iso, F.lit(0.0))


def renames(columns: list[str]) -> dict[str, str]:
    """Source column -> target column; a target that is there already, or was taken, is left alone."""
    lower = {}
    for c in columns:
        lower.setdefault(c.lower().strip(), c)
    out: dict[str, str] = {}
    for target, sources in ALIASES.items():
        if target not in columns:
            found = next((s for s in sources if s in lower), None)
            if found is not None:
                out[lower[found]] = target
    return out


def normalize_column_names(rows: DataFrame) -> DataFrame:
    """Columns by their aliases; times of sources in minutes become seconds."""
    names = renames(rows.columns)
    minutes = any(source.lower().strip() in IN_MINUTES for source, target in names.items() if target == "rt")
    out = rows.withColumnsRenamed(names)
    if minutes:
        out = out.withColumns({c: F.col(c) * 60.0 for c in ("rt", "rt_min", "rt_max") if c in out.columns})
    return out


def stem(path: Column) -> Column:
    """File name without folders and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")


def skip_known_files(files: DataFrame, samples: DataFrame, path_col: str = "path") -> DataFrame:
    """A3: files whose stem isn't a known sample."""
    known = samples.select(F.col("ms_file_label").alias("_known")).distinct()
    return files.join(known, stem(F.col(path_col)) == F.col("_known"), "left_anti")


def register_samples(points: DataFrame) -> DataFrame:
    """A4: one row per file with its first scan time, number of points, type and colour by name."""
    rows = points.groupBy("ms_file_label").agg(F.min("scan_time").alias("first_scan"), F.count(F.lit(1)).alias("n_points"))
    return rows.withColumns({"sample_type": detect_sample_type(F.col("ms_file_label")), "color": detect_sample_color(F.col("ms_file_label"))})


METADATA = {"ms_file_label": "string", "label": "string", "color": "string", "use_for_optimization": "boolean", "use_for_processing": "boolean", "use_for_analysis": "boolean", "sample_type": "string"} | {f"group_{k}": "string" for k in range(1, 6)}


def read_metadata(parts: list[DataFrame]) -> DataFrame:
    """Metadata tables in order, the first row of each file, all known columns and no others.

    Rows of a table are in the order of its column ``source_order`` (see ``readers.in_source_order``), or as Spark reads them.
    """
    ready = []
    for k, part in enumerate(parts):
        if "ms_file_label" not in part.columns:
            raise ValueError("Missing required columns: ms_file_label")
        cast = [F.col(c).cast(t).alias(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in METADATA.items()]
        given = [c for c in ("use_for_optimization", "use_for_processing") if c in part.columns]
        ready.append(part.select(*cast, F.lit(k).alias("_part"), (F.col("source_order") if "source_order" in part.columns else F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.monotonically_increasing_id().alias("row"))).alias("_row")).withColumns({c: F.coalesce(c, F.lit(True)) for c in given}))
    rows = reduce(lambda a, b: a.unionByName(b), ready)
    first = Window.partitionBy("ms_file_label").orderBy("_part", "_row")
    out = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_part", "_row")
    return out.withColumns({c: F.coalesce(c, F.lit(True)) for c in ("use_for_optimization", "use_for_processing")})


def import_feature_table(rows: DataFrame, selectivity: float | None, detection_pct: float | None, n_files: int, mz_width: float = 5.0) -> DataFrame:
    """Features selective enough and detected in enough files, as targets."""
    import math

    if selectivity is not None and "cSelectivity" in rows.columns:
        rows = rows.filter(F.col("cSelectivity") >= selectivity)
    counts = next((c for c in ("detection_counts", "detection counts") if c in rows.columns), None)
    if detection_pct is not None and counts:
        rows = rows.filter(F.col(f"`{counts}`") >= math.ceil(detection_pct / 100 * n_files))
    named = {"id_number": "peak_label", "mz": "mz", "rtime": "rt", "rtime_left_base": "rt_min", "rtime_right_base": "rt_max"}
    out = rows.select(*[F.col(a).alias(b) for a, b in named.items()])
    return out.withColumns({"mz_mean": F.col("mz"), "mz_width": F.lit(mz_width), "intensity_threshold": F.lit(0.0)})
