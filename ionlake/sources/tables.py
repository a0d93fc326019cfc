"""Saved tables that are changed in place: A10 to A15 on tables that outlive the job.

A saved table is a folder with

- ``data/<change>/part=<k>/...parquet``: rows dealt to a fixed number of parts by a hash of one column
  (the file label, so that a change to some files touches few parts), and
- ``versions/v=<n>/...json``: for each part the change that wrote it last, at most ``parts`` rows.

A change reads the parts it touches, writes them anew under a name of its own, and then writes one file, the
next version, which Spark's committer moves into place as its last step. A reader takes the highest version and so
sees a table before a change or after it. A job that is lost in between leaves files that no version names, and
the table as it was. Parts that a change doesn't touch keep their files. One writer at a time for each table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.operators.targets import update_rows, upsert

PART = "_part"
VERSION = "part int, change string, by string, parts int, schema string, v int"


class SavedTable:
    """A table under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---------------------------------------------------------------- versions
    def version(self) -> tuple[int, dict]:
        """Number of the newest version, and its by, parts, schema and changes (part -> change)."""
        rows = self.spark.read.schema(VERSION).json(f"{self.path}/versions")
        newest = rows.filter(F.col("v") == rows.agg(F.max("v")).first()[0]).collect()  # at most ``parts`` rows
        first = newest[0]
        return first["v"], {"by": first["by"], "parts": first["parts"], "schema": T.StructType.fromJson(json.loads(first["schema"])), "changes": {r["part"]: r["change"] for r in newest if r["change"]}}

    def _commit(self, number: int, state: dict) -> None:
        schema = state["schema"].json()
        rows = [(k, state["changes"].get(k), state["by"], state["parts"], schema) for k in range(state["parts"])]
        self.spark.createDataFrame(rows, VERSION.rsplit(",", 1)[0]).coalesce(1).write.mode("error").json(f"{self.path}/versions/v={number}")

    def _part_of(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(state["by"]), F.lit(state["parts"])).cast("int")

    def _write(self, rows: DataFrame, state: dict, touched: set[int]) -> dict:
        """The state after ``rows`` have become all rows of the touched parts."""
        change = uuid.uuid4().hex
        placed = rows.select(*state["schema"].names).withColumn(PART, self._part_of(state))
        # A part's rows together, but for a part that is so large that Spark splits it over tasks.
        placed.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/data/{change}")
        left = {r[PART] for r in self.spark.read.schema(T.StructType([*state["schema"].fields, T.StructField(PART, T.IntegerType())])).parquet(f"{self.path}/data/{change}").select(PART).distinct().collect()} if touched else set()
        changes = {k: c for k, c in state["changes"].items() if k not in touched} | dict.fromkeys(left, change)
        return state | {"changes": changes}

    # ---------------------------------------------------------------- reading
    def read(self, parts: set[int] | None = None) -> DataFrame:
        return self._read(self.version()[1], parts)

    def _read(self, state: dict, parts: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{c}/{PART}={k}" for k, c in sorted(state["changes"].items()) if parts is None or k in parts]
        return self.spark.read.schema(state["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], state["schema"])

    # ---------------------------------------------------------------- changes
    def create(self, rows: DataFrame, by: str, parts: int = 64) -> SavedTable:
        state = {"by": by, "parts": parts, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]), "changes": {}}
        self._commit(0, self._write(rows, state, set(range(parts))))
        return self

    def change(self, what: Callable[[DataFrame], DataFrame], touched: Callable[[dict], set[int]]) -> set[int]:
        """Replaces the rows of the touched parts by ``what`` of them; returns those parts."""
        number, state = self.version()
        parts = touched(state)
        if parts:
            self._commit(number + 1, self._write(what(self._read(state, parts)), state, parts))
        return parts

    def _parts_of(self, rows: DataFrame, state: dict) -> set[int]:
        """Parts that ``rows`` belong to; rows that don't have the column that parts go by may be in any part that has such rows."""
        if state["by"] in rows.columns:
            return {r[0] for r in rows.select(self._part_of(state)).distinct().collect()}  # at most ``parts`` numbers
        keys = [c for c in rows.columns if c in state["schema"].names]
        return self._parts_of(self._read(state).join(rows.select(*keys).distinct(), keys, "left_semi"), state) if keys else set()

    def update(self, new: DataFrame, key: str, columns: list[str]) -> set[int]:
        """A10: values of ``new`` where they are not null."""
        return self.change(lambda old: update_rows(old, new, key, columns), lambda s: self._parts_of(new.select(key), s))

    def upsert(self, new: DataFrame, keys: list[str]) -> set[int]:
        """Rows of ``new``, and those saved that ``new`` has no key of. ``keys`` must name the column that parts go by."""
        return self.change(lambda old: upsert(old, new, keys), lambda s: self._parts_of(new, s))

    def delete(self, gone: DataFrame, keys: list[str]) -> set[int]:
        """No rows of the given keys, as far as the table has those keys."""

        def without(old: DataFrame) -> DataFrame:
            return old.join(gone.select(*keys).distinct(), keys, "left_anti")

        def touched(state: dict) -> set[int]:
            return self._parts_of(gone.select(*keys), state) & set(state["changes"]) if set(keys) <= set(state["schema"].names) else set()

        return self.change(without, touched)


def delete_everywhere(tables: dict[str, SavedTable], gone: DataFrame, keys: list[str]) -> dict[str, set[int]]:
    """The cascade: rows of the keys leave every table that has those keys. By table, the parts that were written anew."""
    return {name: t.delete(gone, keys) for name, t in tables.items()}
