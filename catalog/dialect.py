"""Fixture views: one SELECT per view, rendered for Spark and for DuckDB.

The text is the same but for three things the engines spell differently: table
names, string literals with backslashes, and exploding an array with positions.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


class Duck:
    name = "duck"

    def table(self, name: str) -> str:
        return name

    def lit(self, value: str | None) -> str:
        return "NULL" if value is None else "'" + value.replace("'", "''") + "'"

    def idiv(self, a, b) -> str:
        return f"({a} // {b})"

    def explode_lines(self, table: str, text: str, sep: str = "\n") -> str:
        """FROM clause giving ``ord`` (0-based) and ``line`` beside the table's columns."""
        return (f"(SELECT d.*, u.o - 1 AS ord, u.line AS line FROM {table} d, "
                f"unnest(string_split(d.{text}, '{sep}')) WITH ORDINALITY AS u(line, o))")


class Spark:
    name = "spark"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def table(self, name: str) -> str:
        return f"parquet.`{os.path.join(self.sf_dir, name)}.parquet`"

    def lit(self, value: str | None) -> str:
        return "CAST(NULL AS STRING)" if value is None else (
            "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'")

    def idiv(self, a, b) -> str:
        return f"({a} div {b})"

    def explode_lines(self, table: str, text: str, sep: str = "\n") -> str:
        regex = {"\n": "\\n", " ": " "}[sep]
        return (f"(SELECT d.*, CAST(e.pos AS BIGINT) AS ord, e.line AS line FROM {table} d "
                f"LATERAL VIEW posexplode(split(d.{text}, '{regex}')) e AS pos, line)")


def pick(dialect, values, index: str) -> str:
    """The ``index``-th of ``values`` as a CASE, the same in both engines."""
    arms = " ".join(f"WHEN {i} THEN {dialect.lit(v)}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {arms} END"


@lru_cache(maxsize=1)
def _views() -> dict:
    from catalog.fixtures import VIEWS
    return VIEWS


# Views written as Parquet by ``materialize``: sf_dir -> (folder, names). Others are derived on the fly.
_stored: dict[str, tuple[str, frozenset]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    folder, names = _stored.get(sf_dir, ("", frozenset()))
    if name in names:
        return spark.read.parquet(os.path.join(folder, name))
    return spark.sql(_views()[name](Spark(sf_dir)))


def materialize(spark: SparkSession, sf_dir: str, folder: str, files: int, names: list[str]) -> None:
    """Write views, and tables of the folder itself, as tables of ``files`` files, the shape an extractor leaves."""
    for name in names:
        rows = spark.sql(_views()[name](Spark(sf_dir))) if name in _views() else table(spark, sf_dir, name)
        rows.repartition(files).write.mode("overwrite").parquet(os.path.join(folder, name))
    _stored[sf_dir] = (folder, frozenset(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    folder, names = _stored.get(sf_dir, ("", frozenset()))
    if name in names:
        return spark.read.parquet(os.path.join(folder, name))
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def oracle(views: list[str] | str, body: str) -> str:
    """DuckDB text: the fixture views as CTEs, then ``body`` (which may start with WITH)."""
    names = views.split() if isinstance(views, str) else views
    ctes = [f"fx_{n} AS ({_views()[n](Duck())})" for n in names]
    body = body.strip()
    if body[:4].upper() == "WITH":
        head, rest = "WITH ", body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            head, rest = "WITH RECURSIVE ", rest[9:].lstrip()
        return head + ",\n".join([*ctes, rest]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
