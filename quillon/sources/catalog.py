"""Tables by name."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.sources.row_blocks import read_row_blocks


class Catalog:
    """A directory of ``<table>.parquet`` files (or folders), or DataFrames given by name.

    A parquet table is opened at its first use only; its path may be in any
    store that Spark reads.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, tables: Mapping[str, DataFrame] | None = None):
        self._spark, self._path, self._tables = spark, path, dict(tables or {})
        self._blocks: dict[str, tuple[str, T.StructType, int]] = {}
        self._places: dict[str, str] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: str | dict) -> Catalog:
        """Tables of a JSON config: ``{"tables": [{"name", "path", "format"?, "columns"?, "block_size"?, "statistics"?}]}``.

        ``format`` is ``parquet`` (the default) or ``row_blocks``. ``columns`` are
        ``{"name", "type"}`` with Spark's type names; Parquet needs none, and
        with them reads those columns only, in that order. ``statistics`` of a
        Parquet table are ``{"rows", "bytes"?, "columns"?: {name: {"distinct"?,
        "min"?, "max"?, "nulls"?}}}``, or ``"analyze"`` to have them computed.
        """
        catalog = cls(spark)
        for t in (json.loads(config) if isinstance(config, str) else config)["tables"]:
            name, columns = t["name"], T.StructType()
            for c in t.get("columns", ()):
                columns.add(c["name"], T.DataType.fromDDL(c["type"]))
            if t.get("format", "parquet") == "row_blocks":
                catalog._blocks[name] = (t["path"], columns, t["block_size"])
            elif t.get("format", "parquet") == "parquet":
                reader = spark.read.schema(columns) if len(columns) else spark.read
                catalog._tables[name], catalog._places[name] = reader.parquet(t["path"]), t["path"]
                if t.get("statistics") == "analyze":
                    catalog.analyze(name)
                elif t.get("statistics"):
                    catalog.declare(name, **t["statistics"])
            else:
                raise ValueError(f"unknown format {t['format']!r} of table {name!r}")
        return catalog

    def table(self, name: str, columns: Collection[str] | None = None) -> DataFrame:
        """The table; of row-block files, whose scan Spark cannot prune, only ``columns`` are decoded where they are given."""
        if name in self._blocks:
            return read_row_blocks(self._spark, *self._blocks[name], columns=columns)
        if name not in self._tables:
            if self._path is None:
                raise KeyError(f"no table {name!r}; known: {', '.join(sorted([*self._tables, *self._blocks])) or 'none'}")
            self._places[name] = f"{self._path.rstrip('/')}/{name}.parquet"
            self._tables[name] = self._spark.read.parquet(self._places[name])
        return self._tables[name]

    def _external(self, name: str) -> str:
        """A table of the session's catalog over the same files, which can carry statistics; nothing is copied or cached."""
        schema = self.table(name).schema
        if name not in self._places:
            raise ValueError(f"only tables of Parquet files have statistics, not {name!r}")
        known = f"quillon_{uuid.uuid4().hex}"
        self._spark.catalog.createTable(known, path=self._places[name], source="parquet", schema=schema)
        self._tables[name] = self._spark.table(known)
        return known

    def analyze(self, name: str) -> DataFrame:
        """Column statistics (with histograms) of a table, for Catalyst's cost-based join order.

        Set ``spark.sql.cbo.enabled`` and ``spark.sql.cbo.joinReorder.enabled`` to
        have them used. The table is read once for them, and not cached.
        """
        known = self._external(name)
        self._spark.sql(f"ANALYZE TABLE {known} COMPUTE STATISTICS FOR ALL COLUMNS")
        self._tables[name] = self._spark.table(known)
        return self._tables[name]

    def declare(self, name: str, rows: int, bytes: int | None = None, columns: Mapping[str, Mapping] | None = None) -> DataFrame:
        """Statistics that are known already: rows, bytes (8 a value without it), and per column distinct, min, max and nulls. They decide plans, never results."""
        known = self._external(name)
        jvm, session = self._spark._jvm, self._spark._jsparkSession
        scala = jvm.org.apache.spark.api.python.PythonUtils.toScalaMap
        catalog, found = jvm.org.apache.spark.sql.catalyst.catalog, jvm.java.util.HashMap()
        for column, of in (columns or {}).items():
            fixed = self._tables[name].schema[column].dataType.simpleString() not in ("string", "binary")
            parts = {"version": 2, "distinctCount": of.get("distinct"), "min": of.get("min"), "max": of.get("max"), "nullCount": of.get("nulls", 0)}
            parts |= dict.fromkeys(("avgLen", "maxLen"), 8 if fixed else 20)
            texts = jvm.java.util.HashMap()
            for k, v in parts.items():
                if v is not None:
                    texts.put(f"{column}.{k}", str(v))
            found.put(column, catalog.CatalogColumnStat.fromMap(name, column, scala(texts)).get())
        # Scala's numbers do not pass through Python as what they are: they stay in options and lists on the other side
        size = bytes if bytes is not None else 8 * rows * len(self._tables[name].columns)
        values = jvm.java.util.ArrayList()
        values.addAll(jvm.scala.jdk.javaapi.CollectionConverters.asJava(self._counted(size).toList()))
        values.add(self._counted(rows))
        values.add(scala(found))
        maker = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.catalog.CatalogStatistics").getConstructors()[0]
        identifier = session.sessionState().sqlParser().parseTableIdentifier(known)
        session.sessionState().catalog().alterTableStats(identifier, jvm.scala.Some(maker.newInstance(values.toArray())))
        self._spark.catalog.refreshTable(known)
        self._tables[name] = self._spark.table(known)
        return self._tables[name]

    def _counted(self, n: int):
        """An option of Scala's big integer ``n``: the row count of that many rows."""
        return self._spark.range(n)._jdf.queryExecution().optimizedPlan().stats().rowCount()
