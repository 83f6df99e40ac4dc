"""Stored tables: append, upsert and delete over Parquet folders, each version written whole and then named.

A table is a folder of versions and a file of Spark's that names the current one, so readers see either
the old rows or the new. Tables are partitioned by repository, which scans prune.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import INDEX_META, TABLES


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self, name: str) -> tuple[str, StructType] | None:
        """Where the current rows are, and their schema, which an empty folder doesn't show."""
        try:
            row = self.spark.read.json(f"{self.root}/{name}/versions", schema="version long, path string, kinds string").orderBy(F.desc("version")).first()
        except AnalysisException:
            return None
        self._version = row["version"] if row else 0
        return (row["path"], StructType.fromJson(json.loads(row["kinds"]))) if row else None

    def read(self, name: str, repo: str | None = None) -> DataFrame:
        """All rows, or a repository's; a table that isn't there is empty."""
        found = self._current(name)
        df = self._rows(*found) if found else self.spark.createDataFrame([], (TABLES | {"index_meta": INDEX_META}).get(name, StructType()))
        return df if repo is None else df.where(F.col("repo_id") == repo)

    def _rows(self, paths: str, schema: StructType) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths.split("\n")])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a new version and names it; the old one stays readable for queries that run."""
        self._version = 0
        self._current(name)
        self._name(name, self._written(name, rows), rows.schema)

    def _written(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy("repo_id") if "repo_id" in rows.columns else writer).parquet(path)
        return path

    def _name(self, name: str, paths: str, schema: StructType) -> None:
        """Makes a version of one folder or more (a line each)."""
        self.spark.range(1).select(F.lit(self._version + 1).cast("long").alias("version"), F.lit(paths).alias("path"), F.lit(schema.json()).alias("kinds")).coalesce(1).write.mode("append").json(f"{self.root}/{name}/versions")

    def append(self, name: str, rows: DataFrame) -> None:
        """Writes only the new rows, beside those there are. Rows with other columns, and every 32nd append, write
        the table anew."""
        found = self._current(name)
        kinds = lambda schema: {f.name: f.dataType.simpleString() for f in schema}
        if found and found[0].count("\n") < 31 and kinds(rows.schema) == kinds(found[1]):
            self._name(name, f"{found[0]}\n{self._written(name, rows)}", found[1])
        else:
            old = self.read(name)
            self.replace(name, old.unionByName(rows, allowMissingColumns=True) if old.columns else rows)

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> None:
        self.replace(name, upserted(self.read(name), rows, *keys))

    def versions(self, name: str) -> DataFrame:
        """(version, path, kinds) of a table, the newest first."""
        try:
            rows = self.spark.read.json(f"{self.root}/{name}/versions", schema="version long, path string, kinds string")
        except AnalysisException:
            rows = self.spark.createDataFrame([], "version long, path string, kinds string")
        return rows.orderBy(F.desc("version"))

    def read_version(self, name: str, version: int) -> DataFrame:
        """The rows of a version by its number; an error if there is none."""
        row = self.versions(name).where(F.col("version") == version).first()
        if row is None:
            raise KeyError(f"{name} has no version {version}")
        return self._rows(row["path"], StructType.fromJson(json.loads(row["kinds"])))

    def meta(self, key: str) -> str | None:
        """The value of a key of the index's metadata."""
        row = self.read("index_meta").where(F.col("key") == key).select("value").first()
        return row[0] if row else None

    def put_meta(self, key: str, value: str) -> None:
        self.upsert("index_meta", self.spark.createDataFrame([(key, value)], "key string, value string"), "key")

    def register(self, name: str, path: str) -> None:
        """Puts a repository into the registry, or its new path."""
        self.upsert("registry", self.spark.createDataFrame([(name, path)], "name string, path string"), "name")

    def unregister(self, name: str) -> None:
        self.replace("registry", self.read("registry").where(F.col("name") != name))

    def find(self, text: str) -> DataFrame:
        """Registered repositories (name, path) of that name, path or last folder."""
        known = self.read("registry")
        return known.where((F.col("name") == text) | (F.col("path") == text) | F.col("path").endswith(f"/{text}")) if known.columns else known

    def record(self, name: str, entry: dict[str, str]) -> None:
        """Puts an entry (with an "id") into a small table of decisions or services; the same id is replaced."""
        fields = ", ".join(f"`{k}` string" for k in entry)
        self.upsert(name, self.spark.createDataFrame([tuple(entry.values())], fields), "id")

    def delete_repo(self, repo: str) -> None:
        for name in TABLES:
            if self._current(name) and "repo_id" in (df := self.read(name)).columns:
                self.replace(name, df.where(F.col("repo_id") != repo))

    def delete_file(self, path: str) -> None:
        symbols, edges, files = delete_by_file(self.read("symbols"), self.read("relationships"), self.read("files"), self.spark.createDataFrame([(path,)], "file_path string"))
        for name, df in (("relationships", edges), ("files", files), ("symbols", symbols)):
            self.replace(name, df)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows, and the old ones whose keys are not among them."""
    if not old.columns:
        return new
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by_file(symbols: DataFrame, edges: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and files without those of some files (file_path): edges go with either end."""
    lost = symbols.join(gone, "file_path", "left_semi").select(F.col("uid").alias("lost"))
    left = edges.join(lost, F.col("source_uid") == F.col("lost"), "left_anti").join(lost, F.col("target_uid") == F.col("lost"), "left_anti")
    left = left.join(gone.select(F.concat(F.lit("F:"), "file_path").alias("f")), F.col("target_uid") == F.col("f"), "left_anti")
    return symbols.join(gone, "file_path", "left_anti"), left, files.join(gone.select(F.col("file_path").alias("path")), "path", "left_anti")
