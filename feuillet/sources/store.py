"""The index on disk: versions in folders, published by a pointer file; exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class IndexStore:
    """Versioned tables under one folder. Readers follow `current.json`, so a new version appears at once or not at all."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def manifest(self) -> dict | None:
        """{version, model_name, categories}; null if nothing was published."""
        if not self._hadoop.exists(self._path("current.json")):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/current.json").collect()))

    def publish(self, chunks: DataFrame, tables: dict[str, DataFrame], model_name: str) -> str:
        """Write the passages by category and the other tables (by bucket where they have one), then move the pointer."""
        version = uuid.uuid4().hex
        chunks.write.partitionBy("category").parquet(f"{self.folder}/{version}/chunks")
        for name, df in tables.items():
            writer = df.write.partitionBy("bucket") if "bucket" in df.columns else df.write
            writer.parquet(f"{self.folder}/{version}/{name}")
        categories = [r[0] for r in chunks.select("category").distinct().orderBy("category").collect()]
        self._point({"version": version, "model_name": model_name, "categories": categories})
        return version

    def _point(self, manifest: dict) -> None:
        """One rename over the old pointer, so a reader always finds the old or the new one."""
        self._write("current.json.new", json.dumps(manifest))
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path("current.json.new"), self._path("current.json"), options)

    def _write(self, name: str, text: str) -> None:
        out = self._hadoop.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def load(self, name: str) -> DataFrame:
        """A table of the published version; raises FileNotFoundError without one."""
        manifest = self.manifest()
        if manifest is None or not self._hadoop.exists(self._path(manifest["version"], name)):
            raise FileNotFoundError(f"{self.folder}: no published {name}")
        path = f"{self.folder}/{manifest['version']}/{name}"
        schema = self.spark.read.parquet(path).schema
        if "category" in schema.names:  # a folder's name, which must not become a number or a date
            schema = StructType([StructField("category", StringType()) if f.name == "category" else f for f in schema])
        return self.spark.read.schema(schema).parquet(path)

    def _next(self, chunks: DataFrame) -> None:
        """A new version with these passages and the other tables as they are; the published one stays until the pointer moves."""
        old = self.manifest()
        version = uuid.uuid4().hex
        chunks.write.partitionBy("category").parquet(f"{self.folder}/{version}/chunks")
        for status in self._hadoop.listStatus(self._path(old["version"])):
            name = status.getPath().getName()
            if name != "chunks":
                own = self.spark.read.parquet(f"{self.folder}/{old['version']}/{name}")
                (own.write.partitionBy("bucket") if "bucket" in own.columns else own.write).parquet(f"{self.folder}/{version}/{name}")
        categories = [r[0] for r in self.spark.read.parquet(f"{self.folder}/{version}/chunks").select("category").distinct().orderBy("category").collect()]
        self._point({**old, "version": version, "categories": categories})

    def replace_categories(self, chunks: DataFrame) -> None:
        """A new version in which the categories of `chunks` have its passages, and the others those they had."""
        own = chunks.select("category").distinct()
        self._next(self.load("chunks").join(own, "category", "left_anti").unionByName(chunks))

    def drop_category(self, category: str) -> None:
        self._next(self.load("chunks").where(F.col("category") != category))

    def drop_old_versions(self) -> None:
        """Remove every version but the published one, when no reader uses them any more."""
        current = self.manifest()["version"]
        for status in self._hadoop.listStatus(self._path("")):
            if status.isDirectory() and status.getPath().getName() != current:
                self._hadoop.delete(status.getPath(), True)


def export_rows(ranked: DataFrame) -> DataFrame:
    """The columns of a result export: scores to four decimals, aggregates to six."""
    return ranked.select("file_name", "category", "file_type", F.round("score", 4).alias("score"), F.round("aggregated", 6).alias("aggregated"), F.round("relevance", 1).alias("relevance_pct"), "text_preview")


def export_csv(ranked: DataFrame, path: str) -> None:
    export_rows(ranked).write.option("header", True).option("quoteAll", True).csv(path)


def create_tables(spark: SparkSession, database: str) -> None:
    """The catalogue and account tables; the name may hold letters, digits and _ only."""
    if not database or not all(c.isascii() and (c.isalnum() or c == "_") for c in database):
        raise ValueError(f"invalid database name: {database}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    tables = {
        "documents": "id BIGINT, path STRING, relative_path STRING, file_name STRING, file_type STRING, modified_at STRING, content_hash STRING, extracted_text STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
        "users": "id BIGINT, full_name STRING, email STRING, password_hash STRING, is_email_verified BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
        "email_verification_tokens": "id BIGINT, user_id BIGINT, token_hash STRING, expires_at TIMESTAMP, created_at TIMESTAMP",
        "password_reset_tokens": "id BIGINT, user_id BIGINT, token_hash STRING, expires_at TIMESTAMP, created_at TIMESTAMP",
        "user_sessions": "id BIGINT, user_id BIGINT, token_hash STRING, remember_me BOOLEAN, expires_at TIMESTAMP, created_at TIMESTAMP",
    }
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
