"""A collection of vectors as a Parquet table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.text import prefixed
from marketloom.operators.upsert import last_wins, new_rows


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def create(spark: SparkSession, path: str, doc_type: str = "long") -> DataFrame:
    """The collection at a path, made empty if there is none."""
    if not exists(spark, path):
        spark.createDataFrame([], f"doc_id {doc_type}, name string, embedding array<float>").write.parquet(path)
    return spark.read.parquet(path)


def scanned(df: DataFrame, doc_id: str, text: str, limit: int | None = None) -> DataFrame:
    """``(doc_id, name)`` of the rows with a text, the first ``limit`` by id if one is given."""
    out = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("name"))
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def build(df: DataFrame, path: str, doc_id: str, text: str, encoder: Callable[[list[str]], np.ndarray], limit: int | None = None) -> DataFrame:
    """Drops the collection at a path and makes it anew from the texts of a table."""
    spark = df.sparkSession
    drop(spark, path)
    create(spark, path)
    encoded(scanned(df, doc_id, text, limit), "doc_id", "name", encoder).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def encoded(df: DataFrame, doc_id: str, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64, kind: str = "passage") -> DataFrame:
    """``(doc_id, name, embedding)``: texts with their prefix through an encoder, in batches; rows without a text are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                v = np.asarray(encoder(part["prefixed"].tolist()), np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield part[["doc_id", "name"]].assign(embedding=list(v / np.where(norm > 0, norm, 1)))

    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("name"), prefixed(F.col(text), kind).alias("prefixed"))
    return rows.mapInPandas(run, "doc_id long, name string, embedding array<float>")


def upserted(known: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """``known`` with a batch's vectors put in place of those of equal ids."""
    fresh = last_wins(batch, ["doc_id"], order) if order else batch.dropDuplicates(["doc_id"])
    return new_rows(known, fresh, ["doc_id"]).unionByName(fresh.select(*known.columns))


def ids(vectors: DataFrame) -> DataFrame:
    return vectors.select("doc_id").distinct()
