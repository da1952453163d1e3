"""An inverted index as tables: postings, document lengths and corpus figures.

The index is one exploded and counted table; Spark's shuffle and spill replace block files and their merge.
On disk the postings are range-partitioned and sorted by term, so that a term's lookup reads
the few row groups whose statistics cover it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.text import tokens
from marketloom.session import delete


@dataclass(frozen=True)
class Index:
    """``postings(term, doc_id, tf[, dl])``, ``lengths(doc_id, dl)`` and one row of ``stats(n_docs, total_length, avgdl)``.

    An index on disk also has its ``lexicon(term, df)`` and, read once, its number of documents and their mean length."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    lexicon: DataFrame | None = None
    figures: tuple[float, float] | None = None

    def size(self) -> tuple[float, float]:
        if self.figures:
            return self.figures
        one = self.stats.first() or {"n_docs": 0, "avgdl": 0.0}
        return float(one["n_docs"]), float(one["avgdl"])


def corpus(df: DataFrame, doc_id: str, text: str, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """``(doc_id, tokens)`` of the rows with a text; the default tokenizer is :func:`tokens`, a Python one
    comes from :func:`python_tokenizer`."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("long").alias("doc_id"), tokenizer(F.col(text)).alias("tokens"))


def python_tokenizer(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A word segmenter in Python as a tokenizer, in Arrow batches; compounds are joined by underscores by convention."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t) if t else [])

    return run


def postings(docs: DataFrame, terms: list[str] | None = None, with_length: bool = False) -> DataFrame:
    """``(term, doc_id, tf)``; with ``terms`` only theirs, pruned before anything is shuffled.

    ``with_length`` adds the document's length ``dl``, so that scoring needs no join with all documents."""
    kept = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(sorted(set(terms))))
    if not with_length:
        return docs.select("doc_id", F.explode(kept).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    rows = docs.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode(kept).alias("term"))
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def stats(docs: DataFrame) -> DataFrame:
    """Documents, total length and mean length (0 without documents)."""
    out = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("total_length"))
    return out.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_length") / F.col("n_docs")).otherwise(0.0))


def frequencies(posts: DataFrame) -> DataFrame:
    """``(term, df)``: the documents of each term."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def build(docs: DataFrame) -> Index:
    return Index(postings(docs, with_length=True), lengths(docs), stats(docs))


def merged(*parts: DataFrame) -> DataFrame:
    """Postings of several parts of a corpus as one; a pair that several parts hold is added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def write(index: Index, path: str, partitions: int | None = None) -> None:
    """The index as Parquet: postings sorted by term (in code-point order) within ranges of terms."""
    posts = index.postings.repartitionByRange(partitions, "term", "doc_id") if partitions else index.postings.repartitionByRange("term", "doc_id")
    posts.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    done = index.postings.sparkSession.read.parquet(f"{path}/postings")  # instead of counting the corpus again
    frequencies(done).write.mode("overwrite").parquet(f"{path}/lexicon")


def read(spark: SparkSession, path: str) -> Index:
    own = Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "stats", "lexicon")))
    return replace(own, figures=own.size())


OPENED: dict[tuple[str, str], Index] = {}


def digest(spark: SparkSession, path: str) -> str:
    """Of the names, lengths and times of a table's files, the same in every process."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hadoop, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def persisted(spark: SparkSession, path: str, make: Callable[[], Index]) -> Index:
    """The index at a path, made and put there first if there is none.

    It is written beside its place and moved there whole, so no reader sees a part of it; of two writers the first one stays."""
    key = (spark.sparkContext.applicationId, path)
    if key in OPENED:
        return OPENED[key]
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        beside = f"{path}.{uuid.uuid4().hex}"
        write(make(), beside)
        if fs.exists(place) or not fs.rename(jvm.Path(beside), place):
            delete(spark, beside)
    OPENED[key] = read(spark, path)
    return OPENED[key]


def lookup(index: Index, term: str) -> DataFrame:
    """``(doc_id, tf)`` of one term; none if the term is not in the index."""
    return index.postings.where(F.col("term") == term).select("doc_id", "tf")
