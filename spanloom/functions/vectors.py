"""Embedding vectors as columns: a deterministic hash, a stored table, or a model on demand."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_vector(text: Column) -> Column:
    """Sixteen numbers between 0 and 1 from a text's SHA-256. Equal texts have equal vectors; others
    are unrelated, so this only recognises repetition word for word."""
    return _digest_vector(F.sha2(text, 256))


def _digest_vector(digest: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero, an error if their lengths differ, null if one is."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors of different lengths")).cast("double")
    )


def cache_key(text: Column, model: str, revision: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(revision), text), 256)


class Embedder(Protocol):
    """Adds a column of vectors for a column of texts, or for what ``carried`` makes of them.

    Pairs carry that instead of the text; it should be short.
    """

    def vectors(self, df: DataFrame, text: str, into: str) -> DataFrame: ...

    def carried(self, text: Column) -> Column: ...

    def vectors_of_carried(self, df: DataFrame, carried: str, into: str) -> DataFrame: ...


class HashEmbedder:
    def carried(self, text: Column) -> Column:
        return F.sha2(text, 256)

    def vectors_of_carried(self, df: DataFrame, carried: str, into: str) -> DataFrame:
        return df.withColumn(into, _digest_vector(F.col(carried)))

    def vectors(self, df: DataFrame, text: str, into: str) -> DataFrame:
        return df.withColumn(into, hash_vector(F.col(text)))


class TableEmbedder:
    """Vectors from a table (``key``, ``vector``), joined on the key; texts without one get null."""

    def __init__(self, table: DataFrame, model: str, revision: str) -> None:
        if not model or not revision:
            raise ValueError("an embedder needs a model and a revision")
        self.table, self.model, self.revision = table, model, revision

    def carried(self, text: Column) -> Column:
        return cache_key(text, self.model, self.revision)

    def vectors_of_carried(self, df: DataFrame, carried: str, into: str) -> DataFrame:
        known = self.table.select(F.col("key").alias(carried), F.col("vector").cast("array<double>").alias(into))
        return df.join(known, carried, "left")

    def vectors(self, df: DataFrame, text: str, into: str) -> DataFrame:
        keyed = df.withColumn("__key", self.carried(F.col(text)))
        return self.vectors_of_carried(keyed, "__key", into).drop("__key")


class CachedEmbedder:
    """A model behind a stored table: only texts that the table lacks are embedded, each once.

    ``load`` makes, once per Python worker, the function that embeds a list of texts.
    """

    def __init__(self, path: str, model: str, revision: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
        if not model or not revision:
            raise ValueError("an embedder needs a model and a revision")
        self.path, self.model, self.revision, self.load = path, model, revision, load

    def _stored(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema("key string, vector array<double>").parquet(self.path)
        return spark.createDataFrame([], "key string, vector array<double>")

    def carried(self, text: Column) -> Column:
        return text  # a model needs the whole of it

    def vectors_of_carried(self, df: DataFrame, carried: str, into: str) -> DataFrame:
        return self.vectors(df, carried, into)

    def vectors(self, df: DataFrame, text: str, into: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(model(texts.tolist()))

        wanted = df.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct().withColumn("key", cache_key(F.col("t"), self.model, self.revision))
        missing = wanted.join(self._stored(df), "key", "left_anti").select("key", embed("t").alias("vector"))
        missing.write.mode("append").parquet(self.path)
        return TableEmbedder(self._stored(df), self.model, self.revision).vectors(df, text, into)
