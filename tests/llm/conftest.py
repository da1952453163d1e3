import pytest
from pyspark.sql import types as T


@pytest.fixture
def crawled(spark):
    """Makes rows of the crawled table from dicts; columns that are not given are null."""

    def make(rows):
        kinds = {"crawl_id": T.LongType(), "source_id": T.IntegerType(), "price": T.DoubleType(), "specs": T.MapType(T.StringType(), T.StringType())}
        names = ["crawl_id", "source_id", "name", "external_url", "brand", "category", "price", "specs", *sorted({k for r in rows for k in r} - {"crawl_id", "source_id", "name", "external_url", "brand", "category", "price", "specs"})]
        schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return make
