import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of rows by a DDL schema, with an extra column whose name clashes."""

    def make(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if not extra:
            return df
        from pyspark.sql import functions as F

        for name in ("score", "component", "words", "bucket", "digest", "a"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
