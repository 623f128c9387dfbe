import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of documents tables from texts or (id, text) pairs; extra columns have names that operators use inside."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOC)
        if extra:
            for c in ("w", "row", "keep", "h", "n", "key", "shard", "digest", "label", "y", "rate", "half"):
                df = df.selectExpr("*", f"'{c}' AS `{c}`")
        return df

    return make
