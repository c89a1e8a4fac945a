import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with columns whose names operators might use themselves."""
    def f(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] or ("en", "s0")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in ("id", "row", "size", "key", "rank", "word", "bits", "n", "copies", "site", "pos", "fp", "toxicity", "lines_removed_", "bucket", "length"):
                from pyspark.sql import functions as F
                df = df.withColumn(name, F.lit("x"))
        return df
    return f


@pytest.fixture(scope="session")
def documents(spark):
    from tests.conftest import SF
    return spark.read.parquet(f"{SF}/documents.parquet")
