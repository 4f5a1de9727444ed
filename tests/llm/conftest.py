import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A table of rows with clashing extra columns beside it."""

    def make(schema, rows, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            for name in ("node", "label", "key", "kept", "spans", "score", "rank", "_hash", "part"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make
