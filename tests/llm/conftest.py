import pytest


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a table of a fresh folder and returns that folder."""

    def write(rows, schema, name="documents"):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
