import pytest


@pytest.fixture(autouse=True, scope="package")
def generated_code(spark):
    """The corpus operators run as on a cluster: exploding a long text without
    generated code copies its whole array for every word."""
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", before)
