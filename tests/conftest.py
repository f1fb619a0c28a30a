import pytest

from rosterlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column function on one string value."""

    def run(fn, text, kind="string"):
        df = spark.createDataFrame([(text,)], f"c {kind}")
        return df.select(fn("c").alias("v")).first()["v"]

    return run
