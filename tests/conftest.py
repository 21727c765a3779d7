import pytest

from parcelspark.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "parcelspark-tests", master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RINGS = "array<array<struct<x:double,y:double>>>"


def square(x, y, side, h=None):
    h = side if h is None else h
    return [(x, y), (x + side, y), (x + side, y + h), (x, y + h), (x, y)]


def to_rings(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


@pytest.fixture(scope="session")
def make_layer(spark):
    def make(rows, scope=True):
        """rows: (project, id, [ring, ...])"""
        data = [(p, i, to_rings(*rings)) for p, i, rings in rows]
        return spark.createDataFrame(data, f"project_id long, id long, rings {RINGS}")

    return make
