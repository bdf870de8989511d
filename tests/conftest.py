import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridtide.builtins import install
    from gridtide.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    install()
    yield session
    session.stop()


@pytest.fixture
def cube_of(spark):
    """Cube of one cell from a start time, a step and values."""
    import datetime as dt

    def make(start: str, hours: int, values, name: str = "value"):
        first = dt.datetime.fromisoformat(start)
        rows = [
            (first + dt.timedelta(hours=hours * i), 2.0, 1.0, None if v is None else float(v))
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"t timestamp_ntz, y double, x double, {name} double")

    return make
