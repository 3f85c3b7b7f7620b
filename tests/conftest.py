import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dashloom.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = (builder("tests", spark__checkpoint__dir=str(folder),
                       spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
                       spark__driver__memory="4g",
                       spark__sql__maxMetadataStringLength="10000")
               .master("local[4]").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df):
    """Rows as sorted tuples, floats as they are."""
    return sorted((tuple(r) for r in df.collect()),
                  key=lambda t: tuple((v is not None, str(type(v)), v) for v in t))


def at(minutes, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minutes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
