import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tableprep.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__maxMetadataStringLength="10000", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "out")


def rows(df, *order):
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)


@pytest.fixture(name="rows")
def rows_fixture():
    return rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(name="plan_of")
def plan_of_fixture():
    return plan_of
