import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from frostline.session import local_session

    session = local_session(4, "tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def plan():
    """Physical plan text of a DataFrame."""

    def text(df):
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
        return df._jdf.queryExecution().explainString(mode.fromString("formatted"))

    return text
