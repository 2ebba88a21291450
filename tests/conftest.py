import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wattline.session import ROWS_PER_TASK_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pieces(spark):
    """Cut keys longer than the given number of rows, as happens with hot keys."""
    before = spark.conf.get(ROWS_PER_TASK_KEY, None)

    def use(rows):
        spark.conf.set(ROWS_PER_TASK_KEY, str(rows))

    yield use
    if before is None:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    else:
        spark.conf.set(ROWS_PER_TASK_KEY, before)
