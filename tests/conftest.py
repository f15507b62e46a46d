import os
import sys

import pytest

for folder in (os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))):
    sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def spark():
    from driftmark.session import build_session

    session = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g", "spark.sql.streaming.numRecentProgressUpdates": "5",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from driftmark.sources.tables import Tables
    from tables_in_use import SF

    return Tables(spark, SF)
