"""One small local session for all tests."""

from __future__ import annotations

import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    out = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
