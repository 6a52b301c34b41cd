import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from textloom.session import get_session

    root = tmp_path_factory.mktemp("spark")
    s = get_session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": f"file://{root}/warehouse", "spark.checkpoint.dir": f"file://{root}/shared"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
