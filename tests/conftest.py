import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from roadloom.session import session

    folder = str(tmp_path_factory.mktemp("checkpoints"))
    s = session("local[4]", 4, **{"spark.checkpoint.dir": folder, "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
