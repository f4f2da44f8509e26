import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strandmill.plans.runtime import local_session

    session = local_session(4, 2)
    session.sparkContext.setLogLevel("ERROR")
    # Small tables: compiling each plan takes longer than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()
