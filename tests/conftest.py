import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build, clean

    session = build("local[4]", "tests", spark__sql__shuffle__partitions=4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clean(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
