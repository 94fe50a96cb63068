import pytest

from ratelens.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, "tests", driver_memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
