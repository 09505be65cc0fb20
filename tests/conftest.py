import pytest

from textloom.session import open_session, ship


@pytest.fixture(scope="session")
def spark():
    session = open_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
