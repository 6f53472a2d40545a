import pytest

from filament.runtime import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
