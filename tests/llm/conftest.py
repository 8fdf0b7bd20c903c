import pytest

from loomwork.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
