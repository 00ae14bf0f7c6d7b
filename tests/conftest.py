from __future__ import annotations

import pytest

from wardenry.session import local_session
from wardenry.sources.versioned import TableStore


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file:{tmp_path}/store")
