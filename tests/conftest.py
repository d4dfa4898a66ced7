from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quittance.plans.publish import Warehouse  # noqa: E402
from quittance.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="quittance-tests")
    session.sparkContext.setLogLevel("OFF")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


@pytest.fixture(autouse=True)
def no_public_views_left(request):
    """All tests share one session's catalogue: a view that one leaves would be foreign to the next."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").sql("DROP DATABASE IF EXISTS public CASCADE")
