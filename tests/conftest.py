import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL_SF = os.environ.get("LENDWISE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lendwise.session import build_session, ensure_checkpoint_dir

    import tempfile

    s = build_session("local[4]", "lendwise-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g",
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lendwise-warehouse-")})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def projected(spark):
    from lendwise.sources.projection import project

    return project(spark, SMALL_SF)


@pytest.fixture(scope="session")
def duck():
    from compare import duck_connection

    return duck_connection(SMALL_SF)
