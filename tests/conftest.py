import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wavecohort.session import get_spark
    wh = tempfile.mkdtemp(prefix="wavecohort-wh-")
    s = get_spark("local[4]", shuffle_partitions=4, conf={"spark.sql.warehouse.dir": wh,
                                                          "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmpdir_session():
    return tempfile.mkdtemp(prefix="wavecohort-test-")


SF_SMALL = "/root/testdata/sf0.001"
