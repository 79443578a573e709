import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lendscope.session import build_session, checkpoint_dir

    s = build_session("local[*]", "lendscope-tests", shuffle_partitions=8)
    checkpoint_dir(s, fallback=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def apps_mid(spark):
    from lendscope.sources.tables import applications

    return applications(spark, SF_MID).cache()
