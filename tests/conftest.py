import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from innkeep.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", app_name="innkeep-tests", conf={"spark.sql.shuffle.partitions": "4"})
    # tests only: a local checkpoint folder when the session names none
    checkpoint_dir(s, str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from innkeep.sources.tables import load_tables

    return load_tables(spark, SF_SMALL)
