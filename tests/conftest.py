import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from genespark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(cores="8", shuffle_partitions=8, app="tests", memory="8g", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(params=[1, 4, 17])
def partitions(spark, request):
    """Run a test with several shuffle widths."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
