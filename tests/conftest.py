import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="faultline-test-")
    s = get_spark("local[4]", app="faultline-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": scratch, "spark.local.dir": scratch})
    yield s


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
