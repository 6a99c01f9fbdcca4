import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    os.environ.setdefault("PANELFORGE_SCRATCH", tempfile.mkdtemp(prefix="pf-tests-"))
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from panelforge.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


def rows(df, digits=9):
    """Order-free comparable rows: floats rounded, NaN/None unified."""
    import math
    out = []
    for r in df.collect():
        t = []
        for v in r:
            if isinstance(v, float):
                v = None if math.isnan(v) else round(v, digits) + 0.0
            t.append(v)
        out.append(tuple(t))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
