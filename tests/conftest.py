import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from longview.session import local_session
    s = local_session("tests", 4, "6g")
    # Tiny tables: fewer partitions and no generated code make the suite several times faster.
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""
    def f(df, *cols):
        d = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in d.collect()), key=str)
    return f
