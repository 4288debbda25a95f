from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dropledger.session import local_session
    s = local_session(cpus=4, shuffle_partitions=4, app_name="dropledger-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)


def rows(df, *cols):
    """Collected rows as plain tuples (selected columns, in order)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
