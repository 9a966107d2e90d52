"""Operators with Python workers on a cluster whose executors don't find the package by themselves."""

import re

import pytest
from tests.test_session import on_a_cluster


@pytest.mark.parametrize(("name", "rows"), [("op12_merkle_manifest", 200), ("op13_warc", 50)])
def test_arrow_and_data_source_workers_get_the_package(tmp_path, name, rows):
    said = on_a_cluster(tmp_path, name)
    assert re.search(rf"ROWS {rows} True", said), said[-3000:]
