"""The registered queries of the text operators against their SQL."""

import os

import pytest

from checks import compare
from termeval.llm.oracles import ORACLES
from termeval.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    assert compare.differences(spark, compare.connect(FOLDER), FOLDER, name) == []
