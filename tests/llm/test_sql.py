"""Queries of the text operators beside their SQL twins."""

import sys
from pathlib import Path

import pytest
from samples import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import compare, connect  # noqa: E402

from riskweave.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    same, text = compare(spark, connect(SF), SF, name)
    assert same, text


def test_there_is_a_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
