"""Every training-data query on hostile and empty tables."""

import pytest

from tests.hostile import empty_copy, hostile_copy, rows
from vellum.llm import queries as Q


@pytest.fixture(scope="module")
def bad(spark, data, tmp_path_factory):
    return hostile_copy(spark, data, tmp_path_factory.mktemp("hostile"))


@pytest.fixture(scope="module")
def none(spark, data, tmp_path_factory):
    return empty_copy(spark, data, tmp_path_factory.mktemp("empty"))


#: Confidences and container numbers depend on batches in their last digits or by name; their keys must agree.
LOOSE = {"p10_languages": ["doc_id", "seg_no", "lang"], "p10_segments": ["doc_id", "seg_no", "run_no", "first_word", "words", "lang"], "p8_containers": ["doc_id", "piece_no", "tokens"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_hostile(spark, data, bad, name):
    call = Q.queries()[name]
    a, b = call(spark, bad), call(spark, data)
    if name in LOOSE:
        a, b = a.select(LOOSE[name]), b.select(LOOSE[name])
    if name != "p8_report":
        assert rows(a) == rows(b)
    else:
        assert a.first()["tokens"] == b.first()["tokens"]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty(spark, none, name):
    assert Q.queries()[name](spark, none).count() == (1 if name == "p8_report" else 0)
