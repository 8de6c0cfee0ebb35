"""Identifiers written in groups of digits are found by their context, whole."""

import pytest

from linkloom.llm import pii


@pytest.mark.parametrize("said", ["555 123 4567", "(555) 123-4567", "4111 1111 1111 1112", "555.123.4567", "12345"])
def test_groups_are_one_span(spark, said):
    rows = [(k, f"please call +44 20 7946 0{k:03d} today") for k in range(30)] + [(99, f"please call {said} today")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x.start, x.end) for x in got[99].added] == [(12, 12 + len(said))]
    assert not any(got[k].added for k in range(30))
