"""Columns of an export."""

import pytest

from tracelake.operators.sessions import SENSITIVE, export_columns, export_events


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("s", 2, "b", "t2"), ("s", 1, "a", "t1")], "session_id string, event_order int, event_kind string, text_content string")


def test_defaults_and_all_leave_sensitive_out(rows):
    assert export_columns(rows) == ["session_id", "event_order", "event_kind"]
    assert not set(export_columns(rows, ["all"], True)) & set(SENSITIVE)


def test_sensitive_only_on_request(rows):
    with pytest.raises(ValueError, match="text_content"):
        export_columns(rows, ["session_id", "text_content"])
    got = export_events(rows, {}, ["text_content"], everything=True, sensitive=True).collect()
    assert [r["text_content"] for r in got] == ["t1", "t2"]


@pytest.mark.parametrize("names", [[], ["session_id", "session_id"], ["session_id", "nothing"]])
def test_names_are_known_and_once(rows, names):
    with pytest.raises(ValueError, match="columns"):
        export_columns(rows, names)
