"""Nested event properties against a plain walk over parsed JSON."""

import json
from collections import Counter

import pytest

from tallyframe.operators.event_properties import property_columns, property_groups, property_paths

TEXTS = [None, "", "no json", "{", "3", "null", "[]", "{}", '{"a": 1}', '{"a": "x", "b": {"c": [1, 2.5, {"d": null}, []]}}',
         '{"a": true, "b": [[1], ["y"]]}', '{"a": {"a": {"a": {"a": 7}}}}', '{"a": 1e3, "long": "' + "z" * 100_000 + '"}', '{"a": 1}']


def walk(value, path, levels):
    kind = ("object" if isinstance(value, dict) else "array" if isinstance(value, list) else "text" if isinstance(value, str)
            else "boolean" if isinstance(value, bool) else "null" if value is None else "number")
    yield path, kind
    if levels and kind in ("object", "array"):
        for key, inner in value.items() if kind == "object" else ((None, v) for v in value):
            yield from walk(inner, path + ("[*]" if key is None else "." + key), levels - 1)


def parsed(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


@pytest.mark.parametrize("levels", [0, 1, 3, 8])
def test_paths(spark, levels):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "path int, properties string")
    want = Counter()
    for good, value in map(parsed, TEXTS):
        if good:
            want.update(walk(value, "$", levels))
    got = property_paths(frame, levels=levels).collect()
    assert {(r["path"], r["kind"]): r["values"] for r in got} == dict(want)


def test_typed_values(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, properties string")
    got = property_columns(frame, {"a": ("$.a", "double"), "c": ("$.b.c[1]", "double")}).orderBy("id").collect()
    assert [r["a"] for r in got] == [None] * 8 + [1.0, None, 1.0, None, 1000.0, 1.0]
    assert [r["c"] for r in got] == [None] * 9 + [2.5] + [None] * 4


def test_groups_and_empty_tables(spark):
    rows = [('{"g": "x", "n": 1}',), ('{"g": "x", "n": "no"}',), ('{"n": 4}',), (None,)]
    frame = spark.createDataFrame(rows, "properties string")
    got = {r["value"]: (r["events"], r["measured"], r["total"], r["largest"]) for r in property_groups(frame, "$.g", "$.n").collect()}
    assert got == {"x": (2, 1, 1.0, 1.0), None: (2, 1, 4.0, 4.0)}
    none = frame.limit(0)
    assert property_paths(none).collect() == [] and property_groups(none, "$.g", "$.n").collect() == []


def test_text_is_parsed_once(spark):
    frame = spark.createDataFrame([('{"a": 1}',)], "properties string")
    plan = property_paths(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.count("Exchange hashpartitioning") == 1
