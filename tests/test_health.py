"""The marker compiler: caps that bind, values withheld and provisional, states of markers, and the steps of a ramp."""

import pytest

from graphloom.operators.health import ARCHITECTURE, AXES, CHANGE_HOTSPOT, MAINTAINABILITY, Axis, Marker, compiled

COLUMNS = "id int, nloc int, analysed boolean, function_count int, max_cyclomatic int, max_nesting int, max_operands int, max_function_nloc int, broad_handlers int, cycle_size int, fan_in int, fan_out int, commits int, usable boolean, c50 double, c95 double, i90 double, i99 double, o90 double, o99 double"
PLAIN = {"nloc": 100, "analysed": True, "function_count": 2, "max_cyclomatic": 1, "max_nesting": 1, "max_operands": 0, "max_function_nloc": 9, "broad_handlers": 0, "cycle_size": 1, "fan_in": 1, "fan_out": 1, "commits": 1, "usable": True, "c50": 2.0, "c95": 12.0, "i90": 5.0, "i99": 15.0, "o90": 4.0, "o99": 20.0}


@pytest.fixture(scope="module")
def judge(spark):
    def run(axis, *changes):
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows = [[k if c == "id" else {**PLAIN, **change}[c] for c in names] for k, change in enumerate(changes)]
        got = compiled(axis, spark.createDataFrame(rows, COLUMNS)).select("id", f"{axis.name}.*").orderBy("id").collect()
        return got

    return run


def states(row):
    return {m.key: m.state for m in row.markers}


def test_category_caps_bind_and_are_told(judge):
    calm, complex_, all_ = judge(MAINTAINABILITY, {}, {"max_cyclomatic": 99, "max_nesting": 99, "max_operands": 99}, {"max_cyclomatic": 99, "max_nesting": 99, "max_operands": 99, "max_function_nloc": 999, "nloc": 5000, "broad_handlers": 9})
    assert (calm.value, calm.categories_capped, calm.axis_capped, calm.provisional, calm.missing) == (10, [], False, None, [])
    assert (complex_.value, complex_.categories_capped) == (6, ["complexity"])  # 2.5 + 1.5 + 1 held to 4
    assert (all_.value, all_.categories_capped, all_.axis_capped) == (1, ["complexity", "size"], False)  # 4 + 3 + 2


def test_the_axis_cap_binds(judge):
    axis = Axis("deep", (Marker("a", "x", 7.0, "nloc", 0, 1), Marker("b", "y", 6.0, "nloc", 0, 1)), {"x": 7.0, "y": 6.0}, ())
    (row,) = judge(axis, {})
    assert (row.value, row.axis_capped, row.categories_capped) == (1, True, [])


def test_files_left_out_and_markers_that_do_not_apply(judge):
    small, unread, constants, unknown = judge(MAINTAINABILITY, {"nloc": 9, "analysed": False}, {"analysed": False}, {"function_count": 0, "nloc": 950}, {"max_nesting": None})
    assert (small.na_reason, small.value, small.markers) == ("too_small", None, None) and unread.na_reason == "no_analyzer"
    assert states(constants) == {"complex_method": "not_applicable", "deep_nesting": "not_applicable", "complex_conditional": "not_applicable", "large_method": "not_applicable", "large_file": "fired", "broad_error_handling": "zero_severity"}
    assert constants.value == pytest.approx(10 - 1.5 * 550 / 1100) and states(unknown)["deep_nesting"] == "no_input" and unknown.value == 10


def test_the_dominant_input_withholds_and_a_lesser_one_does_not(judge):
    whole, no_cycle, no_fan, neither, hub, one_sided = judge(ARCHITECTURE, {"cycle_size": 12}, {"cycle_size": None, "fan_in": 15, "fan_out": 20}, {"fan_in": None, "cycle_size": 2}, {"cycle_size": None, "fan_in": None, "fan_out": None}, {"fan_in": 9, "fan_out": 9}, {"fan_in": 99, "fan_out": 3})
    assert (whole.value, whole.provisional, whole.missing) == (6, None, [])
    assert (no_cycle.value, no_cycle.provisional, no_cycle.missing) == (None, 7, ["cycle_participation"])
    assert no_fan.value == no_fan.provisional == pytest.approx(10 - 4 / 11, abs=1e-6) and no_fan.missing == ["bidirectional_coupling_hub"]
    assert neither.na_reason == "no_graph"
    assert hub.value == pytest.approx(10 - 3 * 5 / 11, abs=1e-6)  # from 4, the lower start, to 15, the lower end
    assert states(one_sided) == {"cycle_participation": "zero_severity", "bidirectional_coupling_hub": "zero_severity"}


def test_the_hotspot_is_a_product_and_a_step_where_history_has_no_width(judge):
    both, step, none, flat = judge(CHANGE_HOTSPOT, {"commits": 12, "max_cyclomatic": 25}, {"commits": 3, "c50": 2.0, "c95": 2.0, "analysed": False}, {"commits": 0}, {"usable": False})
    assert (both.value, both.categories_capped) == (5, []) and step.value == 2.5 and states(step)["complexity_under_churn"] == "not_applicable"
    assert none.na_reason == "no_history" and flat.na_reason == "no_variation"


def test_every_category_has_a_cap_and_every_key_is_one():
    keys = [m.key for a in AXES for m in a.markers]
    assert len(keys) == len(set(keys)) == 10 and all(m.category in a.caps for a in AXES for m in a.markers)
