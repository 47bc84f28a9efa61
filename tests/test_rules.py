"""Calendar, text and rectangle rules. The time stamps and what they become are fixed values that must hold for the rules."""

import pytest

from geotide.functions.geometry import parse_collection, parse_wkt
from geotide.functions.timeops import Step, TimeShift, add, parse, snap
from geotide.model import QueryError, Rect


def test_calendar():
    assert add(1420070400, "days", 5) == 1420502400
    assert snap(1443398401, "dayInMonth", 5, True) == 1441411200 and snap(1443398401, "dayInMonth", 31, True) == 1443571200
    assert snap(1443398401, "seasonInYear", 1, False) == 1422403201
    assert snap(1443571201, "dayInWeek", 1, True) == 1443398400 and snap(1443571201, "hourOfDay", 10, True) == 1443607200
    shift = TimeShift(Step("days", -5), Step("minutes", 5))
    with pytest.raises(QueryError):
        shift.reverse(0.0, 1.0)
    assert shift.apply(1420070400, 1420070401) == (1419638400, 1420070701)
    assert shift.reverse(1419638400, 1420070701) == (1420070400, 1420070401)


def test_time_texts():
    assert parse("2015-11-11T11:11:11", "iso") == 1447240271
    assert parse("1970-01-01 00:00:00+01", "custom", "%Y-%m-%d %H:%M:%S%z") == -3600
    with pytest.raises(QueryError):
        parse("2015-11-32T11:11:11", "iso")


def test_well_known_text():
    assert [k for k, _ in parse_collection("GEOMETRYCOLLECTION(POINT(0 0), MULTIPOINT((3 4), (5 5)))")] == ["points", "points"]
    with pytest.raises(QueryError):
        parse_wkt("POLYGON((0 0, 1 1, 0 0))")


def test_rectangles():
    with pytest.raises(QueryError):
        Rect(1, 0, 0, 1)
    with pytest.raises(QueryError):
        Rect(0, 0, 1, 1, 5, 5)
