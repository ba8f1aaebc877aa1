"""Windows that close, state that empties and rows that come too late."""

import datetime as dt

import pytest

from kilnbase.sources.catalog import load
from kilnbase.streaming import closing as C

SHAPES = {"window": lambda s: C.by_window(s, "1 day"), "session": lambda s: C.by_session(s, "30 minutes"), "chain": lambda s: C.busiest(s, "1 hour", "1 day")}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_state_empties_and_a_replay_is_dropped(spark, sf_dir, shape):
    events = load(spark, sf_dir, "events").where("user_id < 40")
    box = C.Inbox.fresh(spark, "closing")
    closed = C.Closed.begin(box, SHAPES[shape], "closing")
    box.put(events)
    closed.follow()
    assert closed.held() > 0
    box.close(events)
    closed.follow()
    whole = sorted(map(tuple, closed.rows().collect()))
    assert whole and closed.held() == 0 and closed.dropped() == 0
    box.put(events)
    closed.follow()
    assert closed.held() == 0 and closed.dropped() > 0
    assert sorted(map(tuple, closed.rows().collect())) == whole


def test_a_row_within_the_delay_counts_and_one_beyond_it_does_not(spark):
    at = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batch = lambda *rows: spark.createDataFrame([(i, ts, 1, "view", 1.0) for i, ts in rows], schema)
    box = C.Inbox.fresh(spark, "late")
    closed = C.Closed.begin(box, SHAPES["window"], "late")
    for rows in ([(1, at(0)), (2, at(50)), (3, None)], [(4, at(20))], [(5, at(0, 3)), (6, at(11))], [(7, at(60))]):
        box.put(batch(*rows))
        closed.follow()
    # the watermark was at day 10 when 5 came, so day 0 had closed; 6 was within it
    box.close(batch((7, at(60))))
    closed.follow()
    got = {r["start"]: r["n"] for r in closed.rows().collect()}
    assert got == {at(0): 1, at(50): 1, at(20): 1, at(11): 1, at(60): 1} and closed.dropped() == 1


def test_an_empty_inbox(spark):
    closed = C.Closed.begin(C.Inbox.fresh(spark, "none"), SHAPES["window"], "none")
    closed.follow()
    assert closed.rows().isEmpty()
