"""Registered queries beside their SQL on small tables made for it."""

import duckdb
import pandas as pd
import pytest

from talkframe.plans.catalog import QUERIES, SQL


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given tables, sorted."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in tables.items():
        rows.to_parquet(f"{folder}/{table}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    theirs = con.execute(SQL[name]).df()
    columns = sorted(theirs.columns)
    mine = QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(mine.columns) == columns
    listed = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    return listed(mine), listed(theirs)


def test_a_meeting_holds_a_thousand_events(spark, tmp_path):
    events = pd.DataFrame({"event_id": range(40_990, 42_010, 7)})
    events["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(events.event_id, unit="s")
    events["user_id"], events["event_type"], events["value"] = events.event_id % 9, "error", 5.0
    mine, theirs = both(spark, tmp_path, "finalized_meetings", events=events)
    assert mine == theirs and len(mine) == 3


@pytest.mark.parametrize("name", ["live_flags", "live_stream"])
def test_a_repeat_at_exactly_the_rate_limit(spark, tmp_path, name):
    """Twenty characters in 0.8 seconds: which side of the limit they fall on is a matter of the last bit."""
    first = ["x" * n for n in range(5, 60)]
    said = pd.DataFrame([(m, turn, "user", text) for m, one in enumerate(first) for turn, text in enumerate([one, "thea eaor aning rethea"])], columns=["conv_id", "turn", "role", "text"])
    mine, theirs = both(spark, tmp_path, name, conversations=said)
    assert mine == theirs
