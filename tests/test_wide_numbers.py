"""Sums of durations that pass 64 bits on large tables."""

from datetime import datetime, timedelta

import pytest

from braidflow.plans import QUERIES

SPAN = 140 * 365 * 86_400 * 10**9


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two events for each of three users, 140 years apart with one session between them."""
    d = str(tmp_path_factory.mktemp("wide"))
    start = datetime(1970, 1, 1)
    rows = [(u + 3 * k, u, start + timedelta(days=140 * 365 * k), "view", 1.0) for u in range(3) for k in range(2)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d


def test_totals_of_durations(spark, folder, monkeypatch):
    from braidflow.plans import q_flow

    monkeypatch.setattr(q_flow, "IDLE", SPAN + 1)
    monkeypatch.setattr(q_flow, "TIMEOUTS", [q_flow.HOUR, SPAN + 1])
    got = QUERIES["a06_session_profile"](spark, folder).first()
    assert (got["sessions"], int(got["total"]), got["longest"]) == (3, 3 * SPAN, SPAN) and 3 * SPAN > 2**63
    by = {r["timeout"]: r for r in QUERIES["w22_timeout_survey"](spark, folder).collect()}
    assert (by[SPAN + 1]["sessions"], int(by[SPAN + 1]["total"])) == (3, 3 * SPAN)
    assert (by[q_flow.HOUR]["sessions"], int(by[q_flow.HOUR]["total"])) == (6, 0)


@pytest.mark.parametrize("name", ["a06_session_profile", "w22_timeout_survey"])
def test_totals_are_bigint_where_they_fit(spark, sf_dir, name):
    assert dict(QUERIES[name](spark, sf_dir).dtypes)["total"] == "bigint"
