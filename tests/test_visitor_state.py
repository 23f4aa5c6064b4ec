"""The visitor history from daily snapshots against the one from all shards."""

import random
import uuid

import pytest
from conftest import session_rows
from pyspark.sql import functions as F

from weblytics.operators import history, visitor_state
from weblytics.operators.visitor_state import VisitorState
from weblytics.session import work_dir
from weblytics.sources import versions

COLUMNS = ["fullVisitorId", "visitId", "visit_date", "visit_frequency", "total_transaction_value"]
DAYS = [f"202401{d:02d}" for d in range(1, 8)]


@pytest.fixture(scope="module")
def sessions(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        visitor = rng.choice(["hot", "hot", None, *[f"v{k}" for k in range(20)]])
        rows.append({"fullVisitorId": visitor, "visitId": i, "date": rng.choice(DAYS[:5] + DAYS[6:]),
                     "totals.transactionRevenue": rng.choice([None, None, i])})
    return session_rows(spark, rows).persist()


def state(spark):
    return VisitorState(spark, f"{work_dir(spark)}/test-state/{uuid.uuid4().hex}")


def shard(sessions, day):
    return sessions.where(F.col("date") == day)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("order", [DAYS, [DAYS[0], *DAYS[2:5], DAYS[1], *DAYS[5:]], list(reversed(DAYS))])
def test_equals_the_whole_history_in_any_order(spark, sessions, order):
    s = state(spark)
    for day in order:               # one day has no sessions
        s.enter(day, shard(sessions, day))
    assert s.days() == DAYS
    got = [r for day in DAYS for r in rows(s.history(day, shard(sessions, day)))]
    assert sorted(got, key=str) == rows(history.prior_days(sessions))


def test_seed_then_days(spark, sessions):
    s = state(spark)
    s.seed(DAYS[2], sessions.where(F.col("date") <= DAYS[2]))
    for day in DAYS[3:]:
        s.enter(day, shard(sessions, day))
    want = history.prior_days(sessions).where(F.col("visit_date") > F.to_date(F.lit(DAYS[2]), "yyyyMMdd"))
    assert sorted((r for d in DAYS[3:] for r in rows(s.history(d, shard(sessions, d)))), key=str) == rows(want)
    with pytest.raises(versions.AlreadyPresent):
        s.seed(DAYS[0], sessions)


def test_no_day_counts_twice(spark, sessions, monkeypatch):
    s = state(spark)
    for day in (DAYS[0], DAYS[2], DAYS[3]):
        s.enter(day, shard(sessions, day))
    with pytest.raises(versions.AlreadyPresent):
        s.enter(DAYS[2], shard(sessions, DAYS[2]))
    # a late run dies after the first of two later snapshots, then runs again
    real, calls = VisitorState._store, []

    def dies(self, day, *args, **kwargs):
        calls.append(day)
        if len(calls) == 2:
            raise RuntimeError("killed")
        real(self, day, *args, **kwargs)

    monkeypatch.setattr(VisitorState, "_store", dies)
    with pytest.raises(RuntimeError):
        s.enter(DAYS[1], shard(sessions, DAYS[1]))
    monkeypatch.undo()
    assert DAYS[1] not in s.days()
    s.enter(DAYS[1], shard(sessions, DAYS[1]))
    want = visitor_state.sums(sessions.where(F.col("date") <= DAYS[3]))
    assert sorted(map(tuple, s.snapshot(DAYS[3]).collect())) == sorted(map(tuple, want.collect()))


def test_a_day_reads_its_shard_only(spark, store):
    days = store.shards()
    s = state(spark)
    s.seed(days[4], store.between(days[0], days[4]))
    from test_plans import _formatted
    text = _formatted(s.history(days[5], store.shard(days[5])))
    assert f"(_table_suffix#" in text and f"= {days[5]})" in text
    assert s.before(days[0]).count() == 0
