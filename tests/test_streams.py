"""Streams that keep state: the ladder of a delivery by itself, and a queue that is killed and started again."""

import time

import pytest
from pyspark.sql import Row

from proofgrid.streaming import delivery


class Held:
    """A value and timers, as the operator's handle gives them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def given(attempt, error=None, payload=None):
    return Row(id=7, attempt=attempt, error=error, payload=payload)


@pytest.fixture
def ladder():
    x = delivery.Ladder(1000, 50_000)
    x.init(Held())
    return x


def steps(ladder, now, *rows):
    return [(r.kind, r.attempt, r.wait, r.payload) for r in ladder.handleInputRows((7,), iter(rows), Clock(now))]


def fired(ladder, now):
    return [(r.kind, r.attempt, r.payload) for r in ladder.handleExpiredTimer((7,), Clock(now), None)]


def test_ladder_waits_longer_and_fails_at_the_fifth(ladder):
    assert steps(ladder, 0, given(0, payload="p")) == [("send", 1, None, "p")]
    now = 0
    for n in range(1, 5):
        assert steps(ladder, now, given(n, "no")) == [("retry", n, 2**n, None)]
        now += 2**n * 1000
        assert ladder.handle.timers[-1] == now
        assert fired(ladder, now) == [("send", n + 1, "p")]
    assert steps(ladder, now, given(5, "no")) == [("failed", 5, None, None)]
    assert ladder.handle.value == (5, "failed", None)  # the payload goes at once
    assert ladder.handle.timers[-1] == now + 50_000 and fired(ladder, now + 50_000) == [] and not ladder.handle.exists()
    assert fired(ladder, now + 50_000) == []


def test_ladder_ignores_repeats_and_outcomes_not_awaited(ladder):
    assert steps(ladder, 0, given(3, "no")) == [] and not ladder.handle.exists()
    assert steps(ladder, 0, given(0), given(0)) == [("send", 1, None, None)]
    assert steps(ladder, 1, given(2)) == []
    assert steps(ladder, 1, given(1), given(1, "no")) == [("delivered", 1, None, None)]
    assert steps(ladder, 2, given(0), given(2, "no")) == []


def test_ladder_cuts_errors(ladder):
    rows = list(ladder.handleInputRows((7,), iter([given(0), given(1, "x" * 900)]), Clock(0)))
    assert [len(r.error or "") for r in rows] == [0, 500]


def test_queue_sends_nothing_twice_after_a_restart(spark, tmp_path):
    """The second batch fails after its outcomes are written; Spark runs it again, and no call is made again. Null ids go, a call that raises is an error."""
    src, calls = str(tmp_path / "in"), tmp_path / "calls"
    calls.mkdir()
    spark.sql("SELECT id, to_json(named_struct('n', id)) AS payload FROM range(60) UNION ALL SELECT 3, 'again' UNION ALL SELECT NULL, 'none'").write.parquet(src)

    def deliver(f):
        with open(calls / f"{time.time_ns()}-{f['id'].iloc[0]}", "w") as out:
            out.writelines(f"{i} {a}\n" for i, a in zip(f["id"], f["attempt"], strict=True))
        if (f["attempt"] == 1).all():
            raise OSError("down")
        return [None] * len(f)

    class Killed(delivery.Queue):
        dead = False

        def batch(self, rows, batch_id):
            super().batch(rows, batch_id)
            if self.outcomes().count() and not self.dead:
                self.dead = True
                raise RuntimeError("killed")

    q = Killed(spark, str(tmp_path / "q"), deliver, unit=0.01)
    deliveries = spark.readStream.schema("id long, payload string").parquet(src)
    with pytest.raises(Exception, match="killed"):
        q.start(deliveries, "0 seconds").awaitTermination(120)
    assert q.dead and q.ended() == 0
    stream, end = q.start(deliveries, "0 seconds"), time.monotonic() + 120
    while not stream.awaitTermination(1) and q.ended() < 60 and time.monotonic() < end:
        pass
    stream.stop()
    rows = q.deliveries().collect()
    assert sorted(r.id for r in rows) == list(range(60))
    assert {(r.status, r.attempts, r.waited, r.last_error) for r in rows} == {("delivered", 2, 2, None)}
    assert {r.error for r in q.history().filter("kind = 'retry'").collect()} == {"OSError: down"}
    made = [line for f in calls.iterdir() for line in f.read_text().splitlines()]
    assert sorted(made) == sorted(f"{i} {a}" for i in range(60) for a in (1, 2))


def test_queue_takes_the_ladders_steps(spark, tmp_path, ladder):
    """Deliveries that fail n times take the steps that the stateful ladder takes, an id that comes again changes nothing, and thousands do not need calls of their own (F1)."""
    src, n = str(tmp_path / "in"), 20_000
    spark.range(2 * n).selectExpr(f"id % {n} AS id", "'p' AS payload").write.parquet(src)
    q = delivery.Queue(spark, str(tmp_path / "q"), lambda f: ("x" * 900 if a <= i % 6 and p == "p" else None for i, a, p in zip(f["id"], f["attempt"], f["payload"], strict=True)), unit=0.01)
    stream, end = q.start(spark.readStream.schema("id long, payload string").parquet(src), "0 seconds"), time.monotonic() + 60
    while not stream.awaitTermination(1) and q.ended() < n and time.monotonic() < end:
        pass
    stream.stop()
    assert q.ended() == n and q.outcomes().count() == n // 6 * (1 + 2 + 3 + 4 + 5 + 5) + sum(min(i % 6, 4) + 1 for i in range(n // 6 * 6, n))
    for i in range(6):
        want = [("send", 1, None)]
        steps(ladder, 0, given(0))
        for a in range(1, 6):
            made = steps(ladder, 0, given(a, "no" if a <= i else None))
            want += [(kind, attempt, wait) for kind, attempt, wait, _ in made]
            if made[0][0] != "retry":
                break
            want += [(kind, attempt, None) for kind, attempt, _ in fired(ladder, 0)]
        ladder.handle.value = None
        got = q.history().filter(f"id = {i}").collect()
        assert sorted((r.attempt, r.kind != "send", r.kind, r.wait) for r in got) == sorted((a, k != "send", k, w) for k, a, w in want)
        assert {len(r.error) for r in got if r.error is not None} <= {500}
