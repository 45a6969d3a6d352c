"""Company files without a schema, tables updated in place, as-of joins, and claims about peers."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import asof, compare, runs
from proofgrid.operators import facts as X
from proofgrid.plans import queries as plans
from proofgrid.plans import reports
from proofgrid.sources import buckets, folders
from proofgrid.sources import filings as S


def test_company_files_keep_what_nothing_knows(spark, tmp_path):
    fact = {"end": "2020-12-31", "val": 5, "fy": 2020, "form": "10-K", "filed": "2021-02-03"}
    a = {"cik": 1, "facts": {"us-gaap": {"Sales": {"label": "Net sales outlook", "description": None, "units": {"USD": [fact, {**fact, "segments": [1], "dimension": "x", "val": 2.5}], "odd": "no list"}}, "Tax": {"label": "Forecast", "units": {}}}, "dei": {}, "srt": 7}}
    (tmp_path / "deep").mkdir()
    (tmp_path / "_raw_AAA.json").write_text(json.dumps(a))
    (tmp_path / "deep" / "_raw_B.B.json").write_text(json.dumps({"facts": None}))
    (tmp_path / "_raw_bad.json").write_text('{"facts": {')
    (tmp_path / "other.json").write_text(json.dumps(a))
    c = S.read_companies(spark, str(tmp_path))
    assert {r.entity: r.there for r in c.select("entity", F.col("company").isNotNull().alias("there")).collect()} == {"AAA": True, "B.B": True, "bad": False}
    concepts = S.concepts(c)
    assert sorted((r.entity, r.taxonomy, r.tag, r.label, r.description) for r in concepts.drop("units").collect()) == [("AAA", "us-gaap", "Sales", "Net sales outlook", None), ("AAA", "us-gaap", "Tax", "Forecast", None)]
    assert {r.tag: r.candidate for r in X.guidance(concepts.drop("units")).collect()} == {"Sales": True, "Tax": False}
    raw = S.raw_facts(concepts)
    assert sorted((r.pos, r["keys"]) for r in raw.select("pos", "keys").collect()) == [(0, ["end", "filed", "form", "fy", "val"]), (1, ["dimension", "end", "filed", "form", "fy", "segments", "val"])]
    s = X.segments(raw).first()
    assert (s.entity, s.n_facts, s.n) == ("AAA", 2, 1) and [(e.tag, e.unit, e.pos, e.segment_keys) for e in s.examples] == [("Sales", "USD", 1, ["dimension", "segments"])]
    got = {r.pos: r for r in S.typed_facts(raw).collect()}
    assert (got[0].val, got[1].val, str(got[0].end), str(got[0].filed), got[0].fy, got[0].start, got[0].form) == (5.0, 2.5, "2020-12-31", "2021-02-03", 2020, None, "10-K")
    assert S.read_companies(spark, str(tmp_path), "none").count() == 0


def test_ten_tickers_open_ten_files(spark, tmp_path):
    """Files that can't be opened fail the job, so those of other tickers are not opened."""
    for i in range(300):
        (tmp_path / f"T{i}.json").write_text(json.dumps({"ticker": f"T{i}", "raw": f"[{i}]"}) if i % 30 == 7 else "")
        if i % 30 != 7:
            (tmp_path / f"T{i}.json").unlink()
            (tmp_path / f"T{i}.json").symlink_to(tmp_path / "gone")
    tickers = [f"t{i}" for i in range(7, 300, 30)]
    assert {r.doc_id: r.raw for r in S.read_replay_folder(spark, str(tmp_path), tickers).collect()} == {f"T{i}": f"[{i}]" for i in range(7, 300, 30)}
    reader = folders.FolderReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([folders.In(("entity",), ("T7", "T37", "none")), folders.EqualTo(("text",), "x"), folders.EqualTo(("entity",), "T37")])) == [folders.EqualTo(("text",), "x")]
    assert [f[0] for p in reader.partitions() for f in p.files] == ["T37"]


def stamps(path: Path) -> dict:
    return {p.relative_to(path).parts[0]: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_updates_rewrite_touched_buckets_only(spark, tmp_path):
    rows = spark.range(2000).select("id", F.lit("old").alias("state"), F.lit(0).alias("attempts"))
    t = buckets.Table(spark, str(tmp_path / "t"), ["id"], 32).create(rows)
    before = stamps(tmp_path / "t" / "data")
    changes = spark.createDataFrame([(i, "new") for i in range(0, 2000, 400)] + [(99_999, "nobody")], "id long, state string")
    touched = {f"bucket={r[0]}" for r in changes.select(t.bucket()).collect()}
    assert t.update(changes) == len(touched) < 10
    after = stamps(tmp_path / "t" / "data")
    assert {b for b in after if after[b] != before.get(b)} == touched - (touched - set(before))
    assert {(r.id, r.attempts) for r in t.read().filter("state = 'new'").collect()} == {(i, 0) for i in range(0, 2000, 400)} and t.read().count() == 2000
    assert t.append(spark.createDataFrame([(5, "again"), (5000, "first"), (5000, "first")], "id long, state string")) <= 2
    assert [tuple(r) for r in t.read().filter("id in (5, 5000)").orderBy("id").collect()] == [(5, "old", 0), (5000, "first", None)]
    assert not list((tmp_path / "t").glob("staged*")) and t.update(changes.limit(0)) == 0
    with pytest.raises(ValueError, match="share"):
        t.update(spark.createDataFrame([(1, "a"), (1, "b")], "id long, state string"))


def test_of_two_writers_one_fails_and_keys_hold(spark, tmp_path):
    t = buckets.Table(spark, str(tmp_path / "t"), ["id"], 4).create(spark.range(10).withColumn("v", F.lit(1)))
    other = buckets.Table(spark, str(tmp_path / "t"), ["id"], 4)
    more = spark.range(8, 14).withColumn("v", F.lit(2))
    with t._alone(), pytest.raises(buckets.Busy):
        other.append(more)
    assert t.read().count() == 10
    other.append(more)
    t.append(more)
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(i, 1 if i < 10 else 2) for i in range(14)]
    # a job that fails leaves the table as it was, and unlocked
    bad = spark.range(20, 22).withColumn("v", F.expr("cast(assert_true(id < 21) as int)"))
    with pytest.raises(Exception, match="is not true"):
        t.append(bad)
    assert t.read().count() == 14
    t.append(spark.range(20, 21).withColumn("v", F.lit(3)))
    assert t.read().count() == 15


def test_as_of_meets_brute_force(spark):
    """One entity has a third of all rows; equal times on both sides, equal rows, nulls, and entities that only one side has."""
    rng, day = random.Random(4), datetime(2020, 1, 1)
    pick = lambda: rng.choice(["hot", *(f"e{rng.randrange(12)}" for _ in range(2)), None if rng.random() < 0.1 else "hot"])
    known = [(pick(), "T", day + timedelta(days=rng.randrange(40)) if rng.random() > 0.03 else None, i % 50, f"v{i}") for i in range(900)]
    asked = [(i, pick(), "T", day + timedelta(days=rng.randrange(-3, 45)) if rng.random() > 0.03 else None) for i in range(600)]
    asked += [(1000, "e1", "other", day), (1001, "nobody", "T", day)]
    got = {r.q: (r.val, r.tag) for r in asof.as_of(spark.createDataFrame(asked, "q int, entity string, kind string, at timestamp"), spark.createDataFrame(known, "entity string, kind string, at timestamp, val int, tag string"), ["entity", "kind"], "at").collect()}
    assert len(got) == len(asked)
    for q, e, k, at in asked:
        rows = [(x[2], x[3], x[4]) for x in known if at and x[2] and x[:2] == (e, k) and e is not None and x[2] <= at]
        assert got[q] == (max(rows)[1:] if rows else (None, None)), (q, e, at)


def test_peer_claims_are_verified(spark):
    gate = spark.createDataFrame([("g", e, v, "compared", True) for e, v in (("a", 3.0), ("b", 9.0), ("c", 1.0), ("d", 9.0))] + [("g", "out", 99.0, "compared", False), ("one", "x", 5.0, "compared", True), ("none", "y", 1.0, "declined", True)], '`group` string, entity string, value double, state string, included boolean')
    said = spark.createDataFrame([("g", e) for e in ("a", "b", "c", "d", "out")] + [("one", "x")], "`group` string, entity string")
    assert {r.entity: r.status for r in compare.C.verify(compare.highest_claims(gate, said)).collect()} == {"a": "WRONG_MATH", "b": "VERIFIED", "c": "WRONG_MATH", "d": "VERIFIED", "out": "UNSUPPORTED_NUMBER", "x": "VERIFIED"}
    assert {r.group: (r.winner, r.verdict, r.loser, r.control) for r in compare.superlatives(gate).collect()} == {"g": ("b", "VERIFIED", "c", "WRONG_MATH"), "one": ("x", "VERIFIED", "x", None)}


def test_review_rows_tell_flags_and_reasons(spark):
    rows = [("d", "eps_reconciliation", "VERIFIED", True, False, [(1.5,)], {"eps_income_basis": "net"}, "e" * 300), ("d", "cash_flow_tie_out", "WRONG_MATH", False, False, [], None, None), ("d", None, "VERIFIED", True, False, [], {}, "")]
    df = spark.createDataFrame(rows, "doc_id string, rule_name string, status string, evidence_emitted boolean, label_caught boolean, operands array<struct<value: double>>, params map<string, string>, explanation string")
    got = [(json.loads(r.evidence_flags_emitted), len(r.explanation)) for r in compare.C.review_rows(df).collect()]
    assert got == [({"eps_income_basis": True, "income_operand_basis": False}, 200), ({"restricted_cash_disclosed": False}, 0), ({}, 0)]
    assert [r.evidence_flags_emitted for r in compare.C.review_rows(df.drop("params", "explanation")).collect()] == ["{}"] * 3


def test_runs_meet_brute_force_over_many_ranges(spark):
    """A series of 100,000 points, longer runs than ranges, and many short series."""
    rng, rows = random.Random(8), []
    walk = [0.0]
    while len(walk) < 100_000:
        step = rng.choice([-1.0, 0.0, 1.0])
        walk += [walk[-1] + step * (k + 1) for k in range(rng.choice([1, 2, 3, 30_000 if rng.random() < 0.0005 else 5]))]
    rows += [("long", i, float(v)) for i, v in enumerate(walk[:100_000])]
    rows += [("up", i, float(i)) for i in range(40_000)] + [(f"s{k}", i, float(rng.randrange(3))) for k in range(300) for i in range(rng.randrange(1, 9))]
    want = {}
    series: dict = {}
    for s, i, v in rows:
        series.setdefault(s, []).append((i, v))
    for s, points in series.items():
        before, way, run = None, None, 0
        for i, v in points:
            now = None if before is None else "up" if v > before else "down" if v < before else "flat"
            run = 0 if now is None else run + 1 if now == way else 1
            before, way = v, now
            want[s, i] = (way, run)
    df = spark.createDataFrame(rows + [("long", None, 1.0), (None, 1, 1.0), ("up", 5, None)], "s string, i int, v double")
    r = runs.runs(df, ["s"], ["i"], "v")
    got = {(x.s, x.i): (x.way, x.run) for x in r.collect()}
    assert got == want
    assert {x.s: (x.way, x.run) for x in runs.trailing(r, ["s"], ["i"], "v").collect()}["up"] == ("up", 39_999)


def test_accessions_of_large_event_ids_are_good(spark, tmp_path):
    spark.createDataFrame([(i, 7, "click", datetime(2024, 1, 1)) for i in (1_000_001, 12_345_678, 1_000_000)], "event_id long, user_id long, event_type string, ts timestamp").withColumn("value", F.lit(1.0)).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.entity, r.bad_accession) for r in reports.timeline_integrity(spark, str(tmp_path)).collect()] == [(7, 1)]


def test_texts_of_few_bytes_are_spread_over_tasks(spark, sf_dir):
    assert reports.statement_slice(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["fact_pivot", "pinned_run", "cell_lookup"])
def test_rows_stay_dealt_over_all_shuffle_partitions(spark, sf_dir, name):
    """However few bytes they take: no aggregation sorts more than a partition's share."""
    df = plans.QUERIES[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "REPARTITION_BY_NUM" in final
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
