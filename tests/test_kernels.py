"""Kernels case by case: right, wrong, just inside and outside, missing, null, not finite, zero, arity, order."""

import json
import math
import random
import re
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T
from proofgrid.operators import claims as C
from proofgrid.operators import answers, audit, compare, dashboards, gold, graph, series
from proofgrid.operators import facts as X
from proofgrid.sources import claims_json, filings, sinks, statements, store, tables
from proofgrid.streaming import filings as streams

SCHEMA = "doc_id string, operation string, operands array<struct<value: double, source: string, category: string>>, stated_value double, rule_name string, eps_variant string, context string, liabilities_complete boolean, eps_income_basis string, restricted_cash_disclosed boolean, trend_dir string, superlative string, claim_text string, mode string"
NAN, INF = float("nan"), float("inf")


def claim(op, values, stated=None, source="grounded", categories=None, **more):
    names = [f.split()[0] for f in claims_json.split_fields(SCHEMA)]
    row = {"doc_id": "d", "operation": op, "operands": [(v, source, (categories or {}).get(i)) for i, v in enumerate(values)], "stated_value": stated} | more
    return tuple(row.get(n) for n in names)


BS, EPS, CASH = ({"rule_name": r} for r in ("balance_sheet_identity", "eps_reconciliation", "cash_flow_tie_out"))
TAGS = {1: "income from continuing operations", 2: "weighted basic shares"}
E_OK = EPS | {"eps_variant": "basic", "eps_income_basis": "continuing"}
CASES = [
    (claim("percent_change", [100.0, 110.0], 10.4), "VERIFIED"), (claim("percent_change", [100.0, 110.0], 10.6), "WRONG_MATH"), (claim("percent_change", [110.0, 100.0], 10.0), "WRONG_MATH"), (claim("percent_change", [0.0, 5.0], 1.0), "AMBIGUOUS"), (claim("percent_change", [-100.0, -50.0], -50.0), "VERIFIED"),
    (claim("absolute_change", [3.0, 5.0], 2.0), "VERIFIED"), (claim("difference", [5.0, 3.0], 2.0), "VERIFIED"), (claim("difference", [3.0, 5.0], 2.0), "WRONG_MATH"), (claim("ratio", [6.0, 3.0], 2.0), "VERIFIED"), (claim("ratio", [6.0, 0.0], 2.0), "AMBIGUOUS"), (claim("margin_percent", [20.0, 200.0], 10.5), "VERIFIED"),
    (claim("sum", [1.0, 2.0, 3.0], 6.02), "VERIFIED"), (claim("sum", [1.0, 2.0, 3.0], 6.04), "WRONG_MATH"), (claim("sum", [1.0], 1.0), "AMBIGUOUS"), (claim("average", [2.0, 4.0], 3.0), "VERIFIED"), (claim("average", [2.0], 2.0), "AMBIGUOUS"), (claim("product", [2.0, 4.0], 8.0), "VERIFIED"), (claim("identity", [7.0], 7.0), "VERIFIED"), (claim("identity", [7.0, 7.0], 7.0), "AMBIGUOUS"),
    (claim("sum", [1.0, 2.0], None), "AMBIGUOUS"), (claim("sum", [1.0, NAN], 3.0), "AMBIGUOUS"), (claim("sum", [1.0, INF], INF), "AMBIGUOUS"), (claim("sum", [1.0, 2.0], 3.0, "missing"), "UNSUPPORTED_NUMBER"), (claim("unsupported", [], None, "missing"), "UNCHECKED"), (claim("nonsense", [1.0], 1.0), "AMBIGUOUS"),
    (claim("internal_consistency", [100.0, 60.0, 40.0], **BS, liabilities_complete=True), "VERIFIED"), (claim("internal_consistency", [100.0, 60.0, 40.0], **BS), "INSUFFICIENT_EVIDENCE"), (claim("internal_consistency", [100.0, 60.0, 30.0], **BS, liabilities_complete=True), "WRONG_MATH"), (claim("internal_consistency", [100.0, 60.0, 30.0], **BS, liabilities_complete=True, context="Minority interest of 10"), "INSUFFICIENT_EVIDENCE"),
    (claim("internal_consistency", [100.0, 60.0, 30.0], **BS, liabilities_complete=True, context="temporary equity"), "INSUFFICIENT_EVIDENCE"), (claim("internal_consistency", [100.0, 0.0, 40.0], **BS, liabilities_complete=True), "INSUFFICIENT_EVIDENCE"), (claim("internal_consistency", [100.0, 60.0], **BS, liabilities_complete=True), "AMBIGUOUS"),
    (claim("internal_consistency", [-2.44, -313.0, 128.0], categories=TAGS, **E_OK), "VERIFIED"), (claim("internal_consistency", [3.0, 313.0, 128.0], categories=TAGS, **E_OK), "WRONG_MATH"), (claim("internal_consistency", [3.0, 313.0, 128.0], categories=TAGS, **E_OK, context="preferred stock dividends"), "INSUFFICIENT_EVIDENCE"), (claim("internal_consistency", [2.45, 313.0, 128000.0], categories=TAGS, **E_OK), "INSUFFICIENT_EVIDENCE"),
    (claim("internal_consistency", [2.45, 313.0, 0.0], categories=TAGS, **E_OK), "AMBIGUOUS"), (claim("internal_consistency", [2.45, 313.0, 128.0], categories={1: "total net income", 2: "basic"}, **E_OK), "INSUFFICIENT_EVIDENCE"), (claim("internal_consistency", [2.45, 313.0, 128.0], categories={1: "continuing", 2: "diluted"}, **E_OK), "AMBIGUOUS"), (claim("internal_consistency", [2.45, 313.0, 128.0], categories={1: "continuing"}, **E_OK), "AMBIGUOUS"),
    (claim("internal_consistency", [50.0, 50.0], **CASH), "VERIFIED"), (claim("internal_consistency", [51.0, 50.0], **CASH), "WRONG_MATH"), (claim("internal_consistency", [51.0, 50.0], **CASH, restricted_cash_disclosed=False, context="cash and restricted cash"), "INSUFFICIENT_EVIDENCE"), (claim("internal_consistency", [51.0, 50.0], **CASH, restricted_cash_disclosed=False, context="held in escrow"), "WRONG_MATH"), (claim("internal_consistency", [51.0, 50.0], **CASH, context="held in escrow"), "INSUFFICIENT_EVIDENCE"),
    (claim("trend_direction", [1.0, 2.0, 3.0], trend_dir="up"), "VERIFIED"), (claim("trend_direction", [1.0, 2.0, 2.0], trend_dir="up"), "WRONG_MATH"), (claim("trend_direction", [1000.0, 1000.5], trend_dir="flat"), "VERIFIED"), (claim("trend_direction", [1.0], trend_dir="up"), "AMBIGUOUS"), (claim("trend_direction", [1.0, 2.0]), "AMBIGUOUS"),
    (claim("consecutive_count", [5.0, 1.0, 2.0, 3.0], 2.0, trend_dir="up"), "VERIFIED"), (claim("consecutive_count", [5.0, 1.0, 2.0, 3.0], 3.0, trend_dir="up"), "WRONG_MATH"), (claim("consecutive_count", [1.0, 2.0], None, trend_dir="up"), "AMBIGUOUS"), (claim("superlative", [1.0, 3.0], superlative="max"), "VERIFIED"), (claim("superlative", [3.0, 1.0], superlative="max"), "WRONG_MATH"), (claim("superlative", [3.0, 1.0]), "AMBIGUOUS"),
    (claim("aggregate_filter", [1.0, 2.0], 3.0, mode="sum"), "VERIFIED"), (claim("aggregate_filter", [1.0, 2.0], 2.0, mode="count"), "VERIFIED"), (claim("aggregate_filter", [1.0], 1.0, mode="other"), "AMBIGUOUS"), (claim("aggregate_filter", [], 0.0, mode="sum"), "AMBIGUOUS"),
    (claim("mda_xbrl_consistency", [], 5.0, trend_dir="up"), "VERIFIED"), (claim("mda_xbrl_consistency", [], 5.0, trend_dir="down"), "CONFLICT"), (claim("mda_xbrl_consistency", [], 1.9, trend_dir="down"), "NEEDS_REVIEW"), (claim("mda_xbrl_consistency", [], 9.0, trend_dir="flat"), "NEEDS_REVIEW"), (claim("mda_xbrl_consistency", [], None, trend_dir="up"), "INSUFFICIENT_EVIDENCE"),
    (claim("definitional_flag", [], None, claim_text="roughly in line"), "NEEDS_REVIEW"), (claim("definitional_flag", [], None, claim_text="roundabout"), "UNCHECKED"),
]


def test_ladders(spark):
    rows = C.verify(spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(CASES)], "i int, " + SCHEMA)).collect()
    got = {r.i: r.status for r in rows}
    assert [(i, got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want] == []


def test_half_ulp(spark):
    values = [224.2, 3.31, 6288.0, 128000000.0, 0.0, NAN, INF, 1e-5, 2e16, 0.0125, -1.5, 1234567890.25, 120.0]

    def brute(x):
        v = abs(x)
        if v == 0 or not math.isfinite(v):
            return 0.0
        if v >= 1e16 or v < 1e-4:
            return min(0.5, v * 0.001)
        whole, part = repr(v).split(".")
        if part.rstrip("0"):
            return 0.5 * 10.0 ** -len(part)
        zeros = len(whole) - len(whole.rstrip("0"))
        return min(0.5 * 10.0**zeros, v * 0.001) if zeros else 0.5

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", K.half_ulp(F.col("v")).alias("h")).collect()
    assert [r.h for r in sorted(rows)] == pytest.approx([brute(v) for v in values], rel=1e-12)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    lit = F.lit
    r = one(spark, a=T.table_number(lit(" (1,234) ")), b=T.table_number(lit("n/a")), c=T.millions(lit("$1.2bn")), d=T.millions(lit("-$3")), e=T.period(lit("q3 - 2021 FY2020")), f=T.period(lit("fiscal 2019")), g=T.metric(lit(" Net-Income ")), h=T.metric(lit("other")), i=T.dirty_number(lit("$1,000%")), j=T.dirty_number(lit("1.2bn")), k=T.numbers(lit("F [F2] is (1,200) and $3.5%")), m=T.strip_html(lit("<p>A&nbsp;&amp;<br>B</p><script>x</script>")))
    assert tuple(r) == (-1234.0, None, 1200.0, None, "Q3-2021", "FY2019", "Net income", None, 1000.0, None, [-1200.0, 3.5], "A & B")


def test_context_windows(spark):
    texts = ["", None, "1,200 then 1200 and 1200.0, as restated; 12001200", "x" * 300 + "2.5" + "y" * 300 + "2.50", "1,234.56 or 1234.56.", "12345678.9", "-7 and 7"]
    values = [1200.0, 2.5, 1234.56, 12345678.9, -7.0, None, NAN, INF]

    def brute(text, v, n):
        if not text or v is None or not math.isfinite(v):
            return []
        forms = {str(v), ("%f" % v).rstrip("0").rstrip("."), *((str(int(v)), f"{int(v):,}") if v == int(v) else (f"{v:.2f}", f"{v:,.2f}"))}
        found = []
        for f in forms:
            at = text.find(f)
            while at >= 0:
                found.append(text[max(0, at - n) : at + len(f) + n])
                at = text.find(f, at + len(f))
        return sorted(found)

    rows = spark.createDataFrame([(t, v) for t in texts for v in values], "t string, v double").select("t", "v", T.context_windows(F.col("t"), F.col("v"), 20).alias("w")).collect()
    assert [(r.t, r.v, sorted(r.w)) for r in rows if sorted(r.w) != brute(r.t, r.v, 20)] == []


def test_statement_text(spark):
    texts = ["TOTAL ASSETS ... $ 123,456 and Total stockholders' equity 99,999", "Total equity 12,345; 2021, 12", "total assets 12", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.numeric_density(F.col("t")), T.statement_score(F.col("t")), T.slice_quality(F.col("t"))).collect()
    assert [tuple(r) for r in sorted(rows)] == [(0, 2, 1, "full_identity"), (1, 2, 0, "partial"), (2, 0, 1, "no_identity"), (3, 0, 0, "no_identity"), (4, 0, 0, "no_identity")]


def test_closure_meets_brute_force_and_cycles_raise(spark):
    edges = [("d", "b", "a"), ("d", "c", "a"), ("d", "e", "b"), ("d", "e", "c"), ("d", "f", "e"), ("x", "q", "p"), ("x", "p", "q")]
    e = spark.createDataFrame(edges, "doc_id string, src string, dst string")
    assert {(r.doc_id, r.node) for r in graph.cycles(e).collect()} == {("x", "p"), ("x", "q")}
    n = {(r.node): r.n for r in graph.downstream(e.filter("doc_id = 'd'")).collect()}
    assert n == {"a": 4, "b": 2, "c": 2, "e": 1}
    v = spark.createDataFrame([("d", x, i, s) for i, (x, s) in enumerate((("b", "WRONG_MATH"), ("c", "UNSUPPORTED_NUMBER"), ("a", "VERIFIED"), ("e", "VERIFIED"), ("f", "UNCHECKED"), ("z", "CONFLICT")))], "doc_id string, node string, ord int, status string")
    got = {r.node: (r.status, r.caused_by) for r in graph.propagate(v, e).collect()}
    assert got == {"a": ("VERIFIED", None), "b": ("WRONG_MATH", None), "c": ("UNSUPPORTED_NUMBER", None), "e": ("PROPAGATED_ERROR", "b"), "f": ("PROPAGATED_ERROR", "b"), "z": ("CONFLICT", None)}


def test_scores_are_not_available_without_anything_to_check(spark):
    v = spark.createDataFrame([("a", "UNCHECKED"), ("b", "VERIFIED"), ("b", "WRONG_MATH"), ("b", "CONFLICT")], "doc_id string, status string")
    rows = {r.doc_id: r for r in C.score(v, ["doc_id"]).collect()}
    assert not rows["a"].score_available and rows["a"].score == 0 and rows["b"].score == 33.3
    p = {(r.doc_id, r.panel): r for r in dashboards.record_panels(v.withColumns({"evidence_emitted": F.lit(True), "evidence_gate_satisfied": F.lit(False), "adjudicated": F.lit(False)})).collect()}
    assert p["a", "verification_score"].state == "unassessed" and p["a", "verification_score"].value is None
    none = dashboards.restatement_panel(v.filter("doc_id = 'a'"), spark.createDataFrame([], "doc_id string, restatement_type string"))
    whole = {(r.doc_id, r.panel): r for r in dashboards.assembled(v, none).collect()}
    assert whole["a", "restatement_risk"].state == "ok" and whole["a", "restatement_risk"].parts["conflicts"] == 0
    assert whole["b", "restatement_risk"].state == "unassessed" and whole["b", "verification_score"].state == "no_data"


def test_consistency_panel_does_not_penalise_splits(spark):
    rows = [("a", 5, 0, True, ["split_sensitive_series"]), ("a", 5, 1, False, []), ("a", 5, 0, False, ["fallback_xbrl_tag_used"]), ("a", 1, 0, False, []), ("b", 1, 0, False, [])]
    m = spark.createDataFrame(rows, "doc_id string, n_points int, n_dropped int, split_sensitive boolean, signals array<string>")
    got = {r.doc_id: (r.state, r.value) for r in dashboards.consistency_panel(m).collect()}
    assert got == {"a": ("ok", 33.3), "b": ("no_data", None)}


def test_tables(spark):
    t = spark.createDataFrame([("d", "x (in Thousands)\n| | 2021 | 2020 |\n|---|---|---|\n| Net sales | $1,200 | (30) |\n| Diluted EPS per share | 2.5 | n/a | 9 |\n"), ("e", "no pipes"), ("f", None), ("g", "| a |")], "doc_id string, text string")
    rows = [(r.row_label, r.column_label, r.value) for r in tables.millions(tables.cells(t)).orderBy("row_ord", "col_ord").collect()]
    assert rows == [("Net sales", "2021", 1.2), ("Net sales", "2020", -0.03), ("Diluted EPS per share", "2021", 2.5), ("Diluted EPS per share", "col2", 9.0)]
    w = spark.createDataFrame([("d", "sales", None), ("d", "net sales", "2020")], "doc_id string, want string, column string")
    assert {(r.want, r.value) for r in tables.lookup(tables.cells(t), w).collect()} == {("sales", 1200.0), ("net sales", -30.0)}
    texts = [("m", "Document one - 10-Q\na\nb\n\nFiling two: x\nc in fiscal 2021"), ("s", "Document: only\nx"), ("e", None)]
    parts = tables.documents(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert {tuple(p) for p in parts} == {("m", 0, "DOC_ONE", None, "10-Q", "Document one - 10-Q\na\nb"), ("m", 1, "TWO_FY2021", "FY2021", None, "Filing two: x\nc in fiscal 2021"), ("s", 0, "DOC_1", None, None, "Document: only\nx"), ("e", 0, "DOC_1", None, None, "")}


def test_claims_json_of_many_elements(spark):
    item = '{"claim_text": "t", "operation": "sum", "stated_value": "%d", "operands": []}'
    raw = "[" + ", ".join([item % i for i in range(200)] + ['{"operation": "sum"}', item % 201]) + "]"
    rows = sorted(claims_json.parsed(spark.createDataFrame([("d", raw)], "doc_id string, raw string")).collect(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(202)) and [r.ord for r in rows if not r.ok] == [200]
    assert rows[200].reason == "no claim text" and rows[201].stated_value == 201


def test_claims_json(spark):
    good = {"claim_text": "x [1] \"q\"", "operation": "Sum", "stated_value": "$3", "operands": [{"value": "1", "source": "Grounded"}, {"value": 2, "source": "grounded", "source_span": [1, 2]}]}
    bad = [good | {"operation": "guess"}, good | {"stated_value": "1.2bn"}, {k: v for k, v in good.items() if k != "claim_text"}, good | {"operands": [{"value": "z", "source": "grounded"}]}, good | {"stated_value": "1e999"}, good | {"eps_variant": "odd"}, good | {"operands": [{"value": 1, "source_span": [1]}]}]
    texts = [("a", json.dumps([good, *bad, 7])), ("b", "Sure:\n```json\n" + json.dumps([good]) + "\n```"), ("c", json.dumps({"note": "[no]", "claims": [good]})), ("d", "none"), ("e", None), ("f", "[]"), ("g", "so [" + json.dumps(good) + "] and ]["), ("h", "[{")]
    df = claims_json.parsed(spark.createDataFrame(texts, "doc_id string, raw string"))
    rows = df.collect()
    assert sorted((r.doc_id, r.ord, r.ok) for r in rows if r.ord is not None) == [("a", 0, True), *[("a", i, False) for i in range(1, 9)], ("b", 0, True), ("c", 0, True), ("g", 0, True)]
    assert {(r.doc_id, r.reason) for r in rows if r.ord is None} == {("d", "no JSON array found in model response"), ("e", "empty model response"), ("h", "JSON decode error")}
    assert {r.reason for r in rows if r.ord == 8} == {"array element is not an object"}
    assert {r.status for r in C.verify(df.filter("ok")).collect()} == {"VERIFIED"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("raw", "want"), [("gross_margin", "margin_percent"), ("Growth Rate", "percent_change"), ("divide", "ratio"), ("subtract", "difference")])
def test_aliases_are_read_before_they_are_judged(spark, raw, want):
    text = json.dumps([{"claim_text": "t", "operation": raw, "operands": [{"value": 1, "source": "table cell"}, {"value": 2, "source": "prose"}], "params": None}])
    r = claims_json.parsed(spark.createDataFrame([("d", text)], "doc_id string, raw string")).first()
    assert r.ok and r.operation == want and [o.source for o in r.operands] == ["grounded_table_cell", "grounded_prose"] and r.note.startswith("repaired")


def test_filings(spark, tmp_path):
    facts = {"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2021-12-31", "val": 5, "fy": 2021, "fp": "FY", "form": "10-K", "filed": "2022-02-01"}, {"end": "bad", "val": 1}]}}}}}
    (tmp_path / "c.json").write_text(json.dumps(facts))
    rows = filings.read_facts(spark, str(tmp_path / "c.json")).collect()
    assert [(r.entity, r.tag, str(r.end), r.val, r.pos) for r in sorted(rows, key=lambda r: r.pos)] == [("7", "Assets", "2021-12-31", 5.0, 0), ("7", "Assets", "None", 1.0, 1)]
    feed = spark.createDataFrame([("7", ["a", "b"], ["10-K/A", "10-K"], ["2021-01-01", "2020-01-01"], ["x"], ["p", "q"], ["", ""])], "entity string, " + filings.FEED)
    assert [(r.accessionNumber, r.reportDate) for r in filings.latest_filing(filings.submissions(feed)).collect()] == [("b", "")]
    deal = "<nonDerivativeTransaction><transactionDate><value>2022-01-03</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{}</value></transactionShares></transactionAmounts></nonDerivativeTransaction>"
    xml = f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Ann</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>{deal.format(10)}{deal.format('?')}</nonDerivativeTable></ownershipDocument>"
    got = filings.insider_transactions(spark.createDataFrame([("7", "a", xml)], "entity string, accession string, xml string")).collect()
    assert [(r.owner, r.code, r.shares, r.price, str(r.date)) for r in got] == [("Ann", "P", 10.0, None, "2022-01-03")]


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("a", "VERIFIED", [1.0]), ("a", None, [2.0]), ("a", "VERIFIED", None)], "doc_id string, status string, xs array<double>")
    assert sinks.verdict_counts(v, "doc_id").first().counts == {"VERIFIED": 2, "UNKNOWN": 1}
    sinks.write_csv(v, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    sinks.write_csv(v, str(tmp_path / "meta"), meta={"ticker": "T", "n": "3"})
    lines = [x for p in (tmp_path / "meta").glob("part-*") for x in p.read_text().splitlines()]
    assert lines[:3] == ["# ticker: T", "# n: 3", "doc_id,status,xs"] and spark.read.csv(str(tmp_path / "meta"), header=True, comment="#").filter("doc_id = 'a'").count() == 3
    sinks.write_run(v.select("doc_id").distinct(), v.withColumn("ord", F.lit(0)), str(tmp_path / "run"), run_mode="replay", started_at="a", finished_at="b")
    run = spark.read.json(str(tmp_path / "run")).first()
    assert run["mode"] == "replay" and len(run.claims) == 3
    sinks.write_json(v, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert [r.doc_id for r in sinks.append_new(spark.createDataFrame([("a",), ("b",), ("b",)], "doc_id string"), v, ["doc_id"]).collect()] == ["b"]


def test_links(spark):
    claims = spark.createDataFrame([("d", "s", "sum", 30.0, [10.0, 20.0]), ("d", "r", "ratio", 2.0, [30.0000001, 15.0]), ("d", "t", "sum", 15.0, [7.0, 8.0]), ("d", "u", "sum", 15.0, [9.0, 6.0])], "doc_id string, claim_id string, operation string, stated_value double, operands array<double>")
    assert {(r.src, r.dst) for r in compare.derived_links(claims, spark.createDataFrame([("d", 10.0)], "doc_id string, value double")).collect()} == {("r", "s")}
    assert compare.derived_links(claims, spark.createDataFrame([("d", 30.0)], "doc_id string, value double")).collect() == []


def test_streams(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("e", "a1", "10-K", day(1)), ("e", "a1", "10-K", day(1)), ("e", "a2", "8-K", day(3)), ("f", "b1", "4", day(2)), ("e", "a0", "4", day(2))]
    spark.createDataFrame(rows, "entity string, accession string, form string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("entity string, accession string, form string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("seen", streams.once(read()), "append"), ("latest", streams.changes(read()), "append"), ("counted", streams.counts(read()), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("seen").count() == 4
    assert [r.accession for r in spark.table("latest").filter("entity = 'e'").orderBy("ts").collect()] == ["a1", "a0", "a2"]
    assert {(r.form, r.n) for r in spark.table("counted").collect()} == {("10-K", 2), ("8-K", 1), ("4", 2)}


def test_hallucinated_numbers_do_not_pass(spark):
    lit = F.lit
    cases = [(2.8, [2.4], False), (2.4, [2.4], True), (2.0, [2.4], True), (1234.5, [-1234.5], True), (-1234.5, [1234.5], False), (12.0, [], True), (13.0, [], False), (12.5, [], False), (100.4, [100.0], True), (101.0, [100.0], False), (0.12, [0.1234], True), (3.6, [3.14], False)]
    rows = spark.createDataFrame([(i, x, f) for i, (x, f, _) in enumerate(cases)], "i int, x double, f array<double>").select("i", T.allowed(F.col("x"), F.col("f")).alias("ok")).collect()
    assert [(i, r.ok) for i, r in enumerate(sorted(rows))] == [(i, ok) for i, (*_, ok) in enumerate(cases)]
    r = one(spark, a=T.numbers(lit("(450 million, up 3%)")), b=T.numbers(lit("(450)% of -7")), c=T.dirty_number(lit("1e999")), d=T.dirty_number(lit("-.5e1")), e=T.withheld(lit("of $1,200 (3)")))
    assert tuple(r) == ([450.0, 3.0], [-450.0, -7.0], None, -5.0, "of [number withheld] [number withheld]")


def test_answers(spark):
    ledger = spark.createDataFrame([("d", "F1", "balance_sheet_identity", "assets", [100.0]), ("d", None, "cash_flow_tie_out", "gap", [])], "doc_id string, fact_id string, topic string, said string, values array<double>")
    q = spark.createDataFrame([("d", 1, "Does the balance hold?"), ("d", 2, "And cash?"), ("d", 3, "Margins?"), ("d", 4, "balance and cash?")], "doc_id string, question_id int, question string")
    gates = answers.gate(q, ledger)
    assert {r.question_id: r["mode"] for r in gates.collect()} == {1: "answered", 2: "refused_blocked", 3: "refused_no_data", 4: "refused_blocked"}
    given = [("d", 1, json.dumps([{"answer": a, "citations": c}])) for a, c in [("It is 100 [F1].", ["F1"])]] + [("d", 2, json.dumps([{"answer": "9", "citations": ["F1"]}]))]
    out = {r.question_id: (r["mode"], r.answer, r.reason) for r in answers.judged(gates, spark.createDataFrame(given, "doc_id string, question_id int, raw string")).collect()}
    assert out[1] == ("answered", "It is 100 [F1].", None) and out[2][0] == "refused_blocked"
    for text, cites, why in (("It is 250 [F1].", ["F1"], "number of no verified fact"), ("100", [], "no citations"), ("100", ["F7"], "unknown citation F7")):
        r = spark.range(1).select(answers.failure(F.lit(text), F.array(*map(F.lit, cites)).cast("array<string>"), F.array(F.lit("F1")), F.array(F.lit(100.0))).alias("w")).first()
        assert r.w == why


def test_graphs_with_cycles_raise_and_new_edges_close_none(spark):
    import random

    rng = random.Random(2)
    new, given = [], []
    for doc in range(40):
        n = rng.randrange(2, 7)
        order = rng.sample(range(n), n)
        given += [(doc, order[i], order[j]) for i in range(n) for j in range(i) if rng.random() < 0.3]
        new += [(doc, rng.randrange(n), rng.randrange(n), rank) for rank in range(rng.randrange(6))]
    g = spark.createDataFrame(given, "doc_id int, src int, dst int")
    new = [x for x in {(d, a, b): (d, a, b, r) for d, a, b, r in new}.values() if x[:3] not in set(given)]
    e = spark.createDataFrame(new, "doc_id int, src int, dst int, rank int")
    offered = sorted((d, r, a, b) for d, a, b, r in new)
    graph.assert_acyclic(g)
    have = {(d, a, b) for d, a, b in given}
    want = set()
    for doc, _, a, b in offered:
        reach, stack = set(), [b]
        while stack:
            at = stack.pop()
            if at not in reach:
                reach.add(at)
                stack += [y for d, x, y in have if d == doc and x == at]
        if a not in reach:
            have.add((doc, a, b))
            want.add((doc, a, b))
    got = graph.without_cycles(e, g).cache()
    assert {(r.doc_id, r.src, r.dst) for r in got.collect()} == want
    graph.assert_acyclic(g.unionByName(got))
    with pytest.raises(graph.CycleError, match="->"):
        graph.assert_acyclic(spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 9, 1), (2, 1, 2)], "doc_id int, src int, dst int"))


def test_score_adds_up_in_order_where_told(spark):
    """Nine of weight 1 and four of 0.4 among 16 are 66.25: in which order they are added decides where that goes."""
    import random

    rng, weight = random.Random(5), {"VERIFIED": 1.0, "UNSUPPORTED_NUMBER": 0.4, "WRONG_MATH": 0.0}
    docs = [rng.sample(["VERIFIED"] * 9 + ["UNSUPPORTED_NUMBER"] * 4 + ["WRONG_MATH"] * 3, 16) for _ in range(40)]

    def flat(statuses):
        total = 0.0
        for s in statuses:
            total += weight[s]
        return round(total / 16 * 100 * 10) / 10

    want = {i: flat(d) for i, d in enumerate(docs)}
    assert len(set(want.values())) == 2
    rows = [(i, n, s) for i, d in enumerate(docs) for n, s in enumerate(d)]
    rng.shuffle(rows)
    got = C.score(spark.createDataFrame(rows, "doc_id int, ord int, status string"), ["doc_id"], order="ord").collect()
    assert {r.doc_id: r.unweighted_score for r in got} == {r.doc_id: r.score for r in got} == want



def test_gold_matches_brute_force(spark):
    import random
    import re

    rng = random.Random(7)
    words = "revenue income assets grew fell margin the of quarter".split()
    claim = lambda i: (rng.randrange(12), i, " ".join(rng.choice(words) for _ in range(rng.randrange(6))), rng.choice([None, 0.0, 0.04, 5.0, 5.04, 100.0, 100.9, -7.0, 1e9]), rng.choice(["sum", "ratio", "identity"]))
    p, g = [claim(i) for i in range(90)], [claim(i) for i in range(80)]
    schema = "doc_id int, ord long, claim_text string, stated_value double, operation string"
    tokens = lambda t: {x for x in re.split("[^a-z0-9]+", t.lower()) if len(x) >= 2} - set(T.GOLD_STOPWORDS)
    near = lambda a, b: a is b is None or (a is not None and b is not None and abs(a - b) <= max(abs(b) * 0.01, 0.05))
    want = set()
    for doc in range(12):
        pairs = []
        for _, i, t, v, o in (x for x in p if x[0] == doc):
            for _, j, u, w, q in (x for x in g if x[0] == doc):
                a, b = tokens(t), tokens(u)
                pairs.append((3 * (len(a & b) / len(a | b) if a | b else 0) + near(v, w) + 0.3 * (o == q), i, j))
        up, ug = set(), set()
        for s, i, j in sorted(((round(s, 9), i, j) for s, i, j in pairs), reverse=True):
            if s > 0.15 and i not in up and j not in ug:
                up.add(i)
                ug.add(j)
                want.add((doc, i, j))
        want |= {(doc, None, x[1]) for x in g if x[0] == doc and x[1] not in ug} | {(doc, x[1], None) for x in p if x[0] == doc and x[1] not in up}
    got = gold.matches(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema)).collect()
    assert {(r.doc_id, r.pred, r.gold) for r in got} == want


def test_gold_kernels(spark):
    o = lambda *xs: [(None if x is None else float(x), s) for x, s in xs]
    cases = [(o((1, "grounded"), (2, "inferred")), o((2, "inferred"), (1, "grounded")), True, True), (o((1, "grounded"), (2, "grounded")), o((2, "inferred"), (1, "grounded")), True, False), (o((1, "grounded")), o((1, "grounded"), (1, "grounded")), False, False), (o((5, "missing"), (1, "grounded")), o((9, "missing"), (1, "grounded")), True, True), (o((1, "grounded"), (1, "inferred")), o((1, "inferred"), (1, "grounded")), True, False), ([], [], True, True)]
    kind = "array<struct<value: double, source: string>>"
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], f"i int, a {kind}, b {kind}").select("i", gold.same_values(gold.values(F.col("a")), gold.values(F.col("b"))).alias("v"), gold.same_grounding(F.col("a"), F.col("b")).alias("g")).collect()
    assert [tuple(r) for r in sorted(rows)] == [(i, v, g) for i, (_, _, v, g) in enumerate(cases)]


BALANCE_ROWS = (re.compile(T.ASSETS_ROW), re.compile(T.CLAIMS_ROW))
STARTS_RE = re.compile(statements.HEADING)


def start_of(text: str, upper: str) -> int:
    """Where the statements start: of the headings before a dense table the first whose stretch has the rows of a balance sheet, else the first;
    without a dense one, the densest; -1 without a heading."""
    best, at = (-1, 0), -1
    first = None
    for m in STARTS_RE.finditer(upper):
        i = m.start()
        density = len(re.findall(statements.FIGURE, text[i : i + statements.WINDOW]))
        if density > best[0]:
            best, at = (density, i), i
        if density >= statements.DENSE:
            first = i if first is None else first
            if all(r.search(text[i : i + statements.PROBE]) for r in BALANCE_ROWS):
                return i
    return at if first is None else first


def cut_out(text: str | None) -> str:
    """The statements of a text: to the first end that leaves the balance sheet whole, and not more than a slice, a wide one where the balance sheet
    lies further; without a heading the first slice of the text."""
    if not text:
        return ""
    upper = text.upper()
    start = start_of(text, upper)
    if start < 0:
        return text[: statements.SLICE].strip()
    stretch = text[start : start + statements.WIDE]
    last = max((m.end() for r in BALANCE_ROWS for m in r.finditer(stretch)), default=0)
    least = max(statements.LEAST, last + 500 if last else 0)
    found = (upper.find(e, start + 1) for e in statements.ENDS)
    end = min((i for i in found if i >= 0 and i - start >= least), default=-1)
    most = statements.WIDE if least > statements.SLICE else statements.SLICE
    return text[start : end if 0 <= end <= start + most else start + most].strip()


def sliced(spark, texts: list) -> list:
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", statements.statements("t").alias("s"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return [r.s for r in sorted(df.collect())]


def test_statements_of_banks_and_indexes(spark):
    dense, rows = "1,234 " * 40, "Total assets $ 999,999 text total equity 888,888 "
    index = "CONSOLIDATED BALANCE SHEETS page 12 " + "prose " * 900
    text = index + "CONSOLIDATED STATEMENTS OF INCOME " + dense + "x " * 14000 + "CONSOLIDATED BALANCE SHEETS " + dense + rows + "y " * 300 + "NOTES TO FINANCIAL STATEMENTS " + dense * 20
    near = "CONSOLIDATED STATEMENTS OF INCOME " + dense + "x " * 6000 + "Balance sheets " + dense + rows + "w " * 300 + "NOTES TO FINANCIAL STATEMENTS"
    texts = [text, "", None, "z" * 99_999, near, "BALANCE SHEETS 12,345 " + "q " * 20000, "BALANCE SHEETS 12,345 " + "q " * 40000]
    got = sliced(spark, texts)
    assert got == [cut_out(t) for t in texts]
    assert got[0].startswith("CONSOLIDATED BALANCE SHEETS 1,234") and rows.strip() in got[0] and got[1] == got[2] == "" and len(got[3]) == statements.SLICE
    assert got[4].startswith("CONSOLIDATED STATEMENTS OF INCOME") and rows.strip() in got[4] and got[5].startswith("BALANCE SHEETS") and len(got[6]) <= statements.SLICE


def test_statements_meet_brute_force(spark):
    import random

    rng = random.Random(12)
    parts = [*statements.STARTS, *statements.ENDS, "Total Assets $ 12,345", "total stockholders\u2019 equity 99,999", "1,234 " * 30, "55,555.5 ", "prose " * 400, "p " * 3000, "w " * 9000, "\n\n \u00a0", "consolidated balance sheet", "NOTES TO "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    assert sliced(spark, texts) == [cut_out(t) for t in texts]


def test_facts_of_other_units_and_forms_do_not_count(spark):
    import datetime as dt

    d = lambda y, m, n: dt.date(y, m, n)
    rows = [("e", "Assets", "USD", None, d(2020, 12, 31), 100.0, "10-K", d(2021, 2, 1), 0), ("e", "Assets", "EUR", None, d(2020, 12, 31), 90.0, "10-K", d(2021, 3, 1), 1), ("e", "Assets", "USD", None, d(2021, 3, 31), 30.0, "10-Q", d(2021, 5, 1), 2), ("e", "Liabilities", "USD", None, d(2019, 12, 31), 40.0, "10-K", d(2020, 2, 1), 3), ("e", "StockholdersEquity", "USD", None, d(2020, 12, 31), 60.0, "10-K", d(2021, 2, 1), 4)]
    f = spark.createDataFrame(rows, "entity string, tag string, unit string, start date, end date, val double, form string, filed date, pos int").withColumns({"fy": F.lit(2020), "fp": F.lit("FY")})
    r = X.pivoted(f).first()
    assert (r.assets, r.liabilities, r.equity, str(r.period_end)) == (100.0, None, 60.0, "2020-12-31")
    assert X.claims_of(X.pivoted(f)).count() == 0  # without total liabilities there is no balance sheet to claim
    assert {(x.unit, x.form, x.val) for x in series.comparable(f).filter("tag = 'Assets'").collect()} == {("USD", "10-K", 100.0), ("EUR", "10-K", 90.0), ("USD", "10-Q", 30.0)}


def test_audit_of_two_filings(spark):
    docs = spark.createDataFrame([("s", "a", 0, "figure 100 as first"), ("s", "b", 1, "figure 120 as restated")], "set_id string, doc_id string, doc_ord int, text string")
    cells = spark.createDataFrame([("s", "a", 0, "Net sales ", "FY1", 100.0), ("s", "b", 1, "net sales", "fy1", 120.0)], "set_id string, doc_id string, doc_ord int, row_label string, column_label string, value double")
    claims = [{"claim_text": "t", "operation": "sum", "stated_value": 3, "operands": [{"value": 1}, {"value": 2}], "node_id": "x"}, {"claim_text": "t", "operation": "ratio", "stated_value": 9, "operands": [{"value": 3}, {"value": 4}]}, {"claim_text": "t", "operation": "identity", "stated_value": 9, "operands": [{"value": 9}], "depends_on": ["y", "gone"]}, {"claim_text": "t", "operation": "identity", "stated_value": 8, "operands": [{"value": 9}], "node_id": "y"}]
    statement = [{"claim_text": "t", "operation": "internal_consistency", "rule_name": "cash_flow_tie_out", "operands": [{"value": 5}, {"value": 5}]}]
    raw = spark.createDataFrame([("s", json.dumps(claims))], "set_id string, raw string")
    own = spark.createDataFrame([("a", json.dumps(statement)), ("b", json.dumps(statement))], "doc_id string, raw string")
    results, conflicts, scores = audit.many(docs, raw, own, cells)
    by = {(r.ord): r for r in results.collect()}
    assert [by[i].status for i in (0, 1, 2, 3)] == ["VERIFIED", "WRONG_MATH", "PROPAGATED_ERROR", "WRONG_MATH"] and by[2].caused_by == "y"
    assert by[1].depends_on == ["x"]  # 3 stands in no source and is what the first claim gives
    assert sorted(o.doc_id for r in results.filter("operation = 'internal_consistency'").collect() for o in r.operands) == ["a", "a", "b", "b"]
    c = conflicts.first()
    assert (c.restatement_type, c.status, c.operands[1].doc_id) == ("EXPLICIT_RESTATEMENT", "CONFLICT", "b") and "as restated" in c.explanation
    s = scores.first()
    assert (s.n_verified, s.n_wrong_math, s.n_conflict, s.n_propagated_error, s.total_checkable, s.unweighted_score) == (3, 2, 1, 1, 6, 50.0)


def test_store(spark, tmp_path):
    store.create(spark, "audits_test")
    rows = spark.createDataFrame([(1, 7, "T"), (2, 7, "T"), (3, 8, "T")], "id long, org_id long, ticker string")
    store.append(rows, "audits_test.watchlists")
    store.append(rows, "audits_test.watchlists")
    assert spark.table("audits_test.watchlists").count() == 2 and sum(not t.isTemporary for t in spark.catalog.listTables("audits_test")) == 8
    spark.sql("DROP DATABASE audits_test CASCADE")


def test_readers(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"documents": [{"id": "A", "gold_claims": [{"claim_text": "t", "operation": "sum", "stated_value": 3, "operands": [{"value": 1, "source": "grounded"}], "expected_status": "VERIFIED"}]}]}))
    g = filings.read_gold(spark, str(tmp_path / "gold.json")).first()
    assert (g.doc_id, g.ord, g.operation, g.operands[0].value, g.expected_status) == ("A", 0, "sum", 1.0, "VERIFIED")
    (tmp_path / "t1.json").write_text(json.dumps({"ticker": "abc", "raw": "[]"}))
    assert filings.read_replays(spark, str(tmp_path / "t1.json")).first().doc_id == "ABC"
    assert filings.newest_file(spark, str(tmp_path), "*.json").endswith("t1.json")


def test_pivot_reads_facts_once(spark, tmp_path):
    """Fields of the period that assets end; the preferred tag, then the longest span, the last filed; other periods, forms and facts without an end take no part."""
    rows = [
        ("a", "Assets", "USD", None, "2022-12-31", 10.0, "10-K", "2023-02-01", 0), ("a", "Assets", "USD", None, "2023-12-31", 11.0, "10-K", "2024-02-01", 1),
        ("a", "Assets", "USD", None, "2023-12-31", 12.0, "10-K", "2024-03-01", 2), ("a", "Assets", "USD", None, "2024-03-31", 99.0, "10-Q", "2024-05-01", 3),
        ("a", "Liabilities", "USD", None, "2022-12-31", 5.0, "10-K", "2023-02-01", 4), ("a", "Liabilities", "USD", None, None, 6.0, "10-K", "2023-02-01", 5),
        ("a", "ProfitLoss", "USD", "2023-01-01", "2023-12-31", 3.0, "10-K", "2024-02-01", 6), ("a", "NetIncomeLoss", "USD", "2023-10-01", "2023-12-31", 1.0, "10-K", "2024-02-01", 7),
        ("b", "Unknown", "USD", None, "2023-12-31", 1.0, "10-K", "2024-02-01", 8), ("c", "Assets", "USD", None, None, 1.0, "10-K", "2024-02-01", 9), ("d", "Assets", "USD", None, "2024-03-31", 1.0, "10-Q", "2024-05-01", 10),
    ]
    path = str(tmp_path / "facts")
    spark.createDataFrame(rows, "entity string, tag string, unit string, start string, end string, val double, form string, filed string, pos int").withColumns({c: F.col(c).cast("date") for c in ("start", "end", "filed")}).write.parquet(path)
    x = X.pivoted(spark.read.parquet(path))
    got = {r.entity: r for r in x.collect()}
    assert sorted(got) == ["a", "b", "c"]
    a = got["a"]
    assert (str(a.period_end), a.assets, a.liabilities, a.net_income_total, a.tags_used) == ("2023-12-31", 12.0, None, 3.0, {"assets": "Assets", "net_income_total": "ProfitLoss"})
    assert all(got[e].period_end is None and got[e].assets is None and got[e].tags_used is None for e in "bc")
    pins = spark.sql("SELECT 'a' AS entity, DATE'2022-12-31' AS end")
    pinned = {r.entity: r for r in X.pivoted(spark.read.parquet(path), pins=pins).collect()}
    assert (pinned["a"].assets, pinned["a"].liabilities, pinned["b"].period_end) == (10.0, 5.0, None) and len(pinned) == 3
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_panels_score_in_one_aggregation(spark, tmp_path):
    rows = [("d", "VERIFIED", True, True, False), ("d", "WRONG_MATH", True, True, False), ("d", "INSUFFICIENT_EVIDENCE", False, False, True), ("e", "INSUFFICIENT_EVIDENCE", False, False, False)]
    path = str(tmp_path / "records")
    spark.createDataFrame(rows, "doc_id string, status string, evidence_emitted boolean, evidence_gate_satisfied boolean, adjudicated boolean").write.parquet(path)
    r = spark.read.parquet(path)
    p = dashboards.record_panels(r)
    got = {(x.doc_id, x.panel): (x.state, x.value) for x in p.collect()}
    assert got == {("d", "verification_score"): ("ok", 50.0), ("d", "evidence_coverage"): ("ok", 66.7), ("d", "disclosure_quality"): ("ok", 100.0), ("e", "verification_score"): ("unassessed", None), ("e", "evidence_coverage"): ("ok", 0.0), ("e", "disclosure_quality"): ("ok", 0.0)}
    assert p._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    scores = C.score(r, ["doc_id"]).withColumn("score", F.lit(12.5))
    assert {x.value for x in dashboards.record_panels(r, scores).filter("doc_id = 'd' and panel = 'verification_score'").collect()} == {12.5}


def test_a_score_between_two_places_is_even_in_any_order(spark):
    status = {1.0: "VERIFIED", 0.4: "UNSUPPORTED_NUMBER", 0.0: "WRONG_MATH"}
    weights = {"a": [1.0] * 9 + [0.4] * 4 + [0.0] * 3, "b": [0.4] * 24 + [1.0] + [0.0] * 7, "c": [0.4] * 1 + [1.0] * 11 + [0.0] * 4, "d": [0.4] * 7 + [1.0] * 5 + [0.0] * 4}
    rows = [(f"{d}{turn}", status[w]) for d, ws in weights.items() for turn, order in enumerate((ws, ws[::-1], sorted(ws), ws[5:] + ws[:5])) for w in order]
    got = {r.doc_id: (r.score, r.unweighted_score) for r in C.score(spark.createDataFrame(rows, "doc_id string, status string").coalesce(1), ["doc_id"]).collect()}
    want = {d: float((Decimal(sum(int(w * 10) for w in ws) * 10) / len(ws)).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for d, ws in weights.items()}
    assert got == {k: (want[k[0]],) * 2 for k in got} and len(got) == 16 and want["a"] == 66.2


def test_numbers_are_shown_by_their_exact_value(spark):
    rng = random.Random(5)
    xs = [2868067650821229568.0, -2.0**62 - 2.0**11, 12345678901234567890123.0, -1.5e37, 1e19, 2.0**63, 0.0, -0.0, 12345.25, 12345.75, 100012.5, 1.000005, 0.1234565, -0.0001234565, 1234567.5, 0.5, float("nan"), float("inf")]
    xs += [rng.randrange(10**6, 10**7) / 10 ** rng.randrange(1, 11) for _ in range(2000)] + [(rng.randrange(10**5, 10**6) * 10 + 5) / 10 ** rng.randrange(1, 11) for _ in range(4000)] + [float(rng.randrange(2**100)) for _ in range(100)]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", C.shown(F.col("x")).alias("s")).orderBy("i").collect()]
    want = ["NaN" if x != x else "Infinity" if x == float("inf") else f"{x:.0f}" if x % 1 == 0 else f"{x:g}" for x in xs]
    assert [(x, g, w) for x, g, w in zip(xs, got, want, strict=True) if g != w] == []


def test_html_is_passed_over_only_for_what_it_has(spark):
    texts = ["a &amp; b\t\u00a0 c\u00a0d  e f &#65; &zz; x", " <p>no\n \n\n\n\n entity</p>\t", "plain  words", "", None, "&nbsp;&lt;\n&gt; ", "a\u00a0", "A&", "\n"]

    def brute(x):
        x = x or ""
        for tag in ("script", "style"):
            x = re.sub(rf"(?is)<{tag}.*?</{tag}>", " ", x)
        x = re.sub(r"<[^>]+>", " ", x)
        for entity, char in T.ENTITIES:
            x = x.replace(entity, char)
        x = re.sub(r"&[a-zA-Z]+;", " ", re.sub(r"&#x?[0-9a-fA-F]+;", " ", x))
        x = re.sub(r"[ \t\u00a0]+", " ", x)
        return re.sub(r"(?a)^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", re.sub(r"(?a)\s*\n\s*", "\n", x)))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.strip_html(F.col("t")).alias("s")).orderBy("i")
    assert [r.s for r in df.collect()] == [brute(t) for t in texts]


def test_weighted_score_has_the_logarithms_of_the_original(spark):
    """Claims of equal weight whose score lies between two places: the last bit of the logarithm decides (F9)."""
    want, rows = {}, []
    for n in (0, 2, 13, 47, 73):
        for total in (16, 32, 40, 80, 160):
            for right in range(1, total, 2):
                doc, top, of = f"{n}-{total}-{right}", 0.0, 0.0
                for i in range(total):
                    t = 1.0 + math.log(1.0 + n)
                    top, of = top + (1.0 if i < right else 0.0) * t, of + t
                    rows.append((doc, i, "VERIFIED" if i < right else "WRONG_MATH", n))
                want[doc] = round(top / of * 100 * 10) / 10
    v = spark.createDataFrame(rows, "doc_id string, ord long, status string, downstream long")
    got = {r.doc_id: r.score for r in C.score(v, ["doc_id"], "downstream", order="ord").collect()}
    assert got == want


def test_audits_add_scores_up_in_the_order_of_the_claims(spark):
    """Scores between two places, each by the doubles of its own order of claims (F3)."""
    rng = random.Random(5)
    weight, status = {"VERIFIED": 1.0, "UNSUPPORTED_NUMBER": 0.4, "WRONG_MATH": 0.0}, ["VERIFIED"] * 9 + ["UNSUPPORTED_NUMBER"] * 4 + ["WRONG_MATH"] * 3
    docs = {i: rng.sample(status, 16) for i in range(40)}

    def flat(statuses):
        total = 0.0
        for s in statuses:
            total += weight[s]
        return round(total / 16 * 100 * 10) / 10

    want = {i: flat(d) for i, d in docs.items()}
    assert len(set(want.values())) == 2
    rows = [(i, n, s, 0) for i, d in docs.items() for n, s in enumerate(d)]
    rng.shuffle(rows)
    got = audit.scored(spark.createDataFrame(rows, "doc_id int, ord long, status string, downstream long")).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.unweighted_score for r in got} == want


def test_gold_documents_that_fit_in_a_row_are_not_written(spark, monkeypatch):
    """Rows and the steps over all tasks give the same; claims and pairs of documents that fit in a row are neither written nor joined (F1)."""
    rng, words, kept = random.Random(9), "revenue income assets grew fell margin the of quarter".split(), []
    claim = lambda i: (rng.choice([None, *range(8)]), i // 2, " ".join(rng.choice(words) for _ in range(rng.randrange(6))) or None, rng.choice([None, 0.0, 0.04, 5.0, 5.04, 100.0, 100.9, -7.0, 1e9]), rng.choice([None, "sum", "ratio"]))
    schema = "doc_id int, ord long, claim_text string, stated_value double, operation string"
    p, g = (spark.createDataFrame([claim(i) for i in range(n)], schema) for n in (120, 100))
    rows = lambda df: sorted(([None if v is None else round(v, 9) for v in r] for r in df.collect()), key=str)
    real = gold.cut
    monkeypatch.setattr(gold, "cut", lambda df: kept.append(df.columns) or real(df))
    fit = gold.matches(p, g)
    assert kept == [["doc_id"]] and " Join" not in fit._jdf.queryExecution().optimizedPlan().toString()
    assert rows(fit) == rows(gold.matches(p, g, most=0)) == rows(gold.matches(p, g, most=150)) and len(kept) > 5


def test_texts_are_passed_over_once_a_step(spark):
    """Steps that made a text anew for each use of it, or went through it by an expression where it has nothing to find (F2)."""
    plan = lambda c: spark.createDataFrame([("x",)], "t string").select(c.alias("z"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not re.search(r"contains\(lower\(", plan(T.statement_score(F.col("t"))))
    assert plan(statements.statements("t")).count("split(") == 6 and "regexp_replace" not in plan(statements.statements("t"))

    rng = random.Random(3)
    bits = ["Total  Assets", "TOTAL\nliabilities", "liabilities and equity", "total Shareowners\u2019 equity", "total stockholders' equity", " of ", "$ 12,345", " 1234", "98765,", "\u00e9", "x" * 39, "Total equity", ". "]
    texts = ["".join(rng.choice(bits[:-5] if i % 2 else bits) for _ in range(rng.randrange(30))) for i in range(600)] + [""]
    last = lambda row, t: max((m.end() for m in re.finditer(row, t, re.ASCII)), default=0)
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(statements.sheet_end(F.col("t")).alias("n")).collect()]
    assert got == [max(last(T.ASSETS_ROW, t), last(T.CLAIMS_ROW, t)) for t in texts] and len(set(got)) > 50

    blank = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and re.match(r"[\s]", chr(i)) and i not in range(0x1C, 0x20))
    assert set(blank) == set(T.ANY_BLANK) and set(T.BLANK) == {c for c in map(chr, range(128)) if re.match(r"(?a)\s", c)}
    html = ["a<SCRIPT>x</script>b<Style>y</STYLE>c", "<span>a</span>  \t\u00a0 b", "a<s b", "\u2003 a \u2003", "a\t\tb   c     d"]
    assert [r.s for r in spark.createDataFrame(list(enumerate(html)), "i int, t string").orderBy("i").select(T.strip_html(F.col("t")).alias("s")).collect()] == ["a b c", "a b", "a<s b", "\u2003 a \u2003", "a b c d"]
    assert [r.s for r in spark.createDataFrame([(0, "\u2003 a \u3000"), (1, "\x1ca\x85")], "i int, t string").orderBy("i").select(statements.statements("t").alias("s")).collect()] == ["a", "\x1ca"]
