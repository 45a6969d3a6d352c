"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T
from proofgrid.operators import claims as C
from proofgrid.operators import compare, dashboards, graph, series
from proofgrid.sources import claims_json, sinks, tables

from . import adapters as A
from .base import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def opened(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(F.array("r")))


# Verdicts of scalar claims.


@query("verdict_counts", f"WITH {A.CLAIMS} SELECT status, count(*)::BIGINT AS n FROM verdicts GROUP BY 1")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.verify(A.claims(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("verify_ladder", f"WITH {A.CLAIMS} SELECT doc_id, claim_id, operation, status, CASE WHEN status IN ('VERIFIED', 'WRONG_MATH') THEN c END AS recomputed, CASE WHEN status IN ('VERIFIED', 'WRONG_MATH') THEN stated_value - c END AS delta FROM verdicts")
def verify_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return C.verify(A.claims(spark, sf)).select("doc_id", "claim_id", "operation", "status", "recomputed", "delta")


@query("verdicts_by_operation", f"WITH {A.CLAIMS} SELECT d.dimension, CASE d.dimension WHEN 'operation' THEN operation ELSE doc_id END AS value, status, count(*)::BIGINT AS n FROM verdicts, (VALUES ('operation'), ('doc_id')) d(dimension) GROUP BY 1, 2, 3")
def verdicts_by_operation(spark: SparkSession, sf: str) -> DataFrame:
    return C.breakdown(C.verify(A.claims(spark, sf)), "operation", "doc_id")


@query("score_flat", f"""WITH {A.CLAIMS}, w AS (SELECT *, CASE status WHEN 'VERIFIED' THEN 1.0::DOUBLE WHEN 'WRONG_MATH' THEN 0.0 WHEN 'UNSUPPORTED_NUMBER' THEN 0.4 WHEN 'AMBIGUOUS' THEN 0.4 END AS w FROM verdicts)
SELECT doc_id, count(*) FILTER (status = 'VERIFIED')::BIGINT AS n_verified, count(w)::BIGINT AS total_checkable, count(w) > 0 AS score_available, round_even(coalesce(avg(w), 0) * 100, 1) AS score FROM w GROUP BY 1""")
def score_flat(spark: SparkSession, sf: str) -> DataFrame:
    return C.score(C.verify(A.claims(spark, sf)), ["doc_id"]).select("doc_id", "n_verified", "total_checkable", "score_available", "score")


@query("calibration", f"""WITH {A.CLAIMS} SELECT operation, count(*)::BIGINT AS n, count(*) FILTER (status = 'VERIFIED')::BIGINT AS n_verified, count(*) FILTER (status = 'WRONG_MATH')::BIGINT AS n_wrong, count(*) FILTER (status IN ('VERIFIED', 'WRONG_MATH'))::BIGINT AS n_high, count(*) FILTER (status IN ('AMBIGUOUS', 'UNSUPPORTED_NUMBER'))::BIGINT AS n_low,
round(CASE WHEN n_verified + n_wrong > 0 THEN n_verified * 100.0::DOUBLE / (n_verified + n_wrong) END, 6) AS precision_pct, round((n_verified + n_wrong) * 100.0::DOUBLE / n, 6) AS coverage_pct FROM verdicts GROUP BY 1""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    c = C.calibration(C.verify(A.claims(spark, sf)), "operation")
    return c.select("operation", "n", "n_verified", "n_wrong", "n_high", "n_low", F.round("precision_pct", 6).alias("precision_pct"), F.round("coverage_pct", 6).alias("coverage_pct"))


@query("verdict_maps", f"WITH {A.CLAIMS}, n AS (SELECT doc_id, status, count(*)::BIGINT AS c FROM verdicts GROUP BY 1, 2) SELECT doc_id, string_agg(status || '=' || c, ',' ORDER BY status) AS counts FROM n GROUP BY 1")
def verdict_maps(spark: SparkSession, sf: str) -> DataFrame:
    m = sinks.verdict_counts(C.verify(A.claims(spark, sf)), "doc_id")
    return m.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("failure_buckets", f"""WITH {A.CLAIMS}, x AS (SELECT *, CASE WHEN status = 'AMBIGUOUS' AND key % 2 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE status END AS s, key % 4 = 0 AS emitted, CASE WHEN key % 8 = 2 THEN 'cash_flow_tie_out' ELSE 'eps_reconciliation' END AS rule FROM verdicts),
b AS (SELECT CASE s WHEN 'VERIFIED' THEN 'auto:true_positive_candidate' WHEN 'WRONG_MATH' THEN 'auto:NEEDS_REVIEW_HIGH(conviction)' WHEN 'INSUFFICIENT_EVIDENCE' THEN CASE WHEN emitted THEN 'verifier_gate_fired:by_design' WHEN rule = 'cash_flow_tie_out' THEN 'verifier_safety_net:restricted_cash_label_caught' ELSE 'extraction_failure:missing_evidence_flags' END
 WHEN 'AMBIGUOUS' THEN 'verifier_structural:variant_or_count_or_div0' ELSE 'extraction_failure:missing_operand' END AS bucket FROM x) SELECT bucket, split_part(bucket, ':', 1) AS owner, count(*)::BIGINT AS n FROM b GROUP BY 1, 2""")
def failure_buckets(spark: SparkSession, sf: str) -> DataFrame:
    v = C.verify(A.claims(spark, sf))
    s = F.when((F.col("status") == K.AMBIGUOUS) & (F.col("key") % 2 == 0), K.INSUFFICIENT).otherwise(F.col("status"))
    rule = F.when(F.col("key") % 8 == 2, "cash_flow_tie_out").otherwise("eps_reconciliation")
    return v.select(C.bucket(s, F.col("key") % 4 == 0, rule, F.lit(True)).alias("bucket")).groupBy("bucket", F.split_part("bucket", F.lit(":"), F.lit(1)).alias("owner")).agg(F.count("*").alias("n"))


@query("dashboard_panels", f"""WITH {A.CLAIMS}, p AS (SELECT doc_id, key % 2 = 0 AS emitted, key % 4 = 0 AS gate, key % 3 = 0 AS adjudicated, CASE WHEN status = 'AMBIGUOUS' THEN 'INSUFFICIENT_EVIDENCE' ELSE status END AS status FROM verdicts),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (status <> 'INSUFFICIENT_EVIDENCE') AS w, round_even(avg(CASE status WHEN 'VERIFIED' THEN 1.0::DOUBLE WHEN 'WRONG_MATH' THEN 0 WHEN 'UNSUPPORTED_NUMBER' THEN 0.4 END) * 100, 1) AS score,
 count(*) FILTER (emitted) AS e, count(*) FILTER (gate) AS ok, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE') AS d, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE' AND (emitted OR adjudicated)) AS g, count(*) FILTER (status = 'VERIFIED') AS v FROM p GROUP BY 1)
SELECT doc_id, 'verification_score' AS panel, CASE WHEN w > 0 THEN 'ok' ELSE 'unassessed' END AS state, score AS value, v::BIGINT AS part FROM a UNION ALL SELECT doc_id, 'evidence_coverage', 'ok', round_even(e * 100.0::DOUBLE / n, 1), ok FROM a
UNION ALL SELECT doc_id, 'disclosure_quality', 'ok', CASE WHEN d = 0 THEN 100.0::DOUBLE ELSE round_even(g * 100.0::DOUBLE / d, 1) END, g FROM a""")
def dashboard_panels(spark: SparkSession, sf: str) -> DataFrame:
    v = C.verify(A.claims(spark, sf)).withColumns({"evidence_emitted": F.col("key") % 2 == 0, "evidence_gate_satisfied": F.col("key") % 4 == 0, "adjudicated": F.col("key") % 3 == 0, "status": F.when(F.col("status") == K.AMBIGUOUS, K.INSUFFICIENT).otherwise(F.col("status"))})
    return dashboards.record_panels(v).select("doc_id", "panel", "state", "value", F.coalesce(*[F.try_element_at("parts", F.lit(k)) for k in ("verified", "evidence_gate_satisfied", "explained")]).alias("part"))


@query("pipeline_status", f"""WITH {A.REVENUE} SELECT entity, fy, CASE WHEN k % 5 = 0 THEN 'fetch_failed' WHEN k % 7 = 0 THEN 'extraction_unavailable' WHEN k % 11 = 0 THEN 'silent_degradation' WHEN fy % 4 = 0 THEN 'extraction_empty' WHEN fy % 4 = 1 THEN 'vacuous_no_checkable' ELSE 'ok' END AS status FROM rev""")
def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    k, y = F.col("k"), F.col("fy")
    return A.revenue(spark, sf).select("entity", "fy", C.pipeline_status(k % 5 != 0, k % 7 != 0, k % 11 == 0, y % 4, F.when(y % 4 == 1, 0).otherwise(1)).alias("status"))


@query("audit_rows", f"""WITH {A.CLAIMS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY claim_id)::BIGINT AS row, operation, status AS verdict, array_to_string(list_transform(vals, lambda x: CASE WHEN missing THEN 'year; doc=' || doc_id || ' [missing]' ELSE 'year; doc=' || doc_id || ' [grounded]' END), '; ') AS operand_sources,
CASE WHEN stated_value IS NULL THEN '' WHEN stated_value = floor(stated_value) THEN printf('%.0f', stated_value) ELSE printf('%g', stated_value) END AS stated_value, 'T0' AS run_timestamp FROM verdicts""")
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = C.verify(A.claims(spark, sf))
    operands = F.transform("operands", lambda o: F.struct(o["value"].alias("value"), o["source"].alias("source"), F.lit("year").alias("category"), F.lit(None).cast("string").alias("source_text"), F.col("doc_id").alias("doc_id")))
    none = {n: F.lit(None).cast("string") for n in ("claim_text", "rule_name", "eps_variant", "caused_by", "explanation", "source_text")}
    rows = C.audit_rows(v.withColumns({"operands": operands, **none}), ["claim_id"], F.lit("T0"))
    return rows.select("doc_id", "row", "operation", "verdict", "operand_sources", "stated_value", "run_timestamp")


# Rules of statements.

CLASSIFY = "CASE WHEN abs({s} - {c}) / greatest(abs({c}), 1e-9) <= {t} THEN 'VERIFIED' ELSE 'WRONG_MATH' END"


@query("rule_balance_sheet", f"""WITH {A.STATEMENTS}, x AS (SELECT *, liabilities + equity AS c, {CLASSIFY.format(s='assets', c='(liabilities + equity)', t=0.001)} AS s0 FROM st),
y AS (SELECT *, CASE WHEN liabilities = 0 AND assets <> 0 AND equity <> 0 THEN 1 WHEN NOT coalesce(CASE key % 3 WHEN 0 THEN TRUE WHEN 1 THEN key % 2 = 0 END, FALSE) THEN 1 ELSE 0 END AS early FROM x)
SELECT key, CASE WHEN early = 1 OR (s0 = 'WRONG_MATH' AND (key % 8 = 1 OR key % 16 = 5)) THEN 'INSUFFICIENT_EVIDENCE' ELSE s0 END AS status, CASE WHEN early = 0 THEN c END AS recomputed, CASE WHEN early = 0 THEN assets - c END AS delta FROM y""")
def rule_balance_sheet(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("key")
    complete = F.when(k % 3 == 0, True).when(k % 3 == 1, k % 2 == 0)
    return opened(A.statements(spark, sf).withColumn("r", K.balance_sheet(F.array("assets", "liabilities", "equity"), complete, k % 8 == 1, k % 16 == 5)), "key")


@query("rule_balance_sheet_itemized", f"""WITH {A.STATEMENTS} SELECT key, CASE WHEN key % 5 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE {CLASSIFY.format(s='assets', c='(liabilities * 0.25 + liabilities * 0.75 + equity)', t=0.001)} END AS status,
CASE WHEN key % 5 <> 0 THEN round(liabilities * 0.25 + liabilities * 0.75 + equity, 4) END AS recomputed FROM st""")
def rule_balance_sheet_itemized(spark: SparkSession, sf: str) -> DataFrame:
    li = F.col("liabilities")
    r = K.itemized_balance_sheet(F.col("assets"), F.array(li * 0.25, li * 0.75), F.col("equity"), F.when(F.col("key") % 5 != 0, True))
    return A.statements(spark, sf).withColumn("r", r).select("key", "r.status", F.round("r.recomputed", 4).alias("recomputed"))


HALF = """CASE WHEN {v} = 0 THEN 0.0::DOUBLE WHEN {v} >= 1e16 OR {v} < 1e-4 THEN least(0.5, {v} * 0.001) WHEN {v} <> floor({v}) THEN 0.5 * pow(10.0, -length(split_part({v}::VARCHAR, '.', 2)))
 WHEN regexp_matches({v}::DECIMAL(38,0)::VARCHAR, '0$') THEN least(0.5 * pow(10.0, length({v}::DECIMAL(38,0)::VARCHAR) - length(rtrim({v}::DECIMAL(38,0)::VARCHAR, '0'))), {v} * 0.001) ELSE 0.5::DOUBLE END"""


@query("half_ulp", f"WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, round(l_quantity * 1000, 0) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {HALF.format(v='a')} AS price_half, {HALF.format(v='b')} AS units_half FROM v")
def half_ulp(spark: SparkSession, sf: str) -> DataFrame:
    x = A.table(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", K.half_ulp(F.col("l_extendedprice")).alias("price_half"), K.half_ulp(F.round(F.col("l_quantity") * 1000, 0)).alias("units_half"))


@query("rule_eps", f"""WITH {A.STATEMENTS}, x AS (SELECT key, income, shares, income / shares * CASE WHEN key % 6 = 1 THEN 1.1::DOUBLE WHEN key % 6 = 2 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS stated, CASE WHEN key % 10 = 7 THEN NULL WHEN key % 10 = 8 THEN 'total' ELSE 'continuing' END AS ib FROM st WHERE shares > 0),
y AS (SELECT *, floor(stated * 100) / 100 AS eps, income / shares AS c FROM x), h AS (SELECT *, {HALF.format(v='eps')} AS he, {HALF.format(v='income')} AS hi, {HALF.format(v='shares')} AS hs FROM y),
t AS (SELECT *, greatest(0.005, CASE WHEN eps = floor(eps) AND he > 0.005 THEN 0.005 ELSE he END + hi / shares + income / (shares * shares) * hs) AS tol FROM h),
g AS (SELECT *, CASE WHEN ib IS NULL OR ib <> 'continuing' THEN 1 WHEN eps >= 1e-9 AND c >= 1e-9 AND greatest(eps, c) / least(eps, c) >= 20 THEN 2 ELSE 0 END AS early FROM t)
SELECT key, CASE WHEN early > 0 OR (abs(eps - c) > tol AND key % 12 = 1) THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(eps - c) <= tol THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status, CASE WHEN early <> 1 THEN c END AS recomputed FROM g""")
def rule_eps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("key")
    times = F.when(k % 6 == 1, 1.1).when(k % 6 == 2, 1000.0).otherwise(1.0)
    stated = F.floor(F.col("income") / F.col("shares") * times * 100).cast("double") / 100
    ib = F.when(k % 10 == 7, F.lit(None)).when(k % 10 == 8, "total income").otherwise("Continuing operations")
    r = K.eps(F.array(stated, F.col("income"), F.col("shares")), F.lit("continuing"), ib, k % 12 == 1)
    return A.statements(spark, sf).filter("shares > 0").withColumn("r", r).select("key", "r.status", "r.recomputed")


@query("rule_cash", f"""WITH {A.STATEMENTS}, x AS (SELECT key, assets, assets * CASE WHEN key % 5 = 2 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS flow FROM st) SELECT key, CASE WHEN key % 9 = 0 OR key % 10 = 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE {CLASSIFY.format(s='flow', c='assets', t=0.0001)} END AS status FROM x""")
def rule_cash(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("key")
    flow = F.col("assets") * F.when(k % 5 == 2, 1.01).otherwise(1.0)
    flag = K.restricted_flag(F.when(k % 9 == 0, True).when(k % 2 == 0, False), F.when(k % 10 == 2, "Cash and restricted cash").otherwise("Cash"), F.lit("cash at the end"))
    return A.statements(spark, sf).withColumn("r", K.cash(F.array(flow, F.col("assets")), flag)).select("key", "r.status")


# Series.


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """(k, entity, v, p) arrays of a nation's years in order."""
    a = A.revenue(spark, sf).groupBy("k", "entity").agg(F.array_sort(F.collect_list(F.struct("fy", "v"))).alias("s"))
    return a.select("k", "entity", F.transform("s", lambda x: x["v"]).alias("v"), F.transform("s", lambda x: x["fy"].cast("string")).alias("p"))


LAGS = A.REVENUE + ", d AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY fy) AS diff, lag(v) OVER (PARTITION BY k ORDER BY fy) AS old, max(fy) OVER (PARTITION BY k) AS last FROM rev)"


@query("trend_direction", f"""WITH {A.REVENUE}, m AS (SELECT *, max(fy) OVER (PARTITION BY k) AS last FROM rev), w AS (SELECT * FROM m WHERE fy >= last - 1 - k % 2), d AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY fy) AS diff, lag(v) OVER (PARTITION BY k ORDER BY fy) AS old FROM w)
SELECT entity, dir, CASE WHEN count(diff) < 1 THEN 'AMBIGUOUS' WHEN bool_and(CASE dir WHEN 'up' THEN diff > 0 WHEN 'down' THEN diff < 0 ELSE abs(diff) <= greatest(abs(old), 1e-9) * 0.001 END) FILTER (diff IS NOT NULL) THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status FROM d, (VALUES ('up'), ('down'), ('flat')) t(dir) GROUP BY 1, 2""")
def trend_direction(spark: SparkSession, sf: str) -> DataFrame:
    r = A.revenue(spark, sf).withColumn("last", F.max("fy").over(Window.partitionBy("k"))).filter(F.col("fy") >= F.col("last") - 1 - F.col("k") % 2)
    a = r.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("fy", "v"))), lambda x: x["v"]).alias("v"))
    d = a.withColumn("dir", F.explode(F.array(*map(F.lit, ("up", "down", "flat")))))
    return d.withColumn("r", K.trend(F.col("v"), F.col("dir"))).select("entity", "dir", "r.status")


@query("superlative", f"""WITH {A.REVENUE}, t AS (SELECT *, CASE k % 3 WHEN 0 THEN '1997' WHEN 1 THEN '1890' END AS target, max(fy) OVER (PARTITION BY k) AS last FROM rev),
a AS (SELECT entity, target, max(v) AS hi, min(v) AS lo, max(v) FILTER (fy::VARCHAR = coalesce(target, last::VARCHAR)) AS own FROM t GROUP BY 1, 2)
SELECT entity, which, CASE WHEN own IS NULL THEN 'AMBIGUOUS' WHEN own = CASE which WHEN 'max' THEN hi ELSE lo END THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status, CASE WHEN own IS NOT NULL THEN CASE which WHEN 'max' THEN hi ELSE lo END END AS recomputed FROM a, (VALUES ('max'), ('min')) w(which)""")
def superlative(spark: SparkSession, sf: str) -> DataFrame:
    target = F.when(F.col("k") % 3 == 0, "1997").when(F.col("k") % 3 == 1, "1890")
    d = yearly(spark, sf).withColumn("which", F.explode(F.array(F.lit("max"), F.lit("min"))))
    return d.withColumn("r", K.superlative(F.col("p"), F.col("v"), F.col("which"), target)).select("entity", "which", "r.status", "r.recomputed")


@query("consecutive_count", f"""WITH {LAGS}, b AS (SELECT *, sum(CASE WHEN dir = 'up' AND diff > 0 OR dir = 'down' AND diff < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY k, dir ORDER BY fy DESC) AS breaks FROM d, (VALUES ('up'), ('down')) t(dir) WHERE diff IS NOT NULL)
SELECT entity, dir, count(*) FILTER (breaks = 0)::DOUBLE AS recomputed, CASE WHEN count(*) FILTER (breaks = 0) = 1 + k % 2 THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status FROM b GROUP BY k, 1, 2""")
def consecutive_count(spark: SparkSession, sf: str) -> DataFrame:
    d = yearly(spark, sf).withColumn("dir", F.explode(F.array(F.lit("up"), F.lit("down"))))
    return d.withColumn("r", K.consecutive(F.col("v"), F.col("dir"), (1 + F.col("k") % 2).cast("double"))).select("entity", "dir", "r.recomputed", "r.status")


@query("aggregate_filter", f"""WITH {A.REVENUE}, a AS (SELECT entity, k, sum(n) FILTER (n % 2 = 0)::DOUBLE AS s, count(*) FILTER (n % 2 = 0)::DOUBLE AS c FROM rev GROUP BY 1, 2)
SELECT entity, mode, CASE WHEN c = 0 THEN 'AMBIGUOUS' WHEN abs(CASE mode WHEN 'sum' THEN s ELSE c END * CASE WHEN k % 2 = 0 THEN 1.0 ELSE 1.02 END - CASE mode WHEN 'sum' THEN s ELSE c END) / CASE mode WHEN 'sum' THEN s ELSE c END <= 0.005 THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status FROM a, (VALUES ('sum'), ('count')) m(mode)""")
def aggregate_filter(spark: SparkSession, sf: str) -> DataFrame:
    a = A.revenue(spark, sf).groupBy("entity", "k").agg(F.collect_list(F.when(F.col("n") % 2 == 0, F.col("n").cast("double"))).alias("v")).withColumn("mode", F.explode(F.array(F.lit("sum"), F.lit("count"))))
    true = F.when(F.col("mode") == "sum", F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).otherwise(F.size("v").cast("double"))
    return a.withColumn("r", K.aggregate_filter(F.col("v"), true * F.when(F.col("k") % 2 == 0, 1.0).otherwise(1.02), F.col("mode"))).select("entity", "mode", "r.status")


@query("mda_direction", f"""WITH {LAGS} SELECT entity, fy, dir, CASE WHEN old IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(diff / abs(old) * 100) <= 2 OR dir = 'flat' THEN 'NEEDS_REVIEW' WHEN (dir = 'up') = (diff > 0) THEN 'VERIFIED' ELSE 'CONFLICT' END AS status FROM d, (VALUES ('up'), ('down'), ('flat')) t(dir)""")
def mda_direction(spark: SparkSession, sf: str) -> DataFrame:
    d = A.revenue(spark, sf).withColumn("old", F.lag("v").over(Window.partitionBy("k").orderBy("fy"))).withColumn("dir", F.explode(F.array(*map(F.lit, ("up", "down", "flat")))))
    return d.withColumn("r", K.mda(F.col("dir"), K.change_over_prior(F.col("old"), F.col("v")))).select("entity", "fy", "dir", "r.status")


@query("comparable_series", f"WITH {A.FACTS} SELECT entity, tag, unit, form, end_d AS \"end\", val, fy FROM pts")
def comparable_series(spark: SparkSession, sf: str) -> DataFrame:
    return series.comparable(A.facts(spark, sf)).select("entity", "tag", "unit", "form", "end", "val", "fy")


TAGS = [("revenue", "Revenues", 0, "USD", False), ("revenue", "SalesRevenueNet", 1, "USD", False), ("assets", "Assets", 0, "USD", True)]
TAG_ROWS = "t(concept, tag, tag_rank, split) AS (VALUES ('revenue', 'Revenues', 0, FALSE), ('revenue', 'SalesRevenueNet', 1, FALSE), ('assets', 'Assets', 0, TRUE))"
YOY = "CASE WHEN prior <> 0 THEN round_even((val - prior) / prior * 100, 4) END AS yoy"


def tags(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(TAGS, "concept string, tag string, tag_rank int, unit string, split_sensitive boolean"))


@query("tag_fallback", f"""WITH {A.FACTS}, {TAG_ROWS}, j AS (SELECT *, min(tag_rank) OVER (PARTITION BY entity, concept, form) AS best FROM pts JOIN t USING (tag) WHERE unit = 'USD')
SELECT concept, tag, form, count(DISTINCT entity)::BIGINT AS entities, count(*)::BIGINT AS points FROM j WHERE tag_rank = best GROUP BY 1, 2, 3""")
def tag_fallback(spark: SparkSession, sf: str) -> DataFrame:
    p = series.with_fallback(series.comparable(A.facts(spark, sf)), tags(spark))
    return p.groupBy("concept", "tag", "form").agg(F.count_distinct("entity").alias("entities"), F.count("*").alias("points"))


@query("year_on_year", f"WITH {A.FACTS}, l AS (SELECT *, lag(val) OVER (PARTITION BY entity, tag, unit, form ORDER BY end_d) AS prior FROM pts) SELECT entity, tag, unit, form, end_d AS \"end\", {YOY} FROM l")
def year_on_year(spark: SparkSession, sf: str) -> DataFrame:
    return series.year_on_year(series.comparable(A.facts(spark, sf)), "entity", "tag", "unit", "form").select("entity", "tag", "unit", "form", "end", "yoy")


@query("company_memory", f"""WITH {A.FACTS}, {TAG_ROWS}, j AS (SELECT *, min(tag_rank) OVER (PARTITION BY entity, concept) AS best FROM pts JOIN t USING (tag) WHERE unit = 'USD' AND form = '10-K'), l AS (SELECT *, lag(val) OVER (PARTITION BY entity, concept ORDER BY end_d) AS prior FROM j WHERE tag_rank = best), c AS (SELECT *, {YOY} FROM l),
m AS (SELECT entity, concept, any_value(tag) AS tag, any_value(tag_rank) AS tag_rank, any_value(split) AS split, count(*) AS n, arg_max(val, end_d) AS last_val, arg_max(yoy, end_d) FILTER (yoy IS NOT NULL) AS last_yoy FROM c GROUP BY 1, 2),
d AS (SELECT entity, tag, count(*) FILTER (NOT fit) AS dropped FROM fits WHERE unit = 'USD' AND form = '10-K' GROUP BY 1, 2), e AS (SELECT entity, concept FROM (SELECT DISTINCT entity FROM facts WHERE form = '10-K'), (SELECT DISTINCT concept FROM t))
SELECT e.entity, e.concept, m.tag, coalesce(n, 0)::BIGINT AS n_points, last_val, last_yoy, coalesce(dropped, 0)::BIGINT AS n_dropped, array_to_string(list_filter([CASE WHEN dropped > 0 THEN 'noncomparable_spans_dropped' END, CASE WHEN split THEN 'split_sensitive_series' END, CASE WHEN tag_rank > 0 THEN 'fallback_xbrl_tag_used' END], lambda x: x IS NOT NULL), ',') AS signals
FROM e LEFT JOIN m ON m.entity = e.entity AND m.concept = e.concept LEFT JOIN d ON d.entity = e.entity AND d.tag = m.tag""")
def company_memory(spark: SparkSession, sf: str) -> DataFrame:
    m = series.company_memory(A.facts(spark, sf), tags(spark))
    return m.select("entity", "concept", "tag", "n_points", "last_val", "last_yoy", "n_dropped", F.array_join("signals", ",").alias("signals"))


@query("memory_measured", f"""WITH {A.FACTS}, {TAG_ROWS}, j AS (SELECT *, min(tag_rank) OVER (PARTITION BY entity, concept) AS best FROM pts JOIN t USING (tag) WHERE unit = 'USD' AND form = '10-K'), m AS (SELECT entity, concept, any_value(tag) AS tag, any_value(tag_rank) AS r, any_value(split) AS split, count(*) AS n FROM j WHERE tag_rank = best GROUP BY 1, 2),
d AS (SELECT entity, tag, count(*) FILTER (NOT fit) AS dropped FROM fits WHERE unit = 'USD' AND form = '10-K' GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT entity) FROM facts WHERE form = '10-K')::BIGINT AS entities, count(*)::BIGINT AS series, sum(n)::BIGINT AS points, count(*) FILTER (dropped > 0)::BIGINT AS noncomparable_spans_dropped, count(*) FILTER (split)::BIGINT AS split_sensitive_series, count(*) FILTER (r > 0)::BIGINT AS fallback_xbrl_tag_used FROM m LEFT JOIN d USING (entity, tag)""")
def memory_measured(spark: SparkSession, sf: str) -> DataFrame:
    return series.memory_measured(series.company_memory(A.facts(spark, sf), tags(spark)))


@query("comparability_signals", f"""WITH {A.FACTS}, d AS (SELECT entity, tag, form, count(*) FILTER (NOT fit) AS n FROM fits WHERE unit = 'USD' GROUP BY 1, 2, 3), {TAG_ROWS},
j AS (SELECT * FROM d JOIN t USING (tag)) SELECT entity, concept, 'noncomparable_spans_dropped' AS signal FROM j WHERE n > 0 UNION ALL SELECT entity, concept, 'split_sensitive_series' FROM j WHERE split UNION ALL SELECT entity, concept, 'fallback_xbrl_tag_used' FROM j WHERE tag_rank > 0""")
def comparability_signals(spark: SparkSession, sf: str) -> DataFrame:
    return series.signals(series.dropped(A.facts(spark, sf)).join(tags(spark), ["tag", "unit"]))


@query("fact_selection", f"""WITH {A.FACTS}, t(field, tag, tag_rank, dur) AS (VALUES ('revenue', 'Revenues', 0, TRUE), ('revenue', 'SalesRevenueNet', 1, TRUE), ('assets', 'Assets', 0, FALSE)), g(want) AS (VALUES ('10-K'), ('10-Q')),
c AS (SELECT *, row_number() OVER (PARTITION BY want, entity, field ORDER BY tag_rank, end_d DESC, CASE want WHEN '10-Q' THEN -1 ELSE 1 END * coalesce(end_d - start_d, 0) DESC, filed DESC, pos) AS rn FROM facts JOIN t USING (tag) JOIN g ON want = form WHERE unit = 'USD' AND (NOT dur OR CASE want WHEN '10-Q' THEN end_d - start_d BETWEEN 60 AND 100 ELSE end_d - start_d >= 300 END))
SELECT want AS form, entity, field, tag, end_d AS "end", val, filed FROM c WHERE rn = 1""")
def fact_selection(spark: SparkSession, sf: str) -> DataFrame:
    t = F.broadcast(spark.createDataFrame([("revenue", "Revenues", 0, "USD", True), ("revenue", "SalesRevenueNet", 1, "USD", True), ("assets", "Assets", 0, "USD", False)], "field string, tag string, tag_rank int, unit string, duration boolean"))
    return series.select_facts(A.facts(spark, sf), t, ("10-K", "10-Q")).select("form", "entity", "field", "tag", "end", "val", "filed")


@query("trend_controls", f"""WITH {A.FACTS}, {TAG_ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY entity, tag ORDER BY end_d DESC) AS r FROM pts JOIN t USING (tag) WHERE unit = 'USD' AND form = '10-K'),
l AS (SELECT *, val - lag(val) OVER (PARTITION BY entity, tag ORDER BY end_d) AS d, lag(val) OVER (PARTITION BY entity, tag ORDER BY end_d) AS old FROM s WHERE r <= 5), b AS (SELECT *, sum(CASE WHEN d > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY entity, tag ORDER BY end_d DESC) AS breaks FROM l WHERE d IS NOT NULL),
p AS (SELECT entity, tag, any_value(split) AS split, arg_max(old, end_d) AS old, bool_and(d > 0) OR bool_and(d < 0) AS one_way, count(*) FILTER (breaks = 0) AS run FROM b GROUP BY 1, 2), m AS (SELECT entity, tag, arg_max(val, end_d) = max(val) AS top FROM l GROUP BY 1, 2),
k AS (SELECT 'pct' AS kind, c AS control, CASE c WHEN 'positive' THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status FROM p, (VALUES ('positive'), ('negative')) x(c) WHERE NOT split AND old <> 0 UNION ALL SELECT 'direction', c, CASE c WHEN 'positive' THEN 'VERIFIED' ELSE 'WRONG_MATH' END FROM p, (VALUES ('positive'), ('negative')) x(c) WHERE one_way
 UNION ALL SELECT 'run', c, CASE c WHEN 'positive' THEN 'VERIFIED' ELSE 'WRONG_MATH' END FROM p, (VALUES ('positive'), ('negative')) x(c) WHERE run >= 1 UNION ALL SELECT 'max', 'positive', CASE WHEN top THEN 'VERIFIED' ELSE 'WRONG_MATH' END FROM p JOIN m USING (entity, tag))
SELECT kind, control, status, count(*)::BIGINT AS n, count(*)::BIGINT AS passed FROM k GROUP BY 1, 2, 3""")
def trend_controls(spark: SparkSession, sf: str) -> DataFrame:
    points = series.comparable(A.facts(spark, sf)).filter("form = '10-K'").join(tags(spark), ["tag", "unit"])
    c = C.verify(series.controls(series.last_points(points, 5, "entity", "tag", "split_sensitive"), "entity", "tag"))
    return c.groupBy("kind", "control", "status").agg(F.count("*").alias("n"), F.count_if(F.col("status") == F.col("expected")).alias("passed"))


@query("control_check", f"""WITH {A.FACTS}, {TAG_ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY entity, tag ORDER BY end_d DESC) AS r FROM pts JOIN t USING (tag) WHERE unit = 'USD' AND form = '10-K'),
l AS (SELECT *, val - lag(val) OVER (PARTITION BY entity, tag ORDER BY end_d) AS d FROM s WHERE r <= 5), b AS (SELECT *, sum(CASE WHEN d > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY entity, tag ORDER BY end_d DESC) AS breaks FROM l WHERE d IS NOT NULL),
p AS (SELECT entity, tag, any_value(split) AS split, bool_and(d > 0) OR bool_and(d < 0) AS one_way, count(*) FILTER (breaks = 0) AS run FROM b GROUP BY 1, 2), q AS (SELECT tag, sum(CASE WHEN NOT split THEN 1 ELSE 0 END + CASE WHEN one_way THEN 1 ELSE 0 END + CASE WHEN run >= 1 THEN 1 ELSE 0 END)::BIGINT AS c, count(*) AS n FROM p GROUP BY 1)
SELECT tag, c + n AS positive_ok, c + n AS positive_total, c AS negative_ok, c AS negative_total FROM q""")
def control_check(spark: SparkSession, sf: str) -> DataFrame:
    points = series.comparable(A.facts(spark, sf)).filter("form = '10-K'").join(tags(spark), ["tag", "unit"])
    return series.control_check(C.verify(series.controls(series.last_points(points, 5, "entity", "tag", "split_sensitive"), "entity", "tag")), "tag")


# Graphs.


@query("claim_closure", f"WITH RECURSIVE {A.TREE} SELECT doc_id, root, node, dist::INT AS dist FROM near")
def claim_closure(spark: SparkSession, sf: str) -> DataFrame:
    _, e = A.tree(spark, sf)
    return graph.closure(e, e.select("doc_id", F.col("dst").alias("root")).distinct()).select("doc_id", "root", "node", "dist")


@query("propagate_errors", f"""WITH RECURSIVE {A.TREE}, c AS (SELECT near.doc_id, near.node, root, row_number() OVER (PARTITION BY near.doc_id, near.node ORDER BY dist, root) AS rn FROM near JOIN v ON v.doc_id = near.doc_id AND v.node = near.root WHERE v.status IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER'))
SELECT v.doc_id, v.node, CASE WHEN c.root IS NOT NULL AND status NOT IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER') THEN 'PROPAGATED_ERROR' ELSE status END AS status, CASE WHEN status NOT IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER') THEN c.root END AS caused_by FROM v LEFT JOIN c ON c.doc_id = v.doc_id AND c.node = v.node AND rn = 1""")
def propagate_errors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.propagate(*A.tree(spark, sf)).select("doc_id", "node", "status", "caused_by")


@query("score_weighted", f"""WITH RECURSIVE {A.TREE}, dn AS (SELECT doc_id, root AS node, count(*) AS n FROM near GROUP BY 1, 2), w AS (SELECT v.doc_id, CASE status WHEN 'VERIFIED' THEN 1.0::DOUBLE WHEN 'WRONG_MATH' THEN 0.0 WHEN 'UNSUPPORTED_NUMBER' THEN 0.4 END AS w, 1 + ln(1 + coalesce(n, 0)) AS t FROM v LEFT JOIN dn USING (doc_id, node))
SELECT doc_id, count(w)::BIGINT AS total_checkable, round_even(coalesce(sum(w * t) / sum(CASE WHEN w IS NOT NULL THEN t END), 0) * 100, 1) AS score, round_even(coalesce(avg(w), 0) * 100, 1) AS unweighted_score FROM w GROUP BY 1""")
def score_weighted(spark: SparkSession, sf: str) -> DataFrame:
    v, e = A.tree(spark, sf)
    s = C.score(v.join(graph.downstream(e).withColumnRenamed("n", "downstream"), ["doc_id", "node"], "left"), ["doc_id"], "downstream", order="ord")
    return s.select("doc_id", "total_checkable", "score", "unweighted_score")


# Comparison.


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Two documents a segment: customers' balances by nation, in the second some are restated."""
    c = A.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("set_id"), F.col("c_nationkey").cast("string").alias("row_label")).agg(A.exact("c_acctbal").alias("v"))
    two = F.array(F.struct(F.lit("a").alias("d"), F.lit(0).alias("o"), F.col("v").alias("x")), F.struct(F.lit("b").alias("d"), F.lit(1).alias("o"), (F.col("v") * F.when(F.col("row_label").cast("int") % 5 == 0, 1.1).when(F.col("row_label").cast("int") % 5 == 1, 1.001).otherwise(1.0)).alias("x")))
    x = c.select("set_id", "row_label", F.explode(two).alias("e"))
    return x.select("set_id", F.concat_ws("-", "set_id", "e.d").alias("doc_id"), F.col("e.o").alias("doc_ord"), F.when(F.col("e.o") == 0, F.concat(F.lit(" N"), "row_label")).otherwise(F.concat(F.lit("n"), "row_label")).alias("row_label"), F.lit("FY2001").alias("column_label"), F.col("e.x").alias("value"))


CONFLICTS = """c AS (SELECT c_mktsegment AS s, c_nationkey AS n, SUM(c_acctbal::DECIMAL(18,2))::DOUBLE AS v FROM customer GROUP BY 1, 2),
x AS (SELECT s AS set_id, 'n' || n AS row, s || '-a' AS doc_a, v AS value_a, s || '-b' AS doc_b, v * CASE n % 5 WHEN 0 THEN 1.1::DOUBLE WHEN 1 THEN 1.001::DOUBLE ELSE 1.0::DOUBLE END AS value_b FROM c), k AS (SELECT * FROM x WHERE abs(value_a - value_b) / greatest(abs(value_b), 1e-9) > 0.005)"""


@query("conflict_join", f"WITH {CONFLICTS} SELECT * FROM k")
def conflict_join(spark: SparkSession, sf: str) -> DataFrame:
    return compare.conflicts(cells(spark, sf), 0.005).select("set_id", "row", "doc_a", "value_a", "doc_b", "value_b")


@query("disclosure_classify", f"""WITH {CONFLICTS} SELECT doc_a, doc_b, row, CASE length(set_id) % 3 WHEN 0 THEN 'EXPLICIT_RESTATEMENT' WHEN 1 THEN 'POSSIBLE_RECLASSIFICATION' ELSE 'UNEXPLAINED' END AS restatement_type, CASE length(set_id) % 3 WHEN 0 THEN 'As Restated' WHEN 1 THEN 'Reclassified' END AS matched FROM k""")
def disclosure_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The second documents' texts hold their figures; language of restatement stands near them, or too far away to count."""
    found = compare.conflicts(cells(spark, sf), 0.005)
    n = F.length("set_id") % 3
    said = F.when(n == 0, " shown As Restated, partly reclassified, ").when(n == 1, " Reclassified to conform, ").otherwise(F.concat(F.lit(" plain "), F.repeat(F.lit("x "), 150), F.lit("as restated")))
    number = F.regexp_replace(F.col("value_b").try_cast("decimal(38, 12)").cast("string"), r"\.?0+$", "")
    line = F.concat(F.lit("figure "), number, said, F.repeat(F.lit("- "), 300))
    texts = found.groupBy(F.col("doc_b").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return compare.annotated(found, texts).select("doc_a", "doc_b", "row", "restatement_type", "matched")


@query("link_derived", f"""WITH {A.REVENUE}, y AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY fy) AS old FROM rev), d AS (SELECT k, fy, v + old AS s FROM y WHERE old IS NOT NULL)
SELECT entity AS doc_id, 'r' || d.fy AS src, 's' || d.fy AS dst FROM d JOIN (SELECT DISTINCT k, entity FROM rev) USING (k) WHERE k % 4 <> 0 AND fy % 3 <> 0""")
def link_derived(spark: SparkSession, sf: str) -> DataFrame:
    y = A.revenue(spark, sf).withColumn("old", F.lag("v").over(Window.partitionBy("k").orderBy("fy"))).filter("old is not null").withColumn("s", F.col("v") + F.col("old"))
    year = F.col("fy").cast("string")
    sums = y.select(F.col("entity").alias("doc_id"), F.concat(F.lit("s"), year).alias("claim_id"), F.lit("sum").alias("operation"), F.col("s").alias("stated_value"), F.array("old", "v").alias("operands"))
    ratios = y.select(F.col("entity").alias("doc_id"), F.concat(F.lit("r"), year).alias("claim_id"), F.lit("ratio").alias("operation"), F.lit(1.0).alias("stated_value"), F.array("s").alias("operands"))
    known = A.revenue(spark, sf).select(F.col("entity").alias("doc_id"), F.col("v").alias("value")).unionByName(y.filter("k % 4 = 0 or fy % 3 = 0").select(F.col("entity").alias("doc_id"), F.col("s").alias("value")))
    return compare.derived_links(sums.unionByName(ratios), known)


@query("adjudicate", f"""WITH {A.CLAIMS}, t AS (SELECT doc_id, CASE WHEN key % 2 = 0 THEN 'eps_reconciliation' ELSE 'cash_flow_tie_out' END AS rule_name, arg_min(CASE WHEN key % 3 = 0 THEN 'WRONG_MATH' ELSE 'VERIFIED' END, claim_id) AS t FROM verdicts WHERE key % 7 <> 0 GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN key % 2 = 0 THEN 'eps_reconciliation' ELSE 'cash_flow_tie_out' END AS rule_name FROM verdicts)
SELECT doc_id, claim_id, CASE WHEN status = 'WRONG_MATH' AND coalesce(t, 'VERIFIED') = 'VERIFIED' THEN 'INSUFFICIENT_EVIDENCE' ELSE status END AS status, t AS tagged_status FROM p LEFT JOIN t USING (doc_id, rule_name)""")
def adjudicate(spark: SparkSession, sf: str) -> DataFrame:
    v = C.verify(A.claims(spark, sf)).withColumns({"rule_name": F.when(F.col("key") % 2 == 0, "eps_reconciliation").otherwise("cash_flow_tie_out"), "eps_variant": F.lit(None).cast("string")})
    tagged = v.filter("key % 7 <> 0").withColumn("status", F.when(F.col("key") % 3 == 0, K.WRONG).otherwise(K.VERIFIED))
    return C.adjudicated(v, tagged).select("doc_id", "claim_id", "status", "tagged_status")


def peers(spark: SparkSession, sf: str) -> DataFrame:
    """Margins of suppliers at the latest month that both series have; the supplier's nation is the group."""
    li = A.table(spark, sf, "lineitem")
    day = F.last_day("l_shipdate").alias("end")
    sold = li.groupBy(F.col("l_suppkey").alias("entity"), day).agg(A.exact("l_extendedprice").alias("val"))
    kept = li.filter("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("entity"), day).agg(A.exact("l_extendedprice").alias("val"))
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("group"))
    return compare.latest_ratio(kept, sold).join(s, "entity")


PEERS = """s AS (SELECT l_suppkey AS entity, last_day(l_shipdate)::DATE AS e, SUM(l_extendedprice::DECIMAL(18,2))::DOUBLE AS d, (SUM(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag <> 'R'))::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT entity, max(e) AS e, arg_max(n / d * 100, e) AS value FROM s WHERE n IS NOT NULL GROUP BY 1), p AS (SELECT m.*, s_nationkey AS g FROM m JOIN supplier ON s_suppkey = entity),
q AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY g) - e > 200 THEN 'stale' WHEN value NOT BETWEEN 20 AND 100 THEN 'out_of_band' END AS reason FROM p),
z AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY g) AS n, avg(value) FILTER (reason IS NULL) OVER (PARTITION BY g) AS mean, stddev_pop(value) FILTER (reason IS NULL) OVER (PARTITION BY g) AS sd FROM q)"""


@query("peer_outliers", f"WITH {PEERS}, x AS (SELECT *, CASE WHEN reason IS NULL AND n >= 3 AND sd > 1e-9 THEN (value - mean) / sd END AS zs FROM z) SELECT entity, g AS \"group\", reason AS exclude_reason, CASE WHEN n >= 3 THEN 'compared' ELSE 'declined' END AS state, round(zs, 5) AS zscore, coalesce(abs(zs) > 2, FALSE) AS outlier_strict, coalesce(abs(round_even(zs, 2)) >= 2, FALSE) AS outlier FROM x")
def peer_outliers(spark: SparkSession, sf: str) -> DataFrame:
    g = compare.gated(peers(spark, sf), 20, 100)
    return g.select("entity", "group", "exclude_reason", "state", F.round(F.when(F.col("sd") > 1e-9, F.col("zscore")), 5).alias("zscore"), F.when(F.col("sd") > 1e-9, F.col("outlier_strict")).otherwise(False).alias("outlier_strict"), F.when(F.col("sd") > 1e-9, F.col("outlier")).otherwise(False).alias("outlier"))


@query("peer_superlative", f"WITH {PEERS} SELECT g AS \"group\", arg_min(entity, (-value, entity)) AS winner, max(value) AS best, arg_min(entity, (value, entity)) AS loser, min(value) AS worst FROM z WHERE reason IS NULL AND n >= 3 GROUP BY 1")
def peer_superlative(spark: SparkSession, sf: str) -> DataFrame:
    return compare.extremes(compare.gated(peers(spark, sf), 20, 100))


# Filings.


def filings(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    form = F.when(F.col("event_type") == "purchase", "10-K").when(F.col("event_type") == "click", "8-K").when(F.col("event_type") == "view", "4").when(F.col("event_type") == "signup", "10-K/A").otherwise("10-Q")
    items = F.when(F.col("event_id") % 3 == 0, "1.01, 2.02 ,9.01").when(F.col("event_id") % 3 == 1, "12.02")
    return e.select(F.col("user_id").alias("entity"), form.alias("form"), F.col("ts").cast("date").alias("filing_date"), F.format_string("%012d", "event_id").alias("accession"), items.alias("items"), "event_id", "value").withColumn("coverage", dashboards.coverage(F.col("form"), F.col("items")))


FILINGS = """f AS (SELECT user_id AS entity, event_id, value, ts::DATE AS filing_date, lpad(event_id::VARCHAR, 12, '0') AS accession, CASE event_type WHEN 'purchase' THEN '10-K' WHEN 'click' THEN '8-K' WHEN 'view' THEN '4' WHEN 'signup' THEN '10-K/A' ELSE '10-Q' END AS form FROM events),
g AS (SELECT *, CASE WHEN form IN ('10-K', '10-Q') THEN 'full_financial_verification' WHEN form = '8-K' AND event_id % 3 = 0 THEN 'partial_financial_verification' WHEN form = '4' THEN 'ownership_data_only' ELSE 'listed_only' END AS coverage FROM f)"""


@query("coverage_counts", f"WITH {FILINGS}, l(coverage) AS (VALUES ('full_financial_verification'), ('partial_financial_verification'), ('ownership_data_only'), ('listed_only')) SELECT coverage, count(entity)::BIGINT AS n FROM l LEFT JOIN g USING (coverage) GROUP BY 1")
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.coverage_counts(filings(spark, sf))


@query("timeline", f"WITH {FILINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY filing_date DESC, accession DESC) AS rank FROM g) SELECT entity, rank::BIGINT AS rank, form, accession, coverage FROM r WHERE rank <= 3")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.timeline(filings(spark, sf), 3, "entity").select("entity", "rank", "form", "accession", "coverage")


@query("insider_crosscheck", """WITH t AS (SELECT l_suppkey AS entity, CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'P' ELSE 'G' END AS code, l_quantity AS q FROM lineitem)
SELECT entity, coalesce(sum(q) FILTER (code = 'P'), 0) AS acquired, coalesce(sum(q) FILTER (code = 'S'), 0) AS disposed, count(*)::BIGINT AS n FROM t GROUP BY 1""")
def insider_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "P").otherwise("G")
    return dashboards.insider_shares(A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), code.alias("code"), F.col("l_quantity").alias("shares")), "entity")


@query("usage_report", "SELECT c_custkey AS user_id, count(event_id)::BIGINT AS calls, max(ts) AS last_call FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def usage_report(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.usage(A.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), A.table(spark, sf, "events"), "user_id")


@query("due_deliveries", """SELECT event_id AS delivery_id, (event_id % 7)::BIGINT AS attempts, CASE WHEN event_id % 7 + 1 >= 5 THEN 'failed' ELSE 'retry' END AS if_failed, least(3600, pow(2, event_id % 7 + 1))::BIGINT AS delay_s
FROM events JOIN customer ON c_custkey = user_id WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-15' AND c_acctbal > 0 ORDER BY event_id LIMIT 25""")
def due_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "events").select(F.col("event_id").alias("delivery_id"), F.col("user_id").alias("hook_id"), F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "retry").otherwise("success").alias("status"), F.col("ts").alias("next_attempt"), (F.col("event_id") % 7).alias("attempts"))
    h = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("hook_id"), F.col("c_name").alias("url"), (F.col("c_acctbal") > 0).alias("active"))
    return dashboards.due_deliveries(d, h, F.lit("2024-01-15").cast("timestamp")).select("delivery_id", "attempts", "if_failed", "delay_s")


@query("fetch_metrics", """WITH l AS (SELECT event_type AS outcome, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT outcome, count(*)::BIGINT AS calls, count(*) FILTER (value > 10)::BIGINT AS ok, count(*) FILTER (NOT value > 10)::BIGINT AS failures, round_even(count(*) FILTER (value > 10) / count(*)::DOUBLE, 4) AS success_rate, round(avg(value), 6) AS mean, max(value) FILTER (r = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (r = round_even(0.95 * (n - 1), 0)) AS p95, max(value) AS longest FROM l GROUP BY 1""")
def fetch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    log = A.table(spark, sf, "events").select(F.col("event_type").alias("outcome"), F.col("value").alias("latency"), (F.col("value") > 10).alias("ok"))
    return dashboards.fetch_metrics(log, "outcome").drop("retries").withColumn("mean", F.round("mean", 6))


@query("fetch_summary", """WITH l AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
o AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS outcomes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, count(*)::BIGINT AS calls, count(*) FILTER (value > 10)::BIGINT AS ok, sum(event_id % 3)::BIGINT AS retries, round_even(max(value) FILTER (r = round_even(0.5 * (n - 1), 0)), 4) AS p50, round_even(max(value) FILTER (r = round_even(0.95 * (n - 1), 0)), 4) AS p95, round_even(max(value), 4) AS longest,
 round_even(sum(value::DECIMAL(38, 12))::DOUBLE, 4) AS total, any_value(outcomes) AS outcomes FROM l JOIN o USING (user_id) GROUP BY 1""")
def fetch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a user's calls came to: latencies with their total, retries, and a map of outcomes."""
    log = A.table(spark, sf, "events").select("user_id", F.col("event_type").alias("outcome"), F.col("value").alias("latency"), (F.col("value") > 10).alias("ok"), (F.col("event_id") % 3).alias("retries"))
    m = dashboards.fetch_summary(log, "user_id").withColumn("outcomes", F.array_join(F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))
    return m.select("user_id", "calls", "ok", "retries", "p50", "p95", "longest", "total", "outcomes")


# Text.


@query("html_strip", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#160;', ' '), '&mdash;', '—'), '&ndash;', '–') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '&#x?[0-9a-fA-F]+;', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x{A0}]+', ' ', 'g'), '\s*\n\s*', E'\n', 'g'), '\n{3,}', E'\n\n', 'g') AS t FROM c) SELECT page_id, length(trim(t))::BIGINT AS n_chars, sha256(trim(t)) AS digest FROM d""")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query("numeric_density", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]{2,}(?:\.[0-9]+)?'))::BIGINT AS density FROM documents")
def numeric_density(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", T.numeric_density(F.col("text")).alias("density"))


CONSTANT_WORDS = ", ".join(f"('{w}')" for w in sorted(K.CONSTANCY))


@query("definitional_flag", f"""WITH w(w) AS (VALUES {CONSTANT_WORDS}), l AS (SELECT list(w ORDER BY length(w) DESC, w) AS words FROM w),
t AS (SELECT p_partkey, lower('Costs in ' || p_name || CASE WHEN p_partkey % 3 > 0 THEN ' were ' || words[(p_partkey % len(words) + 1)::INT] ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN '_' WHEN 2 THEN ', or ' || upper(words[(p_partkey // 7 % len(words) + 1)::INT]) ELSE 's' END) AS t, words FROM part, l)
SELECT p_partkey, list_filter(words, lambda w: regexp_matches(t, '(^|[^a-z0-9_])' || w || '([^a-z0-9_]|$)'))[1] AS word FROM t""")
def definitional_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with each of the words of constancy, alone, with another one, inside a longer word, or with none."""
    k, words = F.col("p_partkey"), sorted(K.CONSTANCY, key=lambda w: (-len(w), w))
    word = lambda at: F.get(F.array(*map(F.lit, words)), (at % len(words)).cast("int"))
    end = F.when(k % 4 == 0, F.lit(".")).when(k % 4 == 1, F.lit("_")).when(k % 4 == 2, F.concat(F.lit(", or "), F.upper(word(F.floor(k / 7))))).otherwise("s")
    t = F.concat(F.lit("Costs in "), "p_name", F.when(k % 3 > 0, F.concat(F.lit(" were "), word(k))).otherwise(""), end)
    return A.table(spark, sf, "part").select("p_partkey", K.definitional_word(t).alias("word"))


@query("money_normalize", """WITH m AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1.0 WHEN 2 THEN 1e-3 WHEN 3 THEN 1.0 END AS f FROM part) SELECT p_partkey, p_size * 1000.0::DOUBLE * f AS millions, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1e-3 ELSE p_size::DOUBLE END AS rescaled FROM m""")
def money_normalize(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("$"), s, F.lit(",000B"))).when(k == 1, F.concat(s, F.lit("000 million"))).when(k == 2, F.concat(F.lit(" $ "), s, F.lit("000.0k"))).when(k == 3, F.concat(s, F.lit("000"))).otherwise(F.concat(F.lit("about "), s))
    foot = T.scale_footnote(F.when(F.col("p_partkey") % 2 == 0, "(Amounts IN Thousands, except shares)").otherwise("unaudited"))
    return A.table(spark, sf, "part").select("p_partkey", T.millions(raw).alias("millions"), T.rescale(F.col("p_size").cast("double"), foot).alias("rescaled"))


@query("table_cells", f"""WITH {A.REVENUE} SELECT entity AS doc_id, 'FY' || fy AS row_label, c AS column_label, CASE c WHEN 'Orders' THEN n::DOUBLE ELSE -n::DOUBLE END AS value, 'in thousands' AS unit_footnote FROM rev, (VALUES ('Orders'), ('Returns')) x(c)""")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("| FY"), F.col("fy").cast("string"), F.lit(" | $"), F.format_number("n", 0), F.lit(" | ("), F.format_number("n", 0), F.lit(") | n/a |"))
    g = A.revenue(spark, sf).groupBy(F.col("entity").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("Table 1 (in thousands)\n| Year | Orders | Returns | Note |\n|---|:--|---:|---|\n"), "body")
    return tables.cells(g.select("doc_id", text.alias("text"))).select("doc_id", "row_label", "column_label", "value", "unit_footnote")


@query("claims_json", f"""WITH {A.REVENUE}, k AS (SELECT *, (k * 7 + fy) % 9 AS c, rank() OVER (PARTITION BY k ORDER BY fy)::BIGINT - 1 AS ord FROM rev)
SELECT entity AS doc_id, ord, c NOT IN (0, 2, 4, 8) AS ok, CASE c WHEN 0 THEN 'unknown operation' WHEN 2 THEN 'stated value is no number' WHEN 4 THEN 'unknown source' WHEN 8 THEN 'span has no two places' END AS reason,
CASE c WHEN 1 THEN 'percent_change' WHEN 3 THEN 'margin_percent' WHEN 5 THEN 'margin_percent' WHEN 6 THEN 'identity' WHEN 7 THEN 'ratio' END AS operation, CASE WHEN c NOT IN (0, 2, 4, 8) THEN n::DOUBLE END AS stated_value, CASE c WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 2 END AS n_operands, CASE c WHEN 7 THEN 'repaired: params was null, treated as empty' END AS note FROM k""")
def claims_from_json(spark: SparkSession, sf: str) -> DataFrame:
    c = (F.col("k") * 7 + F.col("fy")) % 9
    op = F.when(c == 0, "guess").when(c == 1, "Growth-Rate").when(c == 3, "gross margin").when(c.isin(5, 6), "identity").when(c == 7, "Divide").otherwise("sum")
    stated = F.when(c == 2, "1e999").otherwise(F.concat(F.lit("$ "), F.format_number("n", 0)))
    text = F.when(c == 5, 'net margin [x] "quoted" of ').when(c == 6, "EPS of ").otherwise("orders [in] {braces} of ")
    source = F.when(c == 4, "hearsay").when(c == 3, "Table Cell").otherwise("prose")
    operands = F.to_json(F.array(*[F.struct(F.col("n").alias("value"), source.alias("source"), F.when(c == 8, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(4))).alias("source_span")) for _ in range(2)]))
    fields = F.to_json(F.struct(F.concat(text, F.col("fy").cast("string")).alias("claim_text"), op.alias("operation"), stated.alias("stated_value")))
    item = F.concat(F.lit('{"params": '), F.when(c == 7, "null").otherwise('{"mode": "sum"}'), F.lit(', "operands": '), operands, F.lit(", "), F.substring(fields, 2, 10**6))
    g = A.revenue(spark, sf).groupBy("k", F.col("entity").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fy", item.alias("j")))), lambda x: x["j"]), ",").alias("b"))
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n["), "b", F.lit("]\n```"))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"note": "see [1]", "claims": ['), "b", F.lit("]}"))).otherwise(F.concat(F.lit("So: ["), "b", F.lit("] and [more] of it")))
    p = claims_json.parsed(g.select("doc_id", raw.alias("raw")))
    return p.select("doc_id", "ord", "ok", "reason", F.when(F.col("ok"), F.col("operation")).alias("operation"), F.when(F.col("ok"), F.col("stated_value")).alias("stated_value"), F.when(F.col("ok"), F.size("operands")).alias("n_operands"), F.when(F.col("ok"), F.col("note")).alias("note"))


@query("document_split", f"""WITH {A.REVENUE}, m AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy)::BIGINT AS part FROM rev)
SELECT entity AS doc_id, part - 1 AS part, CASE part % 3 WHEN 0 THEN 'DOC_D' || part ELSE 'D' || part || '_FY' || fy END AS id, CASE WHEN part % 3 > 0 THEN 'FY' || fy END AS period, CASE part % 3 WHEN 1 THEN '10-K' END AS doc_type, md5(CASE part % 3 WHEN 0 THEN 'Exhibit d' || part || ': other' WHEN 1 THEN 'Source Document d' || part || ' — FY ' || fy || ' 10-K' ELSE '=== DOCUMENT d' || part || ' ===' END || chr(10) || 'orders ' || n || CASE part % 3 WHEN 2 THEN chr(10) || 'of fiscal year ' || fy ELSE '' END) AS digest FROM m""")
def document_split(spark: SparkSession, sf: str) -> DataFrame:
    part = F.row_number().over(Window.partitionBy("entity").orderBy("fy"))
    m = A.revenue(spark, sf).withColumn("part", part).withColumn("p", F.col("part").cast("string")).withColumn("y", F.col("fy").cast("string"))
    head = F.when(F.col("part") % 3 == 0, F.concat(F.lit("Exhibit d"), "p", F.lit(": other"))).when(F.col("part") % 3 == 1, F.concat(F.lit("Source Document d"), "p", F.lit(" — FY "), "y", F.lit(" 10-K"))).otherwise(F.concat(F.lit("=== DOCUMENT d"), "p", F.lit(" ===")))
    body = F.concat(head, F.lit("\norders "), F.col("n").cast("string"), F.when(F.col("part") % 3 == 2, F.concat(F.lit("\nof fiscal year "), "y")).otherwise(""), F.lit("\n \n"))
    g = m.groupBy(F.col("entity").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", body.alias("b")))), lambda x: x["b"]), "").alias("text"))
    return tables.documents(g).select("doc_id", "part", "id", "period", "doc_type", F.md5("body").alias("digest"))


@query("answer_numbers", """WITH n AS (SELECT o_orderkey, o_orderkey % 6 AS c FROM orders) SELECT o_orderkey, c <> 4 AS fact_ok, c <> 4 AS negated_ok, FALSE AS rounded_ok, c <> 4 AND c <> 1 AS minus_ok FROM n""")
def answer_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as answers state them: the fact, in one parenthesis and in two, cut, within and beyond the tolerance, a counter; the fact may be negative."""
    p, c = F.col("o_totalprice"), F.col("o_orderkey") % 6
    said = F.when(c.isin(0, 1), F.format_number(p, 2)).when(c == 2, F.format_number(F.floor(p) + 0.4, 1)).when(c == 3, F.format_number(p * 1.004, 2)).when(c == 4, F.format_number(p * 1.02 + 3, 2)).otherwise("11")
    numbers = T.numbers(F.concat(F.lit("It was $"), said, F.lit(" [F12] (of 7 million, up 3%).")))
    minus = T.numbers(F.concat(F.when(c == 1, "(").otherwise(""), said, F.when(c == 1, ")").otherwise(" [F1]")))
    ok = lambda ns, facts: F.forall(ns, lambda x: T.allowed(x, facts))
    return A.table(spark, sf, "orders").select("o_orderkey", ok(numbers, F.array(p)).alias("fact_ok"), ok(numbers, F.array(-p)).alias("negated_ok"), T.allowed(F.lit(2.8), F.array(F.lit(2.4))).alias("rounded_ok"), ok(minus, F.array(p)).alias("minus_ok"))


@query("fact_ledger", f"""WITH {A.CLAIMS}, f AS (SELECT *, status = 'VERIFIED' AS ok FROM verdicts) SELECT doc_id, claim_id, CASE WHEN ok THEN 'F' || row_number() OVER (PARTITION BY doc_id, ok ORDER BY claim_id) END AS fact_id, CASE WHEN ok THEN 'year ' || claim_id || ', (1,234.5)% of 7' ELSE 'year [number withheld] [number withheld] of [number withheld]' END AS shown, CASE WHEN ok THEN len(vals) + 2 ELSE 0 END AS n_values FROM f""")
def fact_ledger(spark: SparkSession, sf: str) -> DataFrame:
    v = C.verify(A.claims(spark, sf)).select("doc_id", "claim_id", F.col("claim_id").alias("ord"), F.concat(F.lit("year "), F.col("claim_id").cast("string"), F.lit(", (1,234.5)% of 7")).alias("claim_text"), "status", "stated_value", "recomputed", "operands")
    return dashboards.ledger(v).select("doc_id", "claim_id", "fact_id", "shown", F.size("values").alias("n_values"))


from . import audits, reports  # noqa: E402, F401 - they add their queries
