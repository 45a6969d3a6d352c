"""Claims to verdicts, verdicts to scores and reports.

claims: doc_id, claim_id, operation, operands array<struct<value, source, category>>, stated_value, and for rules rule_name,
eps_variant, context, evidence columns. Verification is one projection without a shuffle; scores are one aggregation.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from proofgrid.functions import kernels as K

#: Weights of checkable verdicts; others do not count.
WEIGHTS = {K.VERIFIED: 1.0, K.WRONG: 0.0, K.UNSUPPORTED: 0.4, K.AMBIGUOUS: 0.4, K.CONFLICT: 0.0}
FAILING = (K.WRONG, K.UNSUPPORTED)


#: Evidence that each gated rule needs.
FLAGS = {"balance_sheet_identity": ["liabilities_complete"], "eps_reconciliation": ["eps_income_basis", "income_operand_basis"], "cash_flow_tie_out": ["restricted_cash_disclosed"]}
#: Verdicts that do not count as checkable, and which side owns a bucket.
UNCHECKABLE = (K.UNCHECKED, K.REVIEW, K.PROPAGATED, K.INSUFFICIENT)
OWNERS = {"extraction_failure:missing_evidence_flags": "extraction", "extraction_failure:missing_operand": "extraction", "verifier_gate_fired:by_design": "verifier(by_design)", "verifier_safety_net:restricted_cash_label_caught": "verifier(safety_net)", "verifier_structural:variant_or_count_or_div0": "verifier(structural)", "verifier_definitional:human_routed": "verifier(by_design)", "auto:true_positive_candidate": "—(verified)", "auto:NEEDS_REVIEW_HIGH(conviction)": "—(needs_human)"}


def context(claims: DataFrame) -> Column:
    """All grounded text of a claim in one: claim, source, notes and operands', joined by spaces."""
    has = set(claims.columns)
    texts = F.transform("operands", lambda o: o["source_text"]) if "source_text" in claims.schema["operands"].dataType.elementType.names else F.array().cast("array<string>")
    return F.concat_ws(" ", *[F.col(c) for c in ("claim_text", "source_text", "notes") if c in has], F.filter(texts, lambda t: t != ""))


def with_evidence(claims: DataFrame) -> DataFrame:
    """claims (with params, a map of strings) with context and the evidence columns that verify reads; what params doesn't hold is null."""
    of = lambda k, t: F.try_element_at("params", F.lit(k)).try_cast(t).alias(k)
    kinds = {"liabilities_complete": "boolean", "redeemable_equity_present": "boolean", "eps_income_basis": "string", "income_operand_basis": "string", "preferred_dividends_present": "boolean", "restricted_cash_disclosed": "boolean", "target_period": "string", "mode": "string", "actual_percent_change": "double", "flat_band_pct": "double"}
    pairs = F.from_json(F.try_element_at("params", F.lit("series")), "array<array<string>>")
    return claims.select("*", context(claims).alias("context"), *[of(k, t) for k, t in kinds.items()], F.transform(pairs, lambda p: p[1].try_cast("double")).alias("series"), F.transform(pairs, lambda p: p[0]).alias("periods"))


def emission(claims: DataFrame) -> DataFrame:
    """claims with evidence_emitted (all flags that the rule needs are in params, with any value) and evidence_gate_satisfied (with values that let
    the rule run); the basis of income may stand on the second operand instead. Claims without a gated rule have both."""
    there, value = (lambda k: F.map_contains_key("params", F.lit(k))), (lambda k: F.try_element_at("params", F.lit(k)))
    tagged = F.coalesce(F.length(F.get("operands", F.lit(1))["category"]) > 0, F.lit(False))
    rule = F.coalesce("rule_name", F.lit(""))
    emitted = F.when(rule == "eps_reconciliation", there("eps_income_basis") & (there("income_operand_basis") | tagged))
    ok = F.when(rule == "eps_reconciliation", value("eps_income_basis").isNotNull() & (value("income_operand_basis").isNotNull() | tagged)).when(rule == "balance_sheet_identity", F.coalesce(value("liabilities_complete") == "true", F.lit(False))).when(rule == "cash_flow_tie_out", value("restricted_cash_disclosed").isNotNull())
    for name, flags in FLAGS.items():
        if len(flags) == 1:
            emitted = emitted.when(rule == name, there(flags[0]))
    return claims.withColumns({"evidence_emitted": emitted.otherwise(True), "evidence_gate_satisfied": ok.otherwise(True)})


def verify(claims: DataFrame, pct: float = K.PCT_TOL, rel: float = K.REL_TOL) -> DataFrame:
    """claims with status, recomputed and delta. Columns that are absent count as null."""
    has = dict(claims.dtypes)
    col = lambda n, t="string": F.col(n) if n in has else F.lit(None).cast(t)
    values, sources = F.transform("operands", lambda o: o["value"]), F.transform("operands", lambda o: o["source"])
    category = lambda i: F.get(F.transform("operands", lambda o: o["category"]), F.lit(i))
    op, stated, context, rule = F.col("operation"), F.col("stated_value"), F.coalesce(col("context"), F.lit("")), col("rule_name")
    redeemable = F.coalesce(col("redeemable_equity_present", "boolean"), F.lit(False)) | context.rlike(K.REDEEMABLE)
    common = F.coalesce(col("preferred_dividends_present", "boolean"), F.lit(False)) | context.rlike(K.TO_COMMON)
    variant = F.coalesce(K.variant_consistent(col("eps_variant"), category(2)), F.lit(False))
    rules = (
        F.when(rule == "balance_sheet_identity", K.balance_sheet(values, col("liabilities_complete", "boolean"), context.rlike(K.NCI), redeemable))
        .when((rule == "eps_reconciliation") & (F.size(values) == 3) & ~variant, K.verdict(K.AMBIGUOUS))
        .when(rule == "eps_reconciliation", K.eps(values, col("eps_income_basis"), F.coalesce(col("income_operand_basis"), category(1)), common))
        .when(rule == "cash_flow_tie_out", K.cash(values, K.restricted_flag(col("restricted_cash_disclosed", "boolean"), context, context)))
        .otherwise(K.verdict(K.AMBIGUOUS))
    )
    series = F.coalesce(F.when(F.size(col("series", "array<double>")) > 0, col("series", "array<double>")), values)
    periods = F.coalesce(col("periods", "array<string>"), F.transform(series, lambda x, i: i.cast("string")))
    result = (
        F.when(op == "unsupported", K.verdict(K.UNCHECKED))
        .when(F.exists(sources, lambda s: s == "missing"), K.verdict(K.UNSUPPORTED))
        .when(op == "internal_consistency", rules)
        .when(op == "trend_direction", K.trend(series, col("trend_dir")))
        .when(op == "superlative", K.superlative(periods, series, col("superlative"), col("target_period")))
        .when(op == "consecutive_count", K.consecutive(series, col("trend_dir"), stated))
        .when(op == "aggregate_filter", K.aggregate_filter(values, stated, F.coalesce(col("mode"), F.lit("sum"))))
        .when(op == "mda_xbrl_consistency", K.mda(col("trend_dir"), F.coalesce(col("actual_percent_change", "double"), stated), F.coalesce(col("flat_band_pct", "double"), F.lit(K.MDA_BAND))))
        .when(op == "definitional_flag", K.definitional(col("claim_text")))
        .otherwise(K.verify_scalar(op, values, sources, stated, pct, rel))
    )
    # inline, not three fields of a struct: a collapsed projection would evaluate the ladder once for each field
    return claims.select(*[F.col(f"`{c}`") for c in claims.columns if c not in ("status", "recomputed", "delta")], F.inline(F.array(result)))


def weight(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), status)


@F.pandas_udf(DoubleType())
def logarithm(x: pd.Series) -> pd.Series:
    """As the C library and so the original has it. Spark's log and log1p are Java's, which differ in the last bit, at 3 already; that decides scores which lie between two places."""
    return x.map(math.log)


def score(verdicts: DataFrame, keys: list[str], downstream: str | None = None, also: dict[str, Column] | None = None, order: str | None = None) -> DataFrame:
    """One row a document: the aggregates of also by name, counts, total_checkable, flat and weighted score in percent to one place. With nothing to check the score is not available, 0 and not 100.
    order: add the weights up as doubles one after the other by this column, as a loop over the claims does; this too gives the same score in each run, and that of the loop where it lies between two places."""
    w = weight(F.col("status"))
    tenths = F.round(w * 10).cast("long")  # whole numbers add up to the same in any order, so a score that lies between two places goes to the even one
    if downstream:
        verdicts = verdicts.withColumn("__reach", 1 + logarithm(1 + F.coalesce(F.col(downstream), F.lit(0)).cast("double")))
    reach = F.col("__reach") if downstream else F.lit(1.0)
    use = F.when(w.isNotNull(), reach)
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in (*WEIGHTS, K.UNCHECKED, K.REVIEW, K.INSUFFICIENT, K.PROPAGATED)]
    percent = lambda points, of: F.try_divide(F.sum(points) * 10.0, of)
    flat, weighted, place = percent(tenths, F.count(w)), percent(tenths * use, F.sum(use)), lambda x: F.bround(x, 1)
    if order:
        up = Window.partitionBy(*keys).orderBy(order)
        so_far = lambda x: F.sum(x).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        verdicts = verdicts.withColumns({"__n": F.row_number().over(up), "__w": so_far(w), "__wt": so_far(w * use), "__t": so_far(use)})
        last = lambda x: F.max_by(x, "__n")
        flat, weighted, place = F.try_divide(last("__w"), F.count(w)) * 100, F.try_divide(last("__wt"), last("__t")) * 100, lambda x: F.rint(x * 10) / 10
    out = verdicts.groupBy(*keys).agg(*counts, F.count(w).alias("total_checkable"), flat.alias("__flat"), weighted.alias("__weighted"), *[c.alias(name) for name, c in (also or {}).items()])
    return out.select(*keys, *(also or {}), *[f"n_{s.lower()}" for s in (*WEIGHTS, K.UNCHECKED, K.REVIEW, K.INSUFFICIENT, K.PROPAGATED)], "total_checkable", (F.col("total_checkable") > 0).alias("score_available"), place(F.coalesce("__flat", F.lit(0.0))).alias("unweighted_score"), place(F.coalesce("__weighted", F.lit(0.0))).alias("score"))


def adjudicated(prose: DataFrame, tagged: DataFrame) -> DataFrame:
    """Prose convictions against tagged claims of the same filer, rule and variant (the first by claim_id): without one, or with one that is
    verified or declined, the conviction becomes a decline; otherwise it stands."""
    first = tagged.groupBy("doc_id", "rule_name", F.coalesce("eps_variant", F.lit("")).alias("__variant")).agg(F.min_by("status", "claim_id").alias("tagged_status"))
    joined = prose.withColumn("__variant", F.coalesce("eps_variant", F.lit(""))).join(first, ["doc_id", "rule_name", "__variant"], "left")
    asked = (F.col("status") == K.WRONG) & F.col("rule_name").isNotNull()
    upheld = F.col("tagged_status").isNotNull() & ~F.col("tagged_status").isin(K.VERIFIED, K.INSUFFICIENT)
    return joined.withColumns({"adjudicated": asked, "status": F.when(asked & ~upheld, K.INSUFFICIENT).otherwise(F.col("status"))}).drop("__variant")


def bucket(status: Column, emitted: Column, rule: Column, label_caught: Column) -> Column:
    """Where a failure belongs; the part before the colon owns it."""
    return (
        F.when(status == K.VERIFIED, "auto:true_positive_candidate")
        .when(status == K.WRONG, "auto:NEEDS_REVIEW_HIGH(conviction)")
        .when((status == K.INSUFFICIENT) & ~emitted & (rule == "cash_flow_tie_out") & label_caught, "verifier_safety_net:restricted_cash_label_caught")
        .when((status == K.INSUFFICIENT) & ~emitted, "extraction_failure:missing_evidence_flags")
        .when(status == K.INSUFFICIENT, "verifier_gate_fired:by_design")
        .when(status == K.AMBIGUOUS, "verifier_structural:variant_or_count_or_div0")
        .when(status == K.UNSUPPORTED, "extraction_failure:missing_operand")
        .when(status == K.REVIEW, "verifier_definitional:human_routed")
        .otherwise(F.concat(F.lit("other:"), status))
    )


def owner(bucket: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OWNERS.items() for x in kv]), bucket), F.lit("other"))


def breakdown(verdicts: DataFrame, *dimensions: str, blank: str = "(none)") -> DataFrame:
    """Counts by each dimension and verdict in one pass over grouping sets: (dimension, value, status, n). A dimension that is an array counts
    for each of its values."""
    kinds = dict(verdicts.dtypes)
    one = lambda d: F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit("(unlabeled)" if d == "sector" else blank)).alias("value"))

    def many(d: str) -> Column:
        return F.transform(d, lambda x: F.struct(F.lit(d).alias("dimension"), x.cast("string").alias("value")))

    parts = [many(d) if kinds[d].startswith("array") else F.array(one(d)) for d in dimensions]
    return verdicts.select(F.inline(F.concat(*parts)), "status").groupBy("dimension", "value", "status").agg(F.count("*").alias("n"))


def summaries(counts: DataFrame) -> DataFrame:
    """(dimension, value, n, verified, insufficient_evidence, extraction_miss, wrong_math, ambiguous and three percentages) of breakdown's counts."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    names = {"verified": K.VERIFIED, "insufficient_evidence": K.INSUFFICIENT, "extraction_miss": K.UNSUPPORTED, "wrong_math": K.WRONG, "ambiguous": K.AMBIGUOUS}
    g = counts.groupBy("dimension", "value").agg(F.sum("n").alias("total"), *[of(s).alias(n) for n, s in names.items()])
    return g.select("dimension", "value", F.col("total").alias("n"), *names, *[percent(F.col(n), F.col("total")).alias(f"pct_{n}") for n in ("verified", "insufficient_evidence", "extraction_miss")])


def percent(part: Column, whole: Column) -> Column:
    """To one place, 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))


def tier(status: Column) -> Column:
    return F.when(status.isin(K.VERIFIED, K.WRONG), "high").when(status == K.INSUFFICIENT, "medium").otherwise("low")


def calibration(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Precision and false positives among decided claims, coverage and declines among all; null, not 0, where nothing is decided; claims of each
    tier of confidence."""
    n, ok = F.count("*"), F.count_if(F.col("status") == K.VERIFIED)
    wrong, no = F.count_if(F.col("status") == K.WRONG), F.count_if(F.col("status") == K.INSUFFICIENT)
    g = verdicts.groupBy(*keys) if keys else verdicts.groupBy()
    tiers = [F.count_if(tier(F.col("status")) == t).alias(f"n_{t}") for t in ("high", "medium", "low")]
    return g.agg(n.alias("n"), ok.alias("n_verified"), wrong.alias("n_wrong"), no.alias("n_declined"), *tiers, F.try_divide(ok * 100.0, ok + wrong).alias("precision_pct"), F.try_divide(wrong * 100.0, ok + wrong).alias("fpr_pct"), F.try_divide((ok + wrong) * 100.0, n).alias("coverage_pct"), F.try_divide(no * 100.0, n).alias("decline_pct"))


def eps_queue(verdicts: DataFrame) -> DataFrame:
    """The convictions to review, with what their operands give: income over shares of three operands, null where shares are 0."""
    v = F.transform("operands", lambda o: o["value"])
    return verdicts.filter(F.col("status") == K.WRONG).withColumn("computed", F.when(F.size(v) == 3, F.try_divide(F.get(v, F.lit(1)), F.get(v, F.lit(2)))))


def pipeline_status(fetched: Column, available: Column, degraded: Column, n_claims: Column, n_checkable: Column) -> Column:
    return F.when(~fetched, "fetch_failed").when(~available, "extraction_unavailable").when(degraded, "silent_degradation").when(n_claims == 0, "extraction_empty").when(n_checkable == 0, "vacuous_no_checkable").otherwise("ok")


def whole(x: Column) -> Column:
    """A whole number with all the digits of its exact value; from 2**125 on those after the 17th are zeros, and so is what Java prints from 2**53 on."""
    low = x % float(2**62)
    high = ((x - low) / float(2**62)).cast("long").cast("decimal(19,0)") * F.lit(Decimal(2**62)).cast("decimal(19,0)")
    size = F.abs(x)
    return F.when(size < float(2**53), F.format_string("%.0f", x)).when(size < float(2**63), x.cast("long").cast("string")).when(size < float(2**125), (high + low.cast("long").cast("decimal(19,0)")).cast("string")).otherwise(F.format_string("%.0f", x))


def six_digits(x: Column) -> Column:
    """A number to six digits, rounded from its exact value: Java rounds what it prints, so a number that it prints as a half needs a look at what is left of it."""
    size = F.abs(x)
    places = F.when(size.between(1e-5, 1e6), F.lit(6) - F.floor(F.log10(size)).cast("int"))
    power = F.get(F.array(*[F.lit(10.0**k) for k in range(12)]), places)
    seven = F.round(size * power)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # half of the bits, so that products with the power are exact
    left = (high * power - seven) + (size - high) * power
    down = (seven % 10 == 5) & (seven / power == size) & ((left < 0) | ((left == 0) & (F.floor(seven / 10) % 2 == 0)))
    near = F.when(F.coalesce(down, F.lit(False)), x * (1 - 1e-12)).otherwise(x)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", near), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def shown(x: Column) -> Column:
    """A number as records show it: whole ones without places, others to six digits; empty for null."""
    return F.when(x.isNull(), "").when(x % 1 == 0, whole(x)).otherwise(six_digits(x))


def citation(o: Column) -> Column:
    """Where an operand comes from: category; text; doc=id [source]."""
    bits = F.concat_ws("; ", F.nullif(o["category"], F.lit("")), F.nullif(o["source_text"], F.lit("")), F.concat(F.lit("doc="), F.nullif(o["doc_id"], F.lit(""))))
    return F.when(bits == "", o["source"]).otherwise(F.concat(bits, F.lit(" ["), o["source"], F.lit("]")))


def audit_rows(verdicts: DataFrame, order: list[str], stamp: Column) -> DataFrame:
    """The fifteen columns of an audit record for each verdict, numbered from 1 within a document."""
    from pyspark.sql import Window

    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long")
    return verdicts.select(
        "doc_id", row.alias("row"), F.coalesce("claim_text", F.lit("")).alias("claim_text"), "operation", text("rule_name"), text("eps_variant"), F.array_join(F.transform("operands", lambda o: shown(o["value"])), " | ").alias("operands"),
        F.array_join(F.transform("operands", citation), "; ").alias("operand_sources"), shown(F.col("stated_value")).alias("stated_value"), F.col("status").alias("verdict"), shown(F.col("recomputed")).alias("recomputed_value"), shown(F.col("delta")).alias("delta"),
        text("caused_by"), text("explanation"), text("source_text"), stamp.alias("run_timestamp"),
    )


def emitted_flags(rule: Column, params: Column) -> Column:
    """JSON of the evidence flags that a rule asks for and whether the claim has them: {} of a rule without any."""
    there = lambda names: F.to_json(F.struct(*[F.coalesce(F.map_contains_key(params, F.lit(k)), F.lit(False)).alias(k) for k in names]))
    out = None
    for name, flags in FLAGS.items():
        out = F.when(rule == name, there(flags)) if out is None else out.when(rule == name, there(flags))
    return out.otherwise("{}")


def review_rows(records: DataFrame) -> DataFrame:
    """One row a claim for reviewers: bucket, owner, evidence flags, the start of the explanation (200 characters, as in the report), and an empty label. records: doc_id,
    rule_name, status, evidence_emitted, label_caught, operands; params and explanation where there are any."""
    b = bucket(F.col("status"), F.col("evidence_emitted"), F.col("rule_name"), F.col("label_caught"))
    flags = emitted_flags(F.col("rule_name"), F.col("params")) if "params" in records.columns else F.lit("{}")
    said = F.substring(F.coalesce("explanation", F.lit("")), 1, 200) if "explanation" in records.columns else F.lit("")
    return records.select("doc_id", "rule_name", F.col("status").alias("verdict"), b.alias("auto_bucket"), owner(b).alias("owner"), F.array_join(F.transform("operands", lambda o: shown(o["value"])), "|").alias("operands"), flags.alias("evidence_flags_emitted"), said.alias("explanation"), F.lit("").alias("human_label"), F.lit("").alias("human_notes"))
