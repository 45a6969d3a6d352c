"""Dashboards, filings' timelines, answers' gates, usage and delivery reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T

from . import claims as C
from .graph import cut

LEVELS = ("full_financial_verification", "partial_financial_verification", "ownership_data_only", "listed_only")
#: Words of a question that concern a topic.
TOPICS = {"balance_sheet_identity": "balance asset assets liabilities liability equity sheet", "eps_reconciliation": "eps earnings per-share share shares diluted basic", "cash_flow_tie_out": "cash", "margin_percent": "margin margins", "percent_change": "growth increase decrease change grew fell rose decline declined"}


def coverage(form: Column, items: Column) -> Column:
    """What a filing's form lets be verified; amendments are only listed."""
    reported = F.array_contains(F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda x: F.trim(x)), "2.02")
    return F.when(form.isin("10-K", "10-Q"), LEVELS[0]).when((form == "8-K") & reported, LEVELS[1]).when(form == "4", LEVELS[2]).otherwise(LEVELS[3])


def coverage_counts(events: DataFrame) -> DataFrame:
    """(coverage, n) of every level, 0 included."""
    levels = events.sparkSession.createDataFrame([(x,) for x in LEVELS], "coverage string")
    n = events.groupBy("coverage").agg(F.count("*").alias("n"))
    return levels.join(n, "coverage", "left").select("coverage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def form_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, "form").agg(F.count("*").alias("n"))


def timeline(events: DataFrame, most: int, *keys: str, forms: list[str] | None = None) -> DataFrame:
    """The latest events of each key by date and accession, most of them (the report's feature), of the forms asked for, in any case."""
    if forms is not None:
        events = events.filter(F.upper("form").isin(*[f.upper() for f in forms]))
    w = Window.partitionBy(*keys).orderBy(F.desc("filing_date"), F.desc("accession"))
    return events.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def ownership(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """The events (entity, accession, form 4) whose filing has parsed transactions, with these nested in order of their dates. A filing's
    transactions are few."""
    own = transactions.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct("date", "owner", "code", direction(F.col("code")).alias("direction"), "shares", "price", (F.col("shares") * F.col("price")).alias("value")))).alias("transactions"))
    return events.filter("form = '4'").join(own, "accession")


def integrity(events: DataFrame) -> DataFrame:
    """(entity, bad_date, bad_accession, bad_coverage, partial_without_results, out_of_order) of each filer: what must be 0. events: entity, form, filing_date,
    accession, items, coverage and rank, in which newer filings come first."""
    reported = F.array_contains(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda x: F.trim(x)), "2.02")
    after = F.lead("filing_date").over(Window.partitionBy("entity").orderBy("rank"))
    x = events.withColumn("__next", after)
    n = lambda c, name: F.count_if(c).alias(name)
    return x.groupBy("entity").agg(
        n(F.try_to_date(F.col("filing_date").cast("string")).isNull(), "bad_date"), n((F.col("accession") != "") & ~F.col("accession").rlike(r"^\d{10}-\d{2}-\d{6}$"), "bad_accession"), n(~F.coalesce(F.col("coverage").isin(*LEVELS), F.lit(False)), "bad_coverage"),
        n((F.col("form") == "8-K") & (F.col("coverage") == LEVELS[1]) & ~reported, "partial_without_results"), n(F.col("__next") > F.col("filing_date"), "out_of_order"),
    )


def direction(code: Column) -> Column:
    return F.when(code.isin("P", "A", "M"), "acquisition").when(code.isin("S", "F", "D"), "disposition").otherwise("other")


def insider_shares(transactions: DataFrame, *keys: str) -> DataFrame:
    """Shares and value (null without a price) by direction."""
    own = lambda d, v: F.sum(F.when(direction(F.col("code")) == d, v))
    return transactions.groupBy(*keys).agg(F.coalesce(own("acquisition", F.col("shares")), F.lit(0.0)).alias("acquired"), F.coalesce(own("disposition", F.col("shares")), F.lit(0.0)).alias("disposed"), F.count("*").alias("n"))


#: The panels in their order.
PANELS = ("verification_score", "evidence_coverage", "disclosure_quality", "consistency_score", "restatement_risk")


def rebuilt(records: DataFrame) -> DataFrame:
    """Flat records as verdict rows for the one scorer: the rule or operation as text, values as grounded operands without those that are null."""
    values = F.filter(F.coalesce("operand_values", F.array().cast("array<double>")), lambda v: v.isNotNull())
    operand = lambda v: F.struct(v.alias("value"), F.lit("grounded").alias("source"))
    return records.select("doc_id", "ord", F.concat(F.lit("["), F.coalesce("rule_name", "operation", F.lit("claim")), F.lit("]")).alias("claim_text"), F.coalesce("operation", F.lit("internal_consistency")).alias("operation"), "rule_name", F.transform(values, operand).alias("operands"), "status", "node_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def panel(name: str, state: Column | str, value: Column | None = None, **parts: Column) -> Column:
    parts_ = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("long"))]) if parts else F.create_map().cast("map<string, bigint>")
    return F.struct(F.lit(name).alias("panel"), (F.lit(state) if isinstance(state, str) else state).alias("state"), (F.lit(None) if value is None else value).cast("double").alias("value"), parts_.alias("parts"))


def record_panels(records: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(doc_id, panel, state, value, parts) of the three panels over records: doc_id, status, evidence_emitted, evidence_gate_satisfied, adjudicated; scores:
    doc_id with score and score_available where claims depend on each other, else the flat score. Nothing measured is unassessed."""
    declined = F.col("status") == K.INSUFFICIENT
    own = {"n": F.count("*"), "emitted": F.count_if("evidence_emitted"), "ok": F.count_if("evidence_gate_satisfied"), "declines": F.count_if(declined), "explained": F.count_if(declined & (F.col("evidence_emitted") | F.col("adjudicated"))), "via_adjudication": F.count_if(declined & F.col("adjudicated"))}
    a = C.score(records, ["doc_id"], also=own)  # one aggregation of the records
    if scores is not None:
        a = a.select("doc_id", *own).join(scores, "doc_id")
    counts = {k: F.col(c) for k, c in (("verified", "n_verified"), ("wrong_math", "n_wrong_math"), ("unsupported", "n_unsupported_number"), ("ambiguous", "n_ambiguous"), ("insufficient_evidence", "n_insufficient_evidence"), ("total_checkable", "total_checkable"))}
    three = F.array(
        panel(PANELS[0], F.when(F.col("score_available"), "ok").otherwise("unassessed"), F.when(F.col("score_available"), F.col("score")), **counts),
        panel(PANELS[1], "ok", C.percent(F.col("emitted"), F.col("n")), claims=F.col("n"), evidence_emitted=F.col("emitted"), evidence_gate_satisfied=F.col("ok")),
        panel(PANELS[2], "ok", F.when(F.col("declines") == 0, 100.0).otherwise(C.percent(F.col("explained"), F.col("declines"))), declines=F.col("declines"), explained=F.col("explained"), explained_via_adjudication=F.col("via_adjudication")),
    )
    return a.select("doc_id", F.inline(three))


def consistency_panel(memories: DataFrame) -> DataFrame:
    """(doc_id, panel, ...): the share of series with two points or more that no comparability gate has touched; that splits make a class of series
    unsafe is shown and not held against it. memories: doc_id, n_points, n_dropped, split_sensitive, signals."""
    usable = F.col("n_points") >= 2
    fallback = F.array_contains("signals", "fallback_xbrl_tag_used")
    n = lambda c: F.count_if(usable & c)
    a = memories.groupBy("doc_id").agg(F.count_if(usable).alias("usable"), n((F.col("n_dropped") == 0) & ~fallback).alias("clean"), n(F.col("n_dropped") > 0).alias("with_dropped"), n(fallback).alias("with_fallback"), n(F.col("split_sensitive")).alias("split"))
    some = F.col("usable") > 0
    return a.select("doc_id", F.inline(F.array(panel(PANELS[3], F.when(some, "ok").otherwise("no_data"), F.when(some, C.percent(F.col("clean"), F.col("usable"))), usable_series=F.col("usable"), clean_series=F.col("clean"), series_with_dropped_spans=F.col("with_dropped"), series_with_fallback_tag=F.col("with_fallback"), split_sensitive_surfaced=F.col("split")))))


def restatement_panel(compared: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(doc_id, panel, ...): conflicts by type, zeros included, of every document that was compared (doc_id); what was not has no row, so it
    stays unassessed. conflicts: doc_id, restatement_type."""
    kinds = ("UNCLASSIFIED", "EXPLICIT_RESTATEMENT", "POSSIBLE_RECLASSIFICATION", "UNEXPLAINED")
    kind = F.coalesce("restatement_type", F.lit(kinds[0]))
    n = conflicts.groupBy("doc_id").agg(F.count("*").alias("conflicts"), *[F.count_if(kind == k).alias(k.lower()) for k in kinds])
    names = ("conflicts", *[k.lower() for k in kinds])
    return compared.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.inline(F.array(panel(PANELS[4], "ok", None, **{k: F.coalesce(k, F.lit(0)) for k in names}))))


def assembled(documents: DataFrame, *parts: DataFrame) -> DataFrame:
    """(doc_id, panel_ord, panel, state, value, parts): five panels of each document in their order. A panel that no part has is unassessed, but the
    three over records say no_data."""
    have = parts[0]
    for p in parts[1:]:
        have = have.unionByName(p)
    every = documents.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, PANELS))).alias("panel_ord", "panel"))
    empty = F.when(F.col("panel_ord") < 3, "no_data").otherwise("unassessed")
    return every.join(have, ["doc_id", "panel"], "left").select("doc_id", F.col("panel_ord").cast("long").alias("panel_ord"), "panel", F.coalesce("state", empty).alias("state"), "value", F.coalesce("parts", F.create_map().cast("map<string, bigint>")).alias("parts"))


def agreement(dashboards: DataFrame, records: DataFrame) -> DataFrame:
    """(status, from_panels, from_records, agrees): the verdicts that the panels of all documents add up to, and those of the records."""
    named = {"verified": K.VERIFIED, "wrong_math": K.WRONG, "unsupported": K.UNSUPPORTED, "insufficient_evidence": K.INSUFFICIENT}
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.coalesce(F.try_element_at("parts", F.lit(k)), F.lit(0)).alias("n")) for k, s in named.items()])
    a = dashboards.filter(F.col("panel") == PANELS[0]).select(F.inline(rows)).groupBy("status").agg(F.sum("n").alias("from_panels"))
    b = records.filter(F.col("status").isin(*named.values())).groupBy("status").agg(F.count("*").alias("from_records"))
    x = a.join(b, "status", "left").withColumn("from_records", F.coalesce("from_records", F.lit(0)))
    return x.withColumn("agrees", F.col("from_panels") == F.col("from_records"))


def ledger(verdicts: DataFrame) -> DataFrame:
    """Verified claims as numbered facts of their document, with the values that an answer may state; others blocked, their numbers withheld.
    verdicts: doc_id, ord, topic, claim_text, status, and where there are any stated_value, recomputed, operands."""
    ok = F.col("status") == K.VERIFIED
    has = set(verdicts.columns)
    w = Window.partitionBy("doc_id", ok).orderBy("ord")
    numbers = [F.array(F.col(c).cast("double")) for c in ("stated_value", "recomputed") if c in has] + ([F.transform("operands", lambda o: o["value"])] if "operands" in has else [])
    values = F.array_compact(F.concat(*numbers)) if numbers else F.array().cast("array<double>")
    return verdicts.withColumn("fact_id", F.when(ok, F.concat(F.lit("F"), F.row_number().over(w).cast("string")))).withColumns({"shown": F.when(ok, F.col("claim_text")).otherwise(T.withheld(F.col("claim_text"))), "values": F.when(ok, values).otherwise(F.array().cast("array<double>"))})


def ledger_of_records(records: DataFrame) -> DataFrame:
    """ledger of flat records (doc_id, ord, rule_name, operation, status, operand_values, explanation): the topic is the rule, or else the operation."""
    topic = F.coalesce("rule_name", "operation", F.lit("claim"))
    values = F.filter(F.coalesce("operand_values", F.array().cast("array<double>")), lambda v: v.isNotNull())
    said = F.when(F.col("status") == K.VERIFIED, F.concat(topic, F.lit(" check passed on operands ["), F.array_join(F.transform(values, C.shown), ", "), F.lit("]"))).otherwise(F.coalesce("explanation", F.lit("")))
    operand = lambda v: F.struct(v.alias("value"))
    return ledger(records.select("doc_id", "ord", topic.alias("topic"), said.alias("claim_text"), "status", F.transform(values, operand).alias("operands"))).drop("operands")


def asked(question: Column) -> Column:
    """The topics of a question: words between white space, without marks around them."""
    words = T.plain_words(question, "?.,!()'\"")
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, kw.split()))), t) for t, kw in TOPICS.items()]))


def usage(keys: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Calls and last call of every key, 0 included."""
    u = events.groupBy(key).agg(F.count("*").alias("calls"), F.max("ts").alias("last_call"))
    return keys.join(u, key, "left").withColumn("calls", F.coalesce("calls", F.lit(0)).cast("long"))


def due_deliveries(deliveries: DataFrame, hooks: DataFrame, now: Column, most: int = 25) -> DataFrame:
    """The first deliveries, by id, that are due and whose hook is active, with the state that a failed attempt leads to."""
    due = deliveries.filter(F.col("status").isin("pending", "retry") & (F.col("next_attempt") <= now)).join(hooks.filter("active").select("hook_id", "url"), "hook_id")
    tries = F.col("attempts") + 1
    return due.orderBy("delivery_id").limit(most).withColumns({"if_failed": F.when(tries >= 5, "failed").otherwise("retry"), "delay_s": F.least(F.lit(3600.0), F.pow(F.lit(2.0), tries)).cast("long")})


def retryable(outcome: Column) -> Column:
    """Whether a fetch with this outcome is worth another try."""
    return outcome.isin("http_429", "http_500", "http_502", "http_503", "http_504", "url_error", "timeout", "error_ConnectionError", "error_ConnectionResetError", "error_ConnectionRefusedError", "error_ConnectionAbortedError", "error_BrokenPipeError")


def outcome(kind: Column, code: Column) -> Column:
    """The tag of a fetch by what was raised: HTTPError with its code, URLError, a timeout, or any other error; ok where nothing was."""
    return F.when(kind.isNull(), "ok").when(kind == "HTTPError", F.concat(F.lit("http_"), code.cast("string"))).when(kind == "URLError", "url_error").when(kind.isin("timeout", "TimeoutError"), "timeout").otherwise(F.concat(F.lit("error_"), kind))


def fetch_metrics(log: DataFrame, *keys: str) -> DataFrame:
    """Calls, successes, failures, retries, success rate, latencies (mean, nearest-rank p50 and p95 at index round(p / 100 * (n - 1)), longest) of each key.
    Ranks come from counts of equal latencies in ranges, so that a key with most of the log is still spread over many tasks. log: keys, latency, ok, and
    retries where there are any."""
    retries = F.sum("retries") if "retries" in log.columns else F.lit(0)
    total = log.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), retries.cast("long").alias("retries"), F.avg("latency").alias("mean"), F.max("latency").alias("longest"))
    each = log.groupBy(*keys, "latency").agg(F.count("*").alias("n"))
    each = cut(each.repartitionByRange(*keys, "latency").withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy(*keys, "__range").agg(F.sum("n").alias("m")).withColumn("__before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    local = Window.partitionBy(*keys, "__range").orderBy("latency").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.withColumn("upto", F.sum("n").over(local)).join(ranges.drop("m"), [*keys, "__range"]).withColumn("upto", F.col("upto") + F.col("__before")).join(total.select(*keys, "calls"), [*keys])
    at = lambda p: F.max(F.when((F.rint(F.lit(p) * (F.col("calls") - 1)) < F.col("upto")) & (F.rint(F.lit(p) * (F.col("calls") - 1)) >= F.col("upto") - F.col("n")), F.col("latency")))
    return total.join(ranked.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95")), [*keys]).withColumns({"failures": F.col("calls") - F.col("ok"), "success_rate": F.bround(F.col("ok") / F.col("calls"), 4)})


def fetch_summary(log: DataFrame, *keys: str) -> DataFrame:
    """fetch_metrics with the total latency, all latencies rounded to 4 digits, and a map of outcome to count, in one row a key. log: also outcome. The total is a sum of
    decimals, so it is the same in any order."""
    r4 = lambda c: F.bround(F.col(c), 4)
    m = fetch_metrics(log, *keys).withColumns({c: r4(c) for c in ("mean", "p50", "p95", "longest")})
    total = log.groupBy(*keys).agg(F.bround(F.sum(F.col("latency").cast("decimal(38, 12)")).cast("double"), 4).alias("total"))
    n = log.groupBy(*keys, F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))
    tags = n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    return m.join(total, [*keys]).join(tags, [*keys])


def outcomes(log: DataFrame, *keys: str) -> DataFrame:
    """Calls by outcome."""
    return log.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))
