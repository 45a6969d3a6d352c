"""Tagged facts to comparable series: selection, deduplication, change, signals, controls.

facts: entity, tag, unit, start, end, val, fy, fp, form, filed, pos. All partitions are by entity and tag, so a hot filer's tags spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def span_days(start: Column, end: Column) -> Column:
    return F.coalesce(F.datediff(end, start), F.lit(0))


def comparable_window(form: Column) -> tuple[Column, Column]:
    return F.when(form == "10-Q", 80).otherwise(340), F.when(form == "10-Q", 100).otherwise(380)


#: Tags of each concept, the preferred first; concepts per share or counted in shares, whose series splits of shares make unsafe.
CONCEPTS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "assets": ["Assets"],
    "liabilities": ["Liabilities"],
    "equity": ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "eps_basic": ["EarningsPerShareBasic"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "shares_basic": ["WeightedAverageNumberOfSharesOutstandingBasic", "WeightedAverageNumberOfShareOutstandingBasicAndDiluted"],
}
PER_SHARE, SHARES = ("eps_basic", "eps_diluted"), ("shares_basic", "shares_diluted")


def concept_tags(spark: SparkSession) -> DataFrame:
    """(concept, tag, tag_rank, unit, split_sensitive) of the ten concepts."""
    unit = lambda c: "USD/shares" if c in PER_SHARE else "shares" if c in SHARES else "USD"
    rows = [(c, t, i, unit(c), c in PER_SHARE + SHARES) for c, ts in CONCEPTS.items() for i, t in enumerate(ts)]
    return F.broadcast(spark.createDataFrame(rows, "concept string, tag string, tag_rank int, unit string, split_sensitive boolean"))


def comparable(facts: DataFrame) -> DataFrame:
    """One point for each entity, tag, unit, form and end among facts with a comparable span (or none): the last filed, of equals the last row."""
    days = span_days(F.col("start"), F.col("end"))
    low, high = comparable_window(F.col("form"))
    good = facts.filter("val is not null and end is not null").withColumn("span_days", days).filter(F.col("start").isNull() | F.col("span_days").between(low, high))
    return good.groupBy("entity", "tag", "unit", "form", "end").agg(F.max_by(F.struct("val", "span_days", "filed", "fy"), F.struct("filed", "pos")).alias("p")).select("entity", "tag", "unit", "form", "end", "p.*")


def dropped(facts: DataFrame) -> DataFrame:
    """How many facts of an entity, tag, unit and form have spans that don't compare."""
    days = span_days(F.col("start"), F.col("end"))
    low, high = comparable_window(F.col("form"))
    return facts.filter("val is not null and end is not null").groupBy("entity", "tag", "unit", "form").agg(F.count_if(F.col("start").isNotNull() & ~days.between(low, high)).alias("n_dropped"))


def with_fallback(points: DataFrame, tags: DataFrame) -> DataFrame:
    """Points of each concept from its first tag, by rank, that has any in the concept's unit; tags: concept, tag, tag_rank, unit, split_sensitive
    (bounded by the concepts)."""
    own = points.join(tags, ["tag", "unit"])
    best = own.groupBy("entity", "concept", "form").agg(F.min("tag_rank").alias("tag_rank"))
    return own.join(best, ["entity", "concept", "form", "tag_rank"])


def chosen_span(form: str) -> tuple[Column, Column]:
    """Whether a fact lasts as long as those of a form's flows do, and what is the greater the better the span suits the form."""
    days = span_days(F.col("start"), F.col("end"))
    quarter, year = days.between(60, 100), days >= 300
    return F.col("start").isNotNull() & (quarter if form == "10-Q" else year if form == "10-K" else year | quarter), -days if form == "10-Q" else days


def select_facts(facts: DataFrame, tags: DataFrame, forms: tuple[str, ...], pins: DataFrame | None = None) -> DataFrame:
    """One fact of each form for each entity and field: the first tag and unit with candidates, then the pinned end or the latest, the longest span
    (of a quarterly report the shortest), the last filed. Facts of other forms and units never take part; with pins (entity, end) an entity
    has no fact of another end. All forms are chosen in one pass. tags: field, tag, tag_rank, unit, duration."""
    of_form = lambda i: F.coalesce(*[F.when(F.col("form") == f, chosen_span(f)[i]) for f in forms])
    c = facts.filter(F.col("form").isin(*forms) & F.col("val").isNotNull()).join(tags, ["tag", "unit"]).filter(~F.col("duration") | of_form(0))
    if pins is not None:
        c = c.join(pins.select("entity", F.col("end").alias("__pin")), "entity").filter("end = __pin").drop("__pin")
    best = F.max_by(F.struct("tag", "tag_rank", "end", "val", "filed", "fy", "fp"), F.struct(-F.col("tag_rank"), F.col("end"), of_form(1), F.col("filed"), -F.col("pos"))).alias("p")
    return c.groupBy("entity", "field", "form").agg(best).select("form", "entity", "field", "p.*")


def select_fact(facts: DataFrame, tags: DataFrame, form: str = "10-K", pins: DataFrame | None = None) -> DataFrame:
    """The facts that select_facts chooses of one form."""
    return select_facts(facts, tags, (form,), pins).drop("form")


def year_on_year(points: DataFrame, *keys: str) -> DataFrame:
    """points with prior and yoy, the percent change on the point before to four places; null where that is null or 0."""
    w = Window.partitionBy(*keys).orderBy("end")
    prior = F.lag("val").over(w)
    return points.withColumn("prior", prior).withColumn("yoy", F.bround(F.try_divide(F.col("val") - F.col("prior"), F.col("prior")) * 100, 4))


def memory(points: DataFrame, *keys: str) -> DataFrame:
    """One row a series: points, first and last end, the last yoy that is defined."""
    return year_on_year(points, *keys).groupBy(*keys).agg(F.count("*").alias("n_points"), F.min("end").alias("first_end"), F.max("end").alias("last_end"), F.max_by("val", "end").alias("last_val"), F.max_by("yoy", F.when(F.col("yoy").isNotNull(), F.col("end"))).alias("last_yoy"))


def company_memory(facts: DataFrame, tags: DataFrame, form: str = "10-K") -> DataFrame:
    """(entity, concept, tag, n_points, last_yoy, n_dropped, split_sensitive, tag_rank, signals): every concept of every entity, 0 points where it has none."""
    own = facts.filter(F.col("form") == form)
    points = with_fallback(comparable(own), tags)
    m = memory(points, "entity", "concept", "tag", "unit", "tag_rank", "split_sensitive")
    m = m.join(dropped(own).select("entity", "tag", "unit", "n_dropped"), ["entity", "tag", "unit"], "left")
    every = own.select("entity").distinct().join(F.broadcast(tags.select("concept").distinct()))
    x = every.join(m, ["entity", "concept"], "left").withColumns({"n_points": F.coalesce("n_points", F.lit(0)), "n_dropped": F.coalesce("n_dropped", F.lit(0)), "split_sensitive": F.coalesce("split_sensitive", F.lit(False)), "tag_rank": F.coalesce("tag_rank", F.lit(0))})
    return x.select("entity", "concept", "tag", "n_points", "first_end", "last_end", "last_val", "last_yoy", "n_dropped", "split_sensitive", "tag_rank", named_signals().alias("signals"))


def memory_measured(memories: DataFrame) -> DataFrame:
    """One row: entities, series with points, points, and each signal's count."""
    has = lambda s: F.count_if(F.array_contains("signals", s)).alias(s)
    return memories.agg(F.count_distinct("entity").alias("entities"), F.count_if(F.col("n_points") > 0).alias("series"), F.sum("n_points").alias("points"), has("noncomparable_spans_dropped"), has("split_sensitive_series"), has("fallback_xbrl_tag_used"))


def named_signals() -> Column:
    return F.array_compact(F.array(F.when(F.col("n_dropped") > 0, "noncomparable_spans_dropped"), F.when(F.col("split_sensitive"), "split_sensitive_series"), F.when(F.col("tag_rank") > 0, "fallback_xbrl_tag_used")))


def signals(series: DataFrame) -> DataFrame:
    """(entity, concept, signal) of series with n_dropped, split_sensitive and tag_rank."""
    return series.select("entity", "concept", F.explode(named_signals()).alias("signal"))


def last_points(points: DataFrame, n: int, *keys: str) -> DataFrame:
    """Arrays of the last n points of each series in order of end; at most n rows of a series are gathered."""
    w = Window.partitionBy(*keys).orderBy(F.desc("end"))
    top = points.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("end", "val"))).alias("points"))


def controls(windows: DataFrame, *keys: str) -> DataFrame:
    """Claims whose verdict is known, made from the values: true ones, wrong ones, and whether the last point is the highest (expected says which
    verdict is right). No percent change of a split-sensitive series; no direction of a series that is not monotone; no run without a rise.
    windows: keys, points, split_sensitive."""
    v = F.transform("points", lambda p: p["val"])
    ends = F.transform("points", lambda p: p["end"].cast("string"))
    n = F.size(v)
    old, new = F.get(v, n - 2), F.get(v, n - 1)
    pct = F.when(~F.col("split_sensitive"), F.try_divide(new - old, old) * 100)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(v, i).alias("a"), F.get(v, i + 1).alias("b")))
    way = F.when(F.forall(pairs, lambda p: p["b"] > p["a"]), "up").when(F.forall(pairs, lambda p: p["b"] < p["a"]), "down")
    run = F.aggregate(pairs, F.lit(0), lambda s, p: F.when(p["b"] > p["a"], s + 1).otherwise(0)).cast("double")
    is_max = new == F.array_max(v)

    def claim(kind: str, control: str, op: str, stated=None, values=None, direction=None, which=None, target=None, right=None) -> Column:  # noqa: ANN001
        text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
        operands = F.transform(values if values is not None else v, lambda x: F.struct(x.alias("value"), F.lit("grounded").alias("source"), F.lit(None).cast("string").alias("category")))
        expected = right if right is not None else F.lit("VERIFIED" if control == "positive" else "WRONG_MATH")
        return F.struct(F.lit(kind).alias("kind"), F.lit(control).alias("control"), F.lit(op).alias("operation"), (stated if stated is not None else F.lit(None)).cast("double").alias("stated_value"), operands.alias("operands"), text(direction).alias("trend_dir"), text(which).alias("superlative"), text(target).alias("target_period"), ends.alias("periods"), expected.alias("expected"))

    two, opposite = F.array(old, new), F.when(way == "up", "down").otherwise("up")
    made = F.array(
        F.when(pct.isNotNull(), claim("pct", "positive", "percent_change", F.bround(pct, 2), two)), F.when(pct.isNotNull(), claim("pct", "negative", "percent_change", F.bround(pct + 25, 2), two)),
        F.when(way.isNotNull(), claim("direction", "positive", "trend_direction", None, None, way)), F.when(way.isNotNull(), claim("direction", "negative", "trend_direction", None, None, opposite)),
        F.when(run >= 1, claim("run", "positive", "consecutive_count", run, None, "up")), F.when(run >= 1, claim("run", "negative", "consecutive_count", run + 2, None, "up")),
        claim("max", "positive", "superlative", None, None, None, "max", F.get(ends, n - 1), F.when(is_max, "VERIFIED").otherwise("WRONG_MATH")),
    )
    return windows.filter(n >= 2).select(*keys, F.inline(F.array_compact(made)))


def control_check(verdicts: DataFrame, *keys: str) -> DataFrame:
    """How many positive and negative controls got the verdict that is right. verdicts: keys, control, expected, status."""
    ok = F.col("status") == F.col("expected")
    one = lambda c: (F.count_if((F.col("control") == c) & ok).alias(f"{c}_ok"), F.count_if(F.col("control") == c).alias(f"{c}_total"))
    return verdicts.groupBy(*keys).agg(*one("positive"), *one("negative"))
