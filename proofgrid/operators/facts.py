"""Tagged facts to claims: the twelve fields of a filing, pinned to one period, the claims they support, and runs over all filers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T
from proofgrid.sources import sinks

from . import claims as C
from .series import chosen_span

#: Fields with their tags, the preferred first, their unit, and whether they last over a span.
FIELDS = [
    ("assets", ["Assets"], "USD", False),
    ("liabilities", ["Liabilities"], "USD", False),
    ("equity", ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity"], "USD", False),
    ("temp_equity", ["RedeemableNoncontrollingInterestEquityCarryingAmount", "RedeemableNoncontrollingInterestEquityFairValue", "TemporaryEquityCarryingAmountAttributableToParent", "TemporaryEquityCarryingAmountIncludingPortionAttributableToNoncontrollingInterests"], "USD", False),
    ("net_income_total", ["NetIncomeLoss", "ProfitLoss"], "USD", True),
    ("net_income_to_common", ["NetIncomeLossAvailableToCommonStockholdersBasic"], "USD", True),
    ("eps_basic", ["EarningsPerShareBasic"], "USD/shares", True),
    ("eps_diluted", ["EarningsPerShareDiluted"], "USD/shares", True),
    ("shares_basic", ["WeightedAverageNumberOfSharesOutstandingBasic", "WeightedAverageNumberOfShareOutstandingBasicAndDiluted"], "shares", True),
    ("shares_diluted", ["WeightedAverageNumberOfDilutedSharesOutstanding"], "shares", True),
    ("bs_cash", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments"], "USD", False),
    ("cf_cash", ["CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsIncludingDisposalGroupAndDiscontinuedOperations", "CashAndCashEquivalentsAtCarryingValue"], "USD", False),
]


def field_tags(spark: SparkSession) -> DataFrame:
    rows = [(f, t, i, unit, lasts) for f, tags, unit, lasts in FIELDS for i, t in enumerate(tags)]
    return F.broadcast(spark.createDataFrame(rows, "field string, tag string, tag_rank int, unit string, duration boolean"))


def pivoted(facts: DataFrame, form: str = "10-K", pins: DataFrame | None = None) -> DataFrame:
    """One row an entity: period_end, the twelve fields and tags_used. Every field is of the period that the entity's latest Assets of the form end, or
    that pins (entity, end; one row an entity) name; nothing is taken from another period, and a fact without an end takes no part. Facts are read and shuffled once, by entity
    over all shuffle partitions: by number, as Spark would join partitions by their compressed bytes, and these are sorted whole. Facts of no field only say that the entity is
    there, and go without their values."""
    own = facts.filter((F.col("form") == form) & F.col("val").isNotNull()).join(field_tags(facts.sparkSession), ["tag", "unit"], "left")
    fits, prefer = chosen_span(form)
    usable = F.col("field").isNotNull() & F.col("end").isNotNull() & (~F.col("duration") | fits)
    only = lambda c: F.when(usable, c)
    rank = F.struct((-F.col("tag_rank")).alias("rank"), prefer.alias("prefer"), "filed", (-F.col("pos")).alias("pos"))
    own = own.select("entity", only(F.col("field")).alias("field"), only(F.col("end")).alias("end"), only(F.struct("tag", "val")).alias("p"), only(rank).alias("rank"))
    own = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")
    ends = own.groupBy("entity", "field", "end").agg(F.max_by("p", "rank").alias("p"))
    pin = F.max(F.when(F.col("field") == "assets", F.col("end"))).over(Window.partitionBy("entity"))
    x = ends.withColumn("period_end", pin) if pins is None else ends.join(pins.select("entity", F.col("end").alias("period_end")), "entity", "left")
    here = F.col("end") == F.col("period_end")
    used = F.collect_list(F.when(here, F.struct("field", F.col("p.tag").alias("tag"))))
    x = x.groupBy("entity").agg(F.max("period_end").alias("period_end"), *[F.max(F.when(here & (F.col("field") == f), F.col("p.val"))).alias(f) for f, *_ in FIELDS], F.array_sort(used).alias("__used"))
    return x.withColumn("tags_used", F.when(F.size("__used") > 0, F.map_from_entries("__used"))).drop("__used")


def claims_of(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, claim fields and evidence) of pivoted rows: a claim only where every operand is tagged. A redeemable block within 10 % of the
    gap of the balance sheet marks it incomplete; diluted earnings over a basic numerator are not claimed where the equity includes other
    holders; cash scopes differ only where the figures do."""
    c, used = F.col, lambda f: F.coalesce(F.try_element_at("tags_used", F.lit(f)), F.lit(""))
    number = lambda v, category: F.struct(v.alias("value"), F.lit("grounded").alias("source"), (F.lit(category) if isinstance(category, str) else category).alias("category"))
    gap = c("assets") - (c("liabilities") + c("equity"))
    redeemable = F.coalesce((c("temp_equity") != 0) & (gap > 0) & (F.abs(gap - c("temp_equity")) <= 0.10 * F.abs("temp_equity")), F.lit(False))
    nci = used("equity") == FIELDS[2][1][0]
    common = c("net_income_to_common").isNotNull()
    income, basis = F.coalesce("net_income_to_common", "net_income_total"), F.when(common, "common").otherwise("total")
    restricted = (F.locate("Restricted", used("cf_cash")) > 0) & (F.abs(c("cf_cash") - c("bs_cash")) > 1e-6 * F.greatest(F.abs("bs_cash"), F.lit(1.0)))
    none = F.lit(None)

    def claim(rule: str, what: str, operands: Column, variant=None, complete=None, redeemable=None, basis=None, restricted=None) -> Column:  # noqa: ANN001
        of = lambda x, t, name: (none if x is None else x).cast(t).alias(name)
        return F.struct(F.concat(F.lit("[tagged] "), c("entity"), F.lit(f" {what}")).alias("claim_text"), F.lit("internal_consistency").alias("operation"), none.cast("double").alias("stated_value"), operands.alias("operands"), F.lit(rule).alias("rule_name"), F.lit(variant).cast("string").alias("eps_variant"), of(complete, "boolean", "liabilities_complete"), of(redeemable, "boolean", "redeemable_equity_present"), of(basis, "string", "eps_income_basis"), of(basis, "string", "income_operand_basis"), of(restricted, "boolean", "restricted_cash_disclosed"))

    def eps(variant: str) -> Column:
        stated, shares = c(f"eps_{variant}"), c(f"shares_{variant}")
        there = stated.isNotNull() & income.isNotNull() & shares.isNotNull() & (shares != 0)
        if variant == "diluted":
            there = there & ~(common & nci & ~shares.eqNullSafe(c("shares_basic")))
        return F.when(there, claim("eps_reconciliation", f"{variant} EPS reconciliation", F.array(number(stated, variant), number(income, basis), number(shares, variant)), variant, basis=basis))

    whole = F.array(number(c("assets"), "total_assets"), number(c("liabilities"), "total_liabilities"), number(c("equity"), "total_equity"))
    made = F.array(
        F.when(c("assets").isNotNull() & c("liabilities").isNotNull() & c("equity").isNotNull(), claim("balance_sheet_identity", "balance sheet identity", whole, complete=F.lit(True), redeemable=redeemable)),
        eps("basic"), eps("diluted"),
        F.when(c("bs_cash").isNotNull() & c("cf_cash").isNotNull(), claim("cash_flow_tie_out", "cash tie-out", F.array(number(c("cf_cash"), "statement_ending_cash"), number(c("bs_cash"), "balance_sheet_cash")), restricted=restricted)),
    )
    x = rows.select(F.col("entity").alias("doc_id"), "period_end", F.posexplode(F.array_compact(made)).alias("ord", "q"))
    return x.select("doc_id", "period_end", F.col("ord").cast("long").alias("ord"), "q.*")


def run(facts: DataFrame, form: str = "10-K", pins: DataFrame | None = None) -> DataFrame:
    """(entity, period_end, n_claims, verdicts) of every filer: facts to claims to verdicts, in one job."""
    rows = pivoted(facts, form, pins)
    v = C.verify(claims_of(rows))
    n = sinks.verdict_counts(v, "doc_id").withColumn("n_claims", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, c: a + c))
    out = rows.select("entity", "period_end").join(n.withColumnRenamed("doc_id", "entity"), "entity", "left")
    return out.select("entity", "period_end", F.coalesce("n_claims", F.lit(0)).cast("long").alias("n_claims"), F.coalesce("counts", F.create_map().cast("map<string, bigint>")).alias("verdicts"))


def payloads(facts: DataFrame, form: str = "10-K") -> DataFrame:
    """(entity, json) of every filer: its period and its verified claims, nested, as an audit would return them; built from facts alone."""
    v = C.verify(claims_of(pivoted(facts, form)))
    one = F.struct("ord", F.struct("status", F.col("recomputed").alias("recomputed_value"), "delta", F.struct("claim_text", "operation", "rule_name", "eps_variant", "operands").alias("claim")).alias("r"))
    own = v.groupBy("doc_id", "period_end").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("results"))
    return own.select(F.col("doc_id").alias("entity"), F.to_json(F.struct(F.struct(F.col("doc_id").alias("ticker"), F.col("period_end").alias("period"), F.lit("tagged facts").alias("source")).alias("filing"), "results"), {"ignoreNullFields": "false"}).alias("json"))


def directional(points: DataFrame, said: DataFrame) -> DataFrame:
    """Claims of a discussion against its series: the direction said of a concept and the percent change of its last two points over the size of the
    one before; null where there are not two. points: entity, concept, end, val; said: doc_id, ord, concept, direction, excerpt."""
    last = points.groupBy("entity", "concept").agg(F.slice(F.sort_array(F.collect_list(F.struct("end", "val")), asc=False), 1, 2).alias("p"))
    x = said.join(last.withColumnRenamed("entity", "doc_id"), ["doc_id", "concept"], "left")
    new, old = F.get("p", F.lit(0))["val"], F.get("p", F.lit(1))["val"]
    operand = lambda v: F.struct(v.alias("value"), F.lit("grounded").alias("source"), F.lit(None).cast("string").alias("category"))
    return x.select("doc_id", "ord", F.col("excerpt").alias("claim_text"), F.lit("mda_xbrl_consistency").alias("operation"), F.lit(None).cast("double").alias("stated_value"), F.when(old.isNotNull(), F.array(operand(old), operand(new))).otherwise(F.array().cast("array<struct<value: double, source: string, category: string>>")).alias("operands"), F.col("direction").alias("trend_dir"), K.change_over_prior(old, new).alias("actual_percent_change"))


def guidance(concepts: DataFrame) -> DataFrame:
    """The concepts (entity, taxonomy, tag, label, description) that speak of what is expected, and whether they can be guidance."""
    f = T.forward_looking(F.col("tag"), F.col("label"), F.col("description"))
    return concepts.withColumn("__f", f).filter("__f.raw").withColumn("candidate", F.col("__f.candidate")).drop("__f")


SEGMENT_KEYS = ("segments", "segment", "dimensions", "dimension")


def segments(facts: DataFrame, most: int = 3) -> DataFrame:
    """(entity, n_facts, n, examples) of filers whose raw facts have keys of segments, with the number of all their facts; examples: the first of them by taxonomy, tag, unit
    and place (the report's feature). facts: entity, taxonomy, tag, unit, pos, keys."""
    x = facts.withColumn("segment_keys", F.array_intersect("keys", F.array(*map(F.lit, SEGMENT_KEYS))))
    has = F.size("segment_keys") > 0
    order = ("taxonomy", "tag", "unit", "pos")
    named = F.array_sort(F.collect_list(F.when(has, F.struct(*order, "segment_keys"))))  # of one filer, and less than the file that they were read from
    return x.groupBy("entity").agg(F.count("*").alias("n_facts"), F.count_if(has).alias("n"), F.slice(named, 1, most).alias("examples")).filter("n > 0")
