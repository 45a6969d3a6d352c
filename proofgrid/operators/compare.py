"""Comparison across documents and filers: conflicts, derived outputs, peers, insiders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T

from . import claims as C
from . import graph

STALE_DAYS, MIN_PEERS, SIGMA = 200, 3, 2.0
LINK_TOL, DERIVED = 1e-6, ("sum", "difference", "product", "average")


def conflicts(cells: DataFrame, rel: float = 0.0) -> DataFrame:
    """Pairs of documents, the first before the second, that give one label different values; the difference is over the second's value.
    An equi-join on the labels, so a hot label can be split by adaptive execution. cells: set_id, doc_id, doc_ord, row_label, column_label, value."""
    key = lambda c: F.lower(F.trim(c))
    side = lambda x: cells.select("set_id", key("row_label").alias("row"), key("column_label").alias("col"), F.col("doc_id").alias(f"doc_{x}"), F.col("doc_ord").alias(f"ord_{x}"), F.col("value").alias(f"value_{x}"))
    gap = F.abs(F.col("value_a") - F.col("value_b")) / F.greatest(F.abs("value_b"), F.lit(1e-9))
    return side("a").join(side("b"), ["set_id", "row", "col"]).filter((F.col("ord_a") < F.col("ord_b")) & (gap > rel)).select("set_id", "row", "col", "doc_a", "value_a", "doc_b", "value_b")


def conflict_for(found: DataFrame, row_label: str, column_label: str) -> DataFrame:
    """The first conflict under one label pair, by documents."""
    return found.filter((F.col("row") == row_label.strip().lower()) & (F.col("col") == column_label.strip().lower())).orderBy("doc_a", "doc_b", "value_a", "value_b").limit(1)


RANK = {"EXPLICIT_RESTATEMENT": 2, "POSSIBLE_RECLASSIFICATION": 1, "UNEXPLAINED": 0}


def strongest(contexts: Column) -> Column:
    """The strongest disclosure of an array of texts, as struct(rank, kind, matched); null without a text."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    each = F.transform(contexts, lambda c: K.bind(T.disclosure(c), lambda d: F.struct(rank[d["kind"]].alias("rank"), d["kind"].alias("kind"), d["matched"].alias("matched"))))
    return F.aggregate(each, F.lit(None).cast("struct<rank: int, kind: string, matched: string>"), lambda best, x: F.when(best.isNull() | (x["rank"] > best["rank"]), x).otherwise(best))


def annotated(found: DataFrame, texts: DataFrame, around: int = 200) -> DataFrame:
    """Conflicts with restatement_type and matched: the strongest disclosure near either value in the second document's text where that is explicit,
    else in the first's, else in the second's. Without a place that states a value UNCLASSIFIED. texts: doc_id, text. Only places of the figures
    are joined, not texts with texts."""
    out = found
    for side in ("a", "b"):
        own = texts.select(F.col("doc_id").alias(f"doc_{side}"), F.col("text").alias("__text"))
        windows = F.concat(T.context_windows(F.col("__text"), F.col("value_a"), around), T.context_windows(F.col("__text"), F.col("value_b"), around))
        out = out.join(own, f"doc_{side}", "left").withColumn(f"__{side}", strongest(windows)).drop("__text")
    b, a = F.col("__b"), F.col("__a")
    pick = F.when(b["rank"] == 2, b).when(a.isNotNull(), a).otherwise(b)
    return out.withColumns({"restatement_type": F.coalesce(pick["kind"], F.lit("UNCLASSIFIED")), "matched": pick["matched"]}).drop("__a", "__b")


def conflict_verdicts(annotated: DataFrame) -> DataFrame:
    """Conflicts as verdict rows: an identity claim without a stated value whose operands are both figures with their documents."""
    number = lambda c: C.shown(F.col(c))
    text = F.concat(F.lit("Cross-document conflict on '"), "row", F.lit(" / "), "col", F.lit("': "), "doc_a", F.lit("="), number("value_a"), F.lit(", "), "doc_b", F.lit("="), number("value_b"))
    operand = lambda s: F.struct(F.col(f"value_{s}").alias("value"), F.lit("grounded").alias("source"), F.col(f"doc_{s}").alias("doc_id"))
    scan = F.when(F.col("restatement_type") != "UNCLASSIFIED", F.concat(F.lit(" Disclosure scan: "), "restatement_type", F.coalesce(F.concat(F.lit(" (matched '"), "matched", F.lit("')")), F.lit("")), F.lit(".")))
    none = F.lit(None).cast("double")
    return annotated.select("set_id", text.alias("claim_text"), F.lit("identity").alias("operation"), none.alias("stated_value"), F.array(operand("a"), operand("b")).alias("operands"), F.lit(K.CONFLICT).alias("status"), none.alias("recomputed"), none.alias("delta"), F.concat(text, F.coalesce(scan, F.lit(""))).alias("explanation"), "restatement_type")


def derived_links(claims: DataFrame, source_numbers: DataFrame) -> DataFrame:
    """(doc_id, src, dst): an operand that no source number states (within 1e-6) and that exactly one derived claim of its document has as its
    value. A band join: values fall in logarithmic bins wider than the tolerance, probed with both neighbours.
    claims: doc_id, claim_id, operation, stated_value, operands array<double>; source_numbers: doc_id, value."""
    bin_of = lambda v: F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * (F.floor(F.log(F.abs(v)) / 2e-6) + 10**9))
    near = lambda a, b: F.abs(a - b) <= LINK_TOL * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    ops = claims.select("doc_id", F.col("claim_id").alias("src"), F.posexplode("operands").alias("pos", "value")).withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + bin_of(F.col("value")))))
    out = claims.filter(F.col("operation").isin(*DERIVED)).select("doc_id", F.col("claim_id").alias("dst"), F.col("stated_value").alias("v")).withColumn("bin", bin_of(F.col("v")))
    known = source_numbers.select("doc_id", F.col("value").alias("s")).distinct().withColumn("bin", bin_of(F.col("s")))
    grounded = ops.join(known, ["doc_id", "bin"]).filter(near(F.col("value"), F.col("s"))).select("doc_id", "src", "pos").distinct()
    hit = ops.join(out, ["doc_id", "bin"]).filter((F.col("src") != F.col("dst")) & near(F.col("value"), F.col("v"))).select("doc_id", "src", "pos", "dst").distinct()
    only = hit.join(grounded, ["doc_id", "src", "pos"], "left_anti").groupBy("doc_id", "src", "pos").agg(F.min("dst").alias("dst"), F.max("dst").alias("other"))
    return only.filter("dst = other").select("doc_id", "src", "dst").distinct()


def linked(claims: DataFrame, source_numbers: DataFrame) -> DataFrame:
    """derived_links without edges that would close a cycle with those that claims name already (depends_on, by claim_id), or with earlier ones.
    claims: doc_id, claim_id, ord, operation, stated_value, operands array<double>, depends_on."""
    new = derived_links(claims, source_numbers)
    given = claims.select("doc_id", F.col("claim_id").alias("src"), F.explode("depends_on").alias("dst"))
    known = claims.select("doc_id", F.col("claim_id").alias("src"), F.col("ord").alias("rank"))
    return graph.without_cycles(new.join(known, ["doc_id", "src"]), given)


def latest_ratio(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """(entity, end, value): the ratio in percent at the latest end that both have."""
    n, d = numerator.select("entity", "end", F.col("val").alias("n")), denominator.select("entity", "end", F.col("val").alias("d"))
    return n.join(d, ["entity", "end"]).groupBy("entity").agg(F.max("end").alias("end"), F.max_by(F.try_divide("n", "d") * 100, "end").alias("value"))


def gated(peers: DataFrame, low: float, high: float, stale: int = STALE_DAYS, least: int = MIN_PEERS) -> DataFrame:
    """Peers (group, entity, end, value) with exclude_reason, the group's state, z of those included and whether that is an outlier. Groups are
    aggregated and joined back, so that a hot group is never one task's window."""
    latest = peers.filter("value is not null").groupBy("group").agg(F.max("end").alias("__latest"))
    reason = F.when(F.col("value").isNull(), "no_value").when(F.datediff("__latest", "end") > stale, "stale").when(~F.col("value").between(low, high), "out_of_band")
    x = peers.join(latest, "group", "left").withColumn("exclude_reason", reason).drop("__latest").withColumn("included", F.col("exclude_reason").isNull())
    own = F.when(F.col("included"), F.col("value"))
    x = x.join(x.groupBy("group").agg(F.count(own).alias("n_included"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("sd")), "group")
    z = F.when(F.col("included") & (F.col("n_included") >= least), F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))
    return x.withColumns({"state": F.when(F.col("n_included") >= least, "compared").otherwise("declined"), "zscore": z}).withColumns({"outlier_strict": F.coalesce(F.abs("zscore") > SIGMA, F.lit(False)), "outlier": F.coalesce(F.abs(F.bround("zscore", 2)) >= SIGMA, F.lit(False))})


#: Metrics of peers, with the concepts they divide, the band of sane values and the industries where they do not compare.
METRICS = [("net_margin", "net_income", "revenue", -100.0, 100.0, ("6798", "6331", "6021", "6311", "6141", "6162")), ("return_on_assets", "net_income", "assets", -60.0, 60.0, ()), ("debt_ratio", "liabilities", "assets", 0.0, 200.0, ())]


def grouped(entities: DataFrame) -> DataFrame:
    """(group, members, viable): entities (entity, sic) by industry code, without one UNKNOWN; viable groups are known and have peers enough."""
    g = entities.select("entity", F.coalesce(F.nullif(F.trim("sic"), F.lit("")), F.lit("UNKNOWN")).alias("group")).groupBy("group").agg(F.count_distinct("entity").alias("members"))
    return g.withColumn("viable", (F.col("group") != "UNKNOWN") & (F.col("members") >= MIN_PEERS))


def sweep(points: DataFrame, entities: DataFrame) -> DataFrame:
    """(metric, group, entity, end, value, exclude_reason, zscore, outlier, decline_reason): every metric over every viable group. points: entity, concept,
    end, val; entities: entity, sic. Filers without a value stay, with a reason."""
    viable = grouped(entities).filter("viable").select("group")
    members = entities.select("entity", F.trim("sic").alias("group")).join(viable, "group").distinct()
    out = None
    for metric, top, bottom, low, high, excluded in METRICS:
        side = lambda c: points.filter(F.col("concept") == c)
        own = members.join(latest_ratio(side(top), side(bottom)), "entity", "left")
        g = gated(own, low, high)
        declined = F.when(F.col("group").isin(*excluded) if excluded else F.lit(False), "not comparable").when(F.col("state") == "declined", "too few peers")
        part = g.select(F.lit(metric).alias("metric"), "group", "entity", "end", "value", "exclude_reason", F.bround("zscore", 2).alias("zscore"), "outlier", declined.alias("decline_reason"))
        out = part if out is None else out.unionByName(part)
    return out


def sweep_coverage(swept: DataFrame) -> DataFrame:
    """(metric, viable_groups, compared) of each metric, and of all together under any: groups that some metric compares."""
    per = swept.groupBy("metric").agg(F.count_distinct("group").alias("viable_groups"), F.count_distinct(F.when(F.col("decline_reason").isNull(), F.col("group"))).alias("compared"))
    return per.unionByName(swept.agg(F.lit("any").alias("metric"), F.count_distinct("group").alias("viable_groups"), F.count_distinct(F.when(F.col("decline_reason").isNull(), F.col("group"))).alias("compared")).select("metric", "viable_groups", "compared"))


def extremes(gate: DataFrame) -> DataFrame:
    """(group, winner, best, loser, worst) of the groups that compare; of equals the first by name."""
    x = gate.filter("state = 'compared' and included")
    first = lambda sign: F.min_by("entity", F.struct(sign * F.col("value"), "entity"))
    return x.groupBy("group").agg(first(-1).alias("winner"), F.max("value").alias("best"), first(1).alias("loser"), F.min("value").alias("worst"))


def highest_claims(gate: DataFrame, said: DataFrame) -> DataFrame:
    """Claims that a member has the highest value of its group (said: group, entity, and what else they carry), as the verifier reads them: the member's own value against
    the best of the other members that compare, which is one number whatever the group's size; a member that does not compare has no value, and its claim an operand
    that is missing."""
    x = gate.filter("state = 'compared' and included").select("group", "entity", "value")
    own = said.join(x.withColumnRenamed("value", "mine"), ["group", "entity"], "left")
    rest = said.select("group", "entity").distinct().join(x.select("group", F.col("entity").alias("__other"), "value"), "group").filter("entity <> __other").groupBy("group", "entity").agg(F.max("value").alias("others"))
    operand = lambda v: F.struct(v.alias("value"), F.when(v.isNull(), "missing").otherwise("grounded").alias("source"), F.lit(None).cast("string").alias("category"))
    values = F.when(F.col("others").isNull(), F.array(operand(F.col("mine")))).otherwise(F.array(operand(F.col("mine")), operand(F.col("others"))))
    claim = own.join(rest, ["group", "entity"], "left").withColumns({"operation": F.lit("superlative"), "superlative": F.lit("max"), "stated_value": F.lit(None).cast("double"), "operands": values, "periods": F.array(F.col("entity").cast("string"), F.lit("the others")), "target_period": F.col("entity").cast("string")})
    return claim.drop("mine", "others")


def superlatives(gate: DataFrame) -> DataFrame:
    """extremes with the verdicts of two claims: that the winner has the highest value, and, as a control, that the loser has; null where they are one."""
    gate = graph.cut(gate.select("group", "entity", "value", "state", "included"))  # read for the extremes and for both claims
    e = extremes(gate)
    said = e.select("group", F.col("winner").alias("entity"), F.lit("verdict").alias("kind")).unionByName(e.filter("winner <> loser").select("group", F.col("loser").alias("entity"), F.lit("control").alias("kind")))
    v = C.verify(highest_claims(gate, said)).groupBy("group").agg(*[F.max(F.when(F.col("kind") == k, F.col("status"))).alias(k) for k in ("verdict", "control")])
    return e.join(v, "group")


def buyback_crosscheck(buybacks: DataFrame, transactions: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, tag, end, value, transactions, acquisition, disposition, other, net_disposition, status) of each entity: repurchases against insiders'
    flows. buybacks: entity, tag, tag_rank, end, val (points of several tags; the first tag that has any counts, at its latest end);
    transactions: entity, direction, shares."""
    b = buybacks.groupBy("entity").agg(F.max_by(F.struct("tag", "end", F.col("val").alias("value")), F.struct(-F.col("tag_rank"), F.col("end"))).alias("b")).select("entity", "b.*")
    own = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("shares"))), F.lit(0.0)).alias(d)
    t = transactions.groupBy("entity").agg(F.count("*").alias("transactions"), own("acquisition"), own("disposition"), own("other"))
    x = entities.select("entity").distinct().join(b, "entity", "left").join(t, "entity", "left")
    x = x.withColumns({"transactions": F.coalesce("transactions", F.lit(0)), **{d: F.coalesce(d, F.lit(0.0)) for d in ("acquisition", "disposition", "other")}}).withColumn("net_disposition", F.col("disposition") - F.col("acquisition"))
    return x.withColumn("status", F.when(F.col("value").isNull() | (F.col("transactions") == 0), K.INSUFFICIENT).when((F.col("value") > 0) & (F.col("net_disposition") > 0), "FACTUAL_DIVERGENCE_REVIEW").otherwise("FACTUAL_CONTEXT"))
