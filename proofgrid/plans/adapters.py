"""The driver's tables as the engine's inputs, with planted errors by key; SQL is the same projection for the oracle.

Sums are exact decimals before they become doubles, so partial sums in any order give the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exact(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that much is made of, over all shuffle partitions by a key. By number, as Spark joins other partitions by their compressed bytes, which are few before rows are multiplied."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, entity, fy, v, n): yearly revenue and orders of each nation. Orders are added up by customer before nations join, so the join is small."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    x = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", "fy").agg(F.sum("s").cast("double").alias("v"), F.sum("n").alias("n"))
    return x.join(n, x["c_nationkey"] == n["n_nationkey"]).select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("entity"), "fy", "v", "n")


REVENUE = """rev AS (SELECT n_nationkey::BIGINT AS k, n_name AS entity, year(o_orderdate)::INT AS fy, SUM(o_totalprice::DECIMAL(18,2))::DOUBLE AS v, count(*)::BIGINT AS n
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
OPS = ("percent_change", "absolute_change", "difference", "ratio", "margin_percent", "sum", "average", "product", "identity")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar claims: two years of a nation, one of nine operations by key, and planted faults by key."""
    r = revenue(spark, sf_dir).withColumn("old", F.lag("v").over(Window.partitionBy("k").orderBy("fy"))).filter("old is not null")
    key = F.col("k") * 31 + F.col("fy")
    r = r.withColumn("key", key).withColumn("operation", F.get(F.array(*map(F.lit, OPS)), (F.col("key") % 9).cast("int")))
    old = F.when(F.col("key") % 17 == 3, 0.0).when(F.col("key") % 19 == 5, float("nan")).otherwise(F.col("old"))
    vals = F.when(F.col("operation") == "identity", F.array(old)).when(F.col("key") % 23 == 1, F.array(old, F.col("v"), F.col("v"))).otherwise(F.array(old, F.col("v")))
    source = F.when(F.col("key") % 5 == 0, "missing").otherwise("grounded")
    op, a, b = F.col("operation"), F.col("old"), F.col("v")
    true = F.when(op == "percent_change", (b - a) / a * 100).when(op == "absolute_change", b - a).when(op == "difference", a - b).when(op == "ratio", a / b).when(op == "margin_percent", a / b * 100).when(op == "sum", a + b).when(op == "average", (a + b) / 2).when(op == "product", a * b).otherwise(a)
    stated = F.when(F.col("key") % 11 != 2, F.when(F.col("key") % 3 == 1, true * 1.25 + 1).otherwise(true))
    operands = F.transform(vals, lambda x: F.struct(x.alias("value"), source.alias("source"), F.lit(None).cast("string").alias("category")))
    return r.select(F.col("entity").alias("doc_id"), F.col("fy").cast("long").alias("claim_id"), "key", "operation", operands.alias("operands"), stated.alias("stated_value"))


CLAIMS = REVENUE + f""", lagged AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY fy) AS old, k * 31 + fy AS key FROM rev),
named AS (SELECT *, [{', '.join(f"'{x}'" for x in OPS)}][(key % 9 + 1)::INT] AS operation, CASE WHEN key % 17 = 3 THEN 0.0 WHEN key % 19 = 5 THEN 'nan'::DOUBLE ELSE old END AS a0 FROM lagged WHERE old IS NOT NULL),
stated AS (SELECT *, CASE WHEN operation = 'identity' THEN [a0] WHEN key % 23 = 1 THEN [a0, v, v] ELSE [a0, v] END AS vals,
 CASE operation WHEN 'percent_change' THEN (v - old) / old * 100 WHEN 'absolute_change' THEN v - old WHEN 'difference' THEN old - v WHEN 'ratio' THEN old / v WHEN 'margin_percent' THEN old / v * 100 WHEN 'sum' THEN old + v WHEN 'average' THEN (old + v) / 2 WHEN 'product' THEN old * v ELSE old END AS truth FROM named),
claims AS (SELECT entity AS doc_id, fy::BIGINT AS claim_id, key, operation, vals, key % 5 = 0 AS missing, CASE WHEN key % 11 <> 2 THEN CASE WHEN key % 3 = 1 THEN truth * 1.25 + 1 ELSE truth END END AS stated_value FROM stated),
calc AS (SELECT *, CASE operation WHEN 'percent_change' THEN CASE WHEN vals[1] <> 0 THEN (vals[2] - vals[1]) / vals[1] * 100 END WHEN 'absolute_change' THEN vals[2] - vals[1] WHEN 'difference' THEN vals[1] - vals[2]
 WHEN 'ratio' THEN CASE WHEN vals[2] <> 0 THEN vals[1] / vals[2] END WHEN 'margin_percent' THEN CASE WHEN vals[2] <> 0 THEN vals[1] / vals[2] * 100 END WHEN 'sum' THEN list_sum(vals) WHEN 'average' THEN list_sum(vals) / len(vals) WHEN 'product' THEN list_product(vals) ELSE vals[1] END AS c FROM claims),
verdicts AS (SELECT doc_id, claim_id, key, operation, stated_value, vals, missing, CASE WHEN missing THEN 'UNSUPPORTED_NUMBER' WHEN stated_value IS NULL OR len(list_filter(vals, lambda x: isnan(x))) > 0 OR c IS NULL
 OR (operation = 'identity' AND len(vals) <> 1) OR (operation IN ('sum', 'average', 'product') AND len(vals) < 2) OR (operation NOT IN ('identity', 'sum', 'average', 'product') AND len(vals) <> 2) THEN 'AMBIGUOUS'
 WHEN CASE WHEN operation IN ('percent_change', 'margin_percent') THEN abs(stated_value - c) <= 0.5 ELSE abs(stated_value - c) / greatest(abs(c), 1e-9) <= 0.005 END THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status, c FROM calc)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, assets, liabilities, equity, income, shares, cash): statement figures of each part, with planted gaps."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(
        exact("l_extendedprice").alias("assets"), exact(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)).alias("liabilities"), exact(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).otherwise(0)).alias("equity"), exact("l_quantity").alias("shares")
    )
    k = F.col("key")
    return x.select("key", (F.col("assets") * F.when(k % 4 == 1, 1.05).otherwise(1.0)).alias("assets"), F.when(k % 29 == 0, 0.0).otherwise(F.col("liabilities")).alias("liabilities"), "equity", F.col("equity").alias("income"), "shares")


STATEMENTS = """st0 AS (SELECT l_partkey AS key, SUM(l_extendedprice::DECIMAL(18,2))::DOUBLE AS a, SUM(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END::DECIMAL(18,2))::DOUBLE AS l,
 SUM(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END::DECIMAL(18,2))::DOUBLE AS e, SUM(l_quantity::DECIMAL(18,2))::DOUBLE AS shares FROM lineitem GROUP BY 1),
st AS (SELECT key, a * CASE WHEN key % 4 = 1 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS assets, CASE WHEN key % 29 = 0 THEN 0.0::DOUBLE ELSE l END AS liabilities, e AS equity, e AS income, shares FROM st0)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged facts: a customer's yearly order sums under three tags, some filed twice, some with odd spans, some again in another currency and
    filed later, some of a quarter after the year."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.year(F.col("o_orderdate").cast("date")).alias("fy"), "o_totalprice", "o_orderkey")
    y = o.groupBy("entity", "fy").agg(exact("o_totalprice").alias("val"), F.max("o_orderkey").alias("pos"))
    y, k, pos = dealt(y, "entity"), F.col("entity").cast("long"), F.col("pos")
    tag = F.when(k % 5 == 0, "SalesRevenueNet").when(k % 7 == 0, "Assets").otherwise("Revenues")
    end, after = F.make_date("fy", F.lit(12), F.lit(31)), F.col("fy") + 1
    start = F.when(k % 7 == 0, F.lit(None).cast("date")).when((k + F.col("fy")) % 6 == 0, F.make_date("fy", F.lit(7), F.lit(1))).otherwise(F.make_date("fy", F.lit(1), F.lit(1)))
    year = {"unit": F.lit("USD"), "start": start, "end": end, "val": F.col("val"), "fp": F.lit("FY"), "form": F.lit("10-K"), "filed": F.date_add(end, 60), "pos": pos}
    fact = lambda when, **other: F.when(when, F.struct(*[c.alias(name) for name, c in {**year, **other}.items()]))
    every = F.array_compact(F.array(
        fact(F.lit(True)), fact(pos % 3 == 0, val=F.col("val") + 100, filed=F.date_add(end, 425), pos=pos + 1), fact(pos % 5 == 1, val=F.col("val") * 0.5, unit=F.lit("EUR"), filed=F.date_add(end, 460)),
        fact(pos % 4 == 1, val=F.col("val") * 0.25, start=F.make_date(after, F.lit(1), F.lit(1)), end=F.make_date(after, F.lit(3), F.lit(31)), form=F.lit("10-Q"), fp=F.lit("Q1"), filed=F.date_add(end, 180)),
    ))
    return y.select("entity", tag.alias("tag"), "fy", F.inline(every)).select("entity", "tag", "unit", "start", "end", "val", "fy", "fp", "form", "filed", "pos")


FACTS = """y AS (SELECT o_custkey::VARCHAR AS entity, o_custkey AS k, year(o_orderdate)::INT AS fy, SUM(o_totalprice::DECIMAL(18,2))::DOUBLE AS val, max(o_orderkey) AS pos FROM orders GROUP BY 1, 2, 3),
f0 AS (SELECT entity, CASE WHEN k % 5 = 0 THEN 'SalesRevenueNet' WHEN k % 7 = 0 THEN 'Assets' ELSE 'Revenues' END AS tag, 'USD' AS unit, CASE WHEN k % 7 = 0 THEN NULL WHEN (k + fy) % 6 = 0 THEN make_date(fy, 7, 1) ELSE make_date(fy, 1, 1) END AS start_d,
 make_date(fy, 12, 31) AS end_d, val, fy, '10-K' AS form, make_date(fy, 12, 31) + 60 AS filed, pos FROM y),
facts AS (SELECT * FROM f0 UNION ALL SELECT entity, tag, unit, start_d, end_d, val + 100, fy, form, filed + 365, pos + 1 FROM f0 WHERE pos % 3 = 0
 UNION ALL SELECT entity, tag, 'EUR', start_d, end_d, val * 0.5::DOUBLE, fy, form, filed + 400, pos FROM f0 WHERE pos % 5 = 1
 UNION ALL SELECT entity, tag, unit, make_date(fy + 1, 1, 1), make_date(fy + 1, 3, 31), val * 0.25::DOUBLE, fy, '10-Q', filed + 120, pos FROM f0 WHERE pos % 4 = 1),
fits AS (SELECT *, start_d IS NULL OR CASE form WHEN '10-Q' THEN end_d - start_d BETWEEN 80 AND 100 ELSE end_d - start_d BETWEEN 340 AND 380 END AS fit FROM facts),
pts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, tag, unit, form, end_d ORDER BY filed DESC, pos DESC) AS rn FROM fits WHERE fit) WHERE rn = 1)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of whole filings: the fields of a balance sheet, earnings and cash of each customer and year, some left out, some wrong, some under
    fallback tags, and beside them other forms, currencies and years."""
    o = table(spark, sf_dir, "orders")
    y = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("fy")).agg(exact("o_totalprice").alias("v"), F.count("*").alias("n"), F.max("o_orderkey").alias("pos"))
    y, k, v = dealt(y, "k"), F.col("k"), F.col("v")
    income = (F.col("n") * 1000).cast("double")
    common = income - 50
    shares = (100 + k % 50).cast("double")
    base = F.when(k % 6 == 0, common).otherwise(income)
    eps = F.floor(base / shares * F.when(k % 9 == 1, 1.1).otherwise(1.0) * 100).cast("double") / 100
    nci = "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"
    equity = v * 0.4 * F.when(k % 11 == 0, 0.9).when(k % 13 == 0, 0.8).otherwise(1.0)
    end = F.make_date("fy", F.lit(12), F.lit(31))
    wide = y.withColumn("last", F.max("fy").over(Window.partitionBy("k")))
    fact = lambda tag, value, unit="USD", lasts=False, when=None: F.when(when if when is not None else F.lit(True), F.struct((tag if isinstance(tag, Column) else F.lit(tag)).alias("tag"), value.alias("val"), F.lit(unit).alias("unit"), F.lit(lasts).alias("lasts")))
    every = F.array_compact(F.array(
        fact("Assets", v), fact("Liabilities", v * 0.6, when=(k % 7 != 0) & ~((k % 8 == 3) & (F.col("fy") == F.col("last")))), fact(F.when(k % 5 == 0, nci).otherwise("StockholdersEquity"), equity),
        fact("RedeemableNoncontrollingInterestEquityCarryingAmount", v * 0.04, when=k % 11 == 0), fact("NetIncomeLoss", income, lasts=True), fact("NetIncomeLossAvailableToCommonStockholdersBasic", common, lasts=True, when=k % 6 == 0),
        fact("EarningsPerShareBasic", eps, "USD/shares", True), fact("WeightedAverageNumberOfSharesOutstandingBasic", shares, "shares", True), fact("EarningsPerShareDiluted", eps, "USD/shares", True, k % 2 == 0), fact("WeightedAverageNumberOfDilutedSharesOutstanding", shares + F.when(k % 4 == 0, 0.0).otherwise(1.0), "shares", True, k % 2 == 0),
        fact("CashAndCashEquivalentsAtCarryingValue", v * 0.1), fact("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", v * 0.1 + (k % 2) * 10, when=k % 3 == 0),
    ))
    x = wide.select("k", "fy", "pos", F.inline(every))
    rows = x.select(F.col("k").cast("string").alias("entity"), F.lit("us-gaap").alias("taxonomy"), "tag", "unit", F.when(F.col("lasts"), F.make_date("fy", F.lit(1), F.lit(1))).alias("start"), end.alias("end"), "val", "fy", F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.date_add(end, 60).alias("filed"), "pos")
    quarter = rows.withColumns({"val": F.col("val") * 0.3, "end": F.make_date(F.col("fy") + 1, F.lit(3), F.lit(31)), "start": F.when(F.col("start").isNotNull(), F.make_date(F.col("fy") + 1, F.lit(1), F.lit(1))), "form": F.lit("10-Q")})
    euro = rows.filter("unit = 'USD' and pos % 3 = 0").withColumns({"val": F.col("val") * 2, "unit": F.lit("EUR"), "filed": F.date_add("filed", 9)})
    return rows.unionByName(quarter).unionByName(euro)


TAGGED = """w0 AS (SELECT o_custkey AS k, year(o_orderdate)::INT AS fy, SUM(o_totalprice::DECIMAL(18,2))::DOUBLE AS v, count(*) AS n FROM orders GROUP BY 1, 2),
w1 AS (SELECT *, (n * 1000)::DOUBLE AS income, (n * 1000 - 50)::DOUBLE AS common, (100 + k % 50)::DOUBLE AS shares, v * 0.4::DOUBLE * CASE WHEN k % 11 = 0 THEN 0.9::DOUBLE WHEN k % 13 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS equity FROM w0),
w2 AS (SELECT *, floor(CASE WHEN k % 6 = 0 THEN common ELSE income END / shares * CASE WHEN k % 9 = 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * 100)::DOUBLE / 100 AS eps, row_number() OVER (PARTITION BY k ORDER BY fy DESC) AS rn FROM w1),
filer AS (SELECT k, k::VARCHAR AS entity, make_date(fy, 12, 31) AS period_end, v AS assets, CASE WHEN k % 7 <> 0 AND k % 8 <> 3 THEN v * 0.6::DOUBLE END AS liabilities, equity, CASE WHEN k % 11 = 0 THEN v * 0.04::DOUBLE END AS temp_equity, income AS net_income_total,
 CASE WHEN k % 6 = 0 THEN common END AS net_income_to_common, eps AS eps_basic, CASE WHEN k % 2 = 0 THEN eps END AS eps_diluted, shares AS shares_basic, CASE WHEN k % 2 = 0 THEN shares + CASE WHEN k % 4 = 0 THEN 0.0 ELSE 1.0 END END AS shares_diluted,
 v * 0.1::DOUBLE AS bs_cash, CASE WHEN k % 3 = 0 THEN v * 0.1::DOUBLE + (k % 2) * 10 ELSE v * 0.1::DOUBLE END AS cf_cash FROM w2 WHERE rn = 1)"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, edges): the n-th order of a customer depends on the order n / 2, every fifth also on the one 3 before; statuses by key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    r = o.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")).cast("long"))
    status = F.when(F.col("o_orderkey") % 13 == 1, "WRONG_MATH").when(F.col("o_orderkey") % 17 == 1, "UNSUPPORTED_NUMBER").when(F.col("o_orderkey") % 7 == 1, "INSUFFICIENT_EVIDENCE").otherwise("VERIFIED")
    v = r.select("doc_id", F.col("ord").alias("node"), "ord", status.alias("status"))
    e = r.filter("ord > 1").select("doc_id", F.col("ord").alias("src"), F.floor(F.col("ord") / 2).cast("long").alias("dst"))
    cross = r.filter("ord % 5 = 0").select("doc_id", F.col("ord").alias("src"), (F.col("ord") - 3).alias("dst"))
    return v, e.unionByName(cross)


TREE = """r AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders),
v AS (SELECT doc_id, ord AS node, ord, CASE WHEN o_orderkey % 13 = 1 THEN 'WRONG_MATH' WHEN o_orderkey % 17 = 1 THEN 'UNSUPPORTED_NUMBER' WHEN o_orderkey % 7 = 1 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'VERIFIED' END AS status FROM r),
e AS (SELECT doc_id, ord AS src, ord // 2 AS dst FROM r WHERE ord > 1 UNION SELECT doc_id, ord, ord - 3 FROM r WHERE ord % 5 = 0),
reach AS (SELECT doc_id, dst AS root, src AS node, 1 AS dist FROM e UNION SELECT reach.doc_id, root, e.src, dist + 1 FROM reach JOIN e ON e.doc_id = reach.doc_id AND e.dst = reach.node),
near AS (SELECT doc_id, root, node, min(dist) AS dist FROM reach GROUP BY 1, 2, 3)"""
