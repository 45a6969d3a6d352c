"""Queries of audits, claim graphs, gold evaluation, answers and dashboards. Claims are built from every order: a customer is a document, an order a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T
from proofgrid.operators import answers, audit, compare, dashboards, gold, graph, series
from proofgrid.operators import claims as C
from proofgrid.operators import facts as X
from proofgrid.sources import claims_json, store, tables

from . import adapters as A
from .base import query
from .queries import CONFLICTS, HALF, TAG_ROWS, cells, tags

OPS = ("sum", "difference", "percent_change", "ratio", "identity")


def order_claims(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ord, key, p, q, operation, stated, missing, node_id, depends_on) of every order after a customer's first: one of five operations over it and
    the one before, some wrong, some without a value or an operand, some that name claims which are not there or have no name."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("p"), F.lag("o_totalprice").over(w).alias("q"), (F.row_number().over(w) - 1).cast("long").alias("ord")).filter("ord >= 1")
    k, p, q, n = F.col("key"), F.col("p"), F.col("q"), F.col("ord")
    truth = F.when(k % 5 == 0, q + p).when(k % 5 == 1, q - p).when(k % 5 == 2, (p - q) / q * 100).when(k % 5 == 3, q / p).otherwise(p)
    stated = F.when(k % 13 != 5, F.when(k % 7 == 3, truth * 1.1 + 1).otherwise(truth))
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))
    deps = F.concat(F.when(n > 1, F.array(name(F.floor(n / 2)))).otherwise(F.array().cast("array<string>")), F.when(k % 17 == 2, F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>")))
    return o.select("doc_id", "ord", "key", "p", "q", F.get(F.array(*map(F.lit, OPS)), (k % 5).cast("int")).alias("operation"), stated.alias("stated"), (k % 11 == 4).alias("missing"), F.when(k % 19 != 3, name(n)).alias("node_id"), deps.alias("depends_on"))


def operands(values: list[Column], missing: Column) -> Column:
    return F.array(*[F.struct(v.alias("value"), F.when(missing, "missing").otherwise("grounded").alias("source"), F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("string").alias("category")) for v in values])


def typed_claims(spark: SparkSession, sf: str) -> DataFrame:
    c = order_claims(spark, sf)
    p, q, m = F.col("p"), F.col("q"), F.col("missing")
    return c.select("doc_id", "ord", "key", "operation", F.when(F.col("operation") == "identity", operands([p], m)).otherwise(operands([q, p], m)).alias("operands"), F.col("stated").alias("stated_value"), "node_id", "depends_on")


def claim_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(summaries, sources): what a model would have answered of each customer, and the text it answered from."""
    c = order_claims(spark, sf)
    one = F.struct(F.concat(F.lit("order "), F.col("key").cast("string")).alias("claim_text"), F.upper("operation").alias("operation"), F.col("stated").alias("stated_value"), F.when(F.col("operation") == "identity", F.array("p")).otherwise(F.array("q", "p")).alias("v"), "missing", "node_id", "depends_on")
    item = F.to_json(one.dropFields("v", "missing").withField("operands", F.transform(one["v"], lambda v: F.struct(v.alias("value"), F.when(F.col("missing"), "missing").otherwise("grounded").alias("source")))))
    raw = c.groupBy("doc_id").agg(F.concat(F.lit("```json\n["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("j")))), lambda x: x["j"]), ", "), F.lit("]\n```")).alias("raw"))
    o = A.table(spark, sf, "orders")
    text = o.groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("Total $"), F.format_number("o_totalprice", 2)))), "; ").alias("text"))
    return raw, text


ORDERS = """o1 AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS key, o_totalprice AS p, lag(o_totalprice) OVER w AS q, row_number() OVER w - 1 AS ord FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
oc AS (SELECT *, ['sum', 'difference', 'percent_change', 'ratio', 'identity'][(key % 5 + 1)::INT] AS operation, CASE key % 5 WHEN 0 THEN q + p WHEN 1 THEN q - p WHEN 2 THEN (p - q) / q * 100 WHEN 3 THEN q / p ELSE p END AS truth FROM o1 WHERE ord >= 1),
os AS (SELECT *, CASE WHEN key % 13 <> 5 THEN CASE WHEN key % 7 = 3 THEN truth * 1.1::DOUBLE + 1 ELSE truth END END AS stated FROM oc),
ov AS (SELECT *, CASE WHEN key % 11 = 4 THEN 'UNSUPPORTED_NUMBER' WHEN stated IS NULL THEN 'AMBIGUOUS' WHEN CASE WHEN operation = 'percent_change' THEN abs(stated - truth) <= 0.5 ELSE abs(stated - truth) / greatest(abs(truth), 1e-9) <= 0.005 END THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS status,
 CASE WHEN key % 19 <> 3 THEN 'n' || ord WHEN ord > 1 OR key % 17 = 2 THEN '__anon_' || ord END AS node, key % 19 <> 3 AS named FROM os),
oe AS (SELECT DISTINCT a.doc_id, a.node AS src, b.node AS dst FROM ov a JOIN ov b ON a.doc_id = b.doc_id AND b.ord = a.ord // 2 AND b.named WHERE a.ord > 1),
reach AS (SELECT doc_id, dst AS root, src AS node, 1 AS dist FROM oe UNION SELECT reach.doc_id, root, oe.src, dist + 1 FROM reach JOIN oe ON oe.doc_id = reach.doc_id AND oe.dst = reach.node),
near AS (SELECT doc_id, root, node, min(dist) AS dist FROM reach GROUP BY 1, 2, 3),
cause AS (SELECT near.doc_id, near.node, near.root, row_number() OVER (PARTITION BY near.doc_id, near.node ORDER BY dist, r.ord) AS rn FROM near JOIN ov r ON r.doc_id = near.doc_id AND r.node = near.root WHERE r.status IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER')),
od AS (SELECT doc_id, root AS node, count(*) AS down FROM near GROUP BY 1, 2),
op AS (SELECT ov.*, CASE WHEN status IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER') OR c.root IS NULL THEN status ELSE 'PROPAGATED_ERROR' END AS final, CASE WHEN status NOT IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER') THEN c.root END AS caused_by, coalesce(down, 0) AS down
 FROM ov LEFT JOIN cause c ON c.doc_id = ov.doc_id AND c.node = ov.node AND c.rn = 1 LEFT JOIN od ON od.doc_id = ov.doc_id AND od.node = ov.node),
osc AS (SELECT *, CASE final WHEN 'VERIFIED' THEN 1.0::DOUBLE WHEN 'WRONG_MATH' THEN 0.0 WHEN 'UNSUPPORTED_NUMBER' THEN 0.4 WHEN 'AMBIGUOUS' THEN 0.4 END AS w, 1 + ln(1 + down) AS t FROM op)"""
SCORE = "count(w)::BIGINT AS total_checkable, round_even(coalesce(sum(w * t) / sum(CASE WHEN w IS NOT NULL THEN t END), 0) * 100, 1) AS score, round_even(coalesce(avg(w), 0) * 100, 1) AS unweighted_score"


# Graphs.


@query("graph_edges", f"WITH RECURSIVE {ORDERS} SELECT doc_id, src, dst FROM oe")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(order_claims(spark, sf))


@query("missing_references", f"WITH RECURSIVE {ORDERS}, d AS (SELECT doc_id, ord, node, 'n' || (ord // 2) AS dst FROM ov WHERE ord > 1 UNION SELECT doc_id, ord, node, 'zz' FROM ov WHERE key % 17 = 2) SELECT d.doc_id, d.node AS src, d.dst FROM d WHERE NOT EXISTS (SELECT 1 FROM ov b WHERE b.doc_id = d.doc_id AND b.named AND b.node = d.dst)")
def missing_references(spark: SparkSession, sf: str) -> DataFrame:
    return graph.missing_references(order_claims(spark, sf))


@query("graph_roots", f"WITH RECURSIVE {ORDERS} SELECT doc_id, node FROM ov WHERE node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM oe WHERE oe.doc_id = ov.doc_id AND oe.src = ov.node)")
def graph_roots(spark: SparkSession, sf: str) -> DataFrame:
    c = order_claims(spark, sf)
    return graph.roots(c.select("doc_id", graph.node_of().alias("node")).filter("node is not null"), graph.edges(c))


@query("graph_dependents", f"WITH RECURSIVE {ORDERS} SELECT v.doc_id, v.node, oe.src AS dependent FROM ov v JOIN oe ON oe.doc_id = v.doc_id AND oe.dst = v.node WHERE v.status = 'WRONG_MATH'")
def graph_dependents(spark: SparkSession, sf: str) -> DataFrame:
    c = typed_claims(spark, sf)
    of = C.verify(c).filter(F.col("status") == K.WRONG).select("doc_id", graph.node_of().alias("node")).filter("node is not null")
    return graph.dependents(graph.edges(c), of)


@query("graph_measured", f"""WITH RECURSIVE {ORDERS}, n AS (SELECT doc_id, ord, key, CASE WHEN key % 19 <> 3 THEN 'n' || ord ELSE 'claim-' || (ord + 1) END AS node FROM ov), d AS (SELECT doc_id, node, 'n' || (ord // 2) AS dst FROM n WHERE ord > 1 UNION ALL SELECT doc_id, node, 'zz' FROM n WHERE key % 17 = 2),
j AS (SELECT d.*, EXISTS (SELECT 1 FROM n b WHERE b.doc_id = d.doc_id AND b.node = d.dst) AS there FROM d), e AS (SELECT doc_id, count(*) FILTER (there) AS edges, count(*) FILTER (NOT there) AS missing, count(DISTINCT node) FILTER (there) AS up, count(DISTINCT dst) FILTER (there) AS down FROM j GROUP BY 1)
SELECT n.doc_id, count(*)::BIGINT AS claims, coalesce(any_value(edges), 0)::BIGINT AS edges, coalesce(any_value(up), 0)::BIGINT AS with_upstream, coalesce(any_value(down), 0)::BIGINT AS with_downstream, count(*) FILTER (key % 2 = 0)::BIGINT AS with_evidence, coalesce(any_value(missing), 0)::BIGINT AS missing_refs FROM n LEFT JOIN e USING (doc_id) GROUP BY 1""")
def graph_measured(spark: SparkSession, sf: str) -> DataFrame:
    return graph.measured(order_claims(spark, sf).withColumn("source_text", F.when(F.col("key") % 2 == 0, "t")))


@query("fault_injection", f"""WITH RECURSIVE {ORDERS}, own AS (SELECT near.doc_id, near.node, min((dist, r.ord)) AS best FROM near JOIN ov r ON r.doc_id = near.doc_id AND r.node = near.root WHERE r.status IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER') GROUP BY 1, 2)
SELECT near.doc_id, near.root, count(*) FILTER (v.status NOT IN ('WRONG_MATH', 'UNSUPPORTED_NUMBER') AND (own.best IS NULL OR (near.dist, r.ord) <= own.best))::BIGINT AS relabelled
FROM near JOIN ov v ON v.doc_id = near.doc_id AND v.node = near.node JOIN ov r ON r.doc_id = near.doc_id AND r.node = near.root LEFT JOIN own ON own.doc_id = near.doc_id AND own.node = near.node GROUP BY 1, 2""")
def fault_injection(spark: SparkSession, sf: str) -> DataFrame:
    c = typed_claims(spark, sf)
    v = C.verify(c).select("doc_id", graph.node_of().alias("node"), "ord", "status").filter("node is not null")
    return graph.injected(v, graph.cut(graph.edges(c)))


GUARD = "o AS (SELECT o_custkey AS doc_id, o_orderkey % 2 = 0 AS even, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


def in_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n, key, most): a customer's orders, numbered from 1, with the number of all."""
    w = Window.partitionBy("o_custkey")
    o = A.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("n"), F.col("o_orderkey").alias("key"), F.count("*").over(w).alias("most"))


@query("cycle_guard", f"""WITH {GUARD} SELECT doc_id, n AS src, n - 1 AS dst FROM o WHERE n > 1 AND n % 4 <> 1
UNION ALL SELECT doc_id, n, n - 1 FROM o WHERE n > 1 AND n % 4 = 1 AND even
UNION ALL SELECT doc_id, n - 1, n FROM o WHERE n > 1 AND n % 4 = 1 AND NOT even
UNION ALL SELECT doc_id, n, n - 3 FROM o WHERE n > 4 AND n % 4 = 0""")
def cycle_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in a row depend on the one before, in blocks of four. Edges offered later: from the first of a block to its third (closes a cycle); from the first of a block to
    the last of the block before, where its key is even; from there back to it (closes a cycle just where the one before was offered); from the last to the first."""
    o = in_rows(spark, sf)
    edge = lambda where, src, dst, rank: o.filter(where).select("doc_id", F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(rank).alias("rank"))
    offered = edge("n > 1 and n % 4 <> 1", "n", "n - 1", 1).unionByName(edge("n % 4 = 3", "n - 2", "n", 2)).unionByName(edge("n > 1 and n % 4 = 1 and key % 2 = 0", "n", "n - 1", 3))
    return graph.without_cycles(offered.unionByName(edge("n > 1 and n % 4 = 1", "n - 1", "n", 4)).unionByName(edge("n > 4 and n % 4 = 0", "n", "n - 3", 5)))


@query("cycle_paths", """WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS most FROM orders),
e AS (SELECT doc_id, n AS src, n - 1 AS dst FROM o WHERE n > 1 AND key % 3 <> 0 UNION SELECT doc_id, n, n + 1 + key % 4 FROM o WHERE key % 5 = 0 AND n + 1 + key % 4 <= most UNION SELECT doc_id, n, (n + 3) // 2 FROM o WHERE key % 3 = 0 AND (n + 3) // 2 <= most AND n <> (n + 3) // 2),
reach AS (SELECT doc_id, src, dst FROM e UNION SELECT r.doc_id, r.src, e.dst FROM reach r JOIN e ON e.doc_id = r.doc_id AND e.src = r.dst),
c AS (SELECT doc_id, src AS node FROM reach WHERE src = dst),
f AS (SELECT e.doc_id, e.src AS node, min(e.dst) AS nxt FROM e JOIN c a ON a.doc_id = e.doc_id AND a.node = e.src JOIN c b ON b.doc_id = e.doc_id AND b.node = e.dst GROUP BY 1, 2),
w AS (SELECT doc_id, min(node) AS node, 0 AS step FROM c GROUP BY 1 UNION ALL SELECT w.doc_id, f.nxt, step + 1 FROM w JOIN f ON f.doc_id = w.doc_id AND f.node = w.node WHERE step < 200),
h AS (SELECT doc_id, min(node) AS head FROM w WHERE step >= 100 GROUP BY 1),
t AS (SELECT doc_id, head, min(step) AS t0 FROM w JOIN h USING (doc_id) WHERE step >= 100 AND node = head GROUP BY 1, 2),
u AS (SELECT doc_id, t0, min(step) AS t1 FROM w JOIN t USING (doc_id) WHERE node = head AND step > t0 GROUP BY 1, 2)
SELECT doc_id, string_agg(node::VARCHAR, ' -> ' ORDER BY step) AS path FROM w JOIN u USING (doc_id) WHERE step BETWEEN t0 AND t1 GROUP BY 1""")
def cycle_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle of each customer whose orders, by their keys, depend on each other in a circle."""
    o = in_rows(spark, sf)
    edge = lambda where, dst: o.filter(where).select("doc_id", F.col("n").alias("src"), F.expr(dst).cast("long").alias("dst"))
    every = edge("n > 1 and key % 3 <> 0", "n - 1").union(edge("key % 5 = 0 and n + 1 + key % 4 <= most", "n + 1 + key % 4")).union(edge("key % 3 = 0 and (n + 3) div 2 <= most and n <> (n + 3) div 2", "(n + 3) div 2"))
    return graph.cycle_paths(every.distinct()).select("doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("path"))


# Audits.


@query("audit_one", f"WITH RECURSIVE {ORDERS} SELECT doc_id, {SCORE}, count(*) FILTER (final = 'PROPAGATED_ERROR')::BIGINT AS n_propagated, 0::BIGINT AS dropped FROM osc GROUP BY 1")
def audit_one(spark: SparkSession, sf: str) -> DataFrame:
    """Model output to scores, document by document."""
    _, scores = audit.one(*claim_texts(spark, sf))
    return scores.select("doc_id", "total_checkable", "score", "unweighted_score", F.col("n_propagated_error").alias("n_propagated"), F.col("dropped_claims").cast("long").alias("dropped"))


@query("audit_results", f"WITH RECURSIVE {ORDERS} SELECT doc_id, ord::BIGINT AS ord, final AS status, caused_by, CASE WHEN status IN ('VERIFIED', 'WRONG_MATH') THEN truth END AS recomputed FROM op")
def audit_results(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verdicts(typed_claims(spark, sf)).select("doc_id", "ord", "status", "caused_by", "recomputed")


def sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, summaries, statements, cells) of segments with two filings each."""
    c = cells(spark, sf)
    n = F.length("set_id") % 3
    said = F.when(n == 0, " as restated ").when(n == 1, " reclassified ").otherwise(" plain ")
    plain = F.regexp_replace(F.col("value").try_cast("decimal(38, 12)").cast("string"), r"\.?0+$", "")
    docs = c.groupBy("set_id", "doc_id", "doc_ord").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("figure "), plain, said, F.repeat(F.lit("- "), 250)))), "\n").alias("text"))
    total = c.groupBy("set_id", "doc_id").agg(F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("t"))
    claim = lambda op, stated, values, more="": F.concat(F.lit(f'{{"claim_text": "c", "operation": "{op}", "stated_value": '), stated, F.lit(', "operands": ['), F.array_join(F.transform(values, lambda v: F.concat(F.lit('{"value": '), v.cast("string"), F.lit("}"))), ", "), F.lit("]" + more + "}"))
    t = F.col("t")
    statement = claim("internal_consistency", F.lit("null"), F.array(t, t * 0.5, t * 0.5), ', "rule_name": "balance_sheet_identity", "params": {"liabilities_complete": true}')
    missing = F.lit('{"claim_text": "c", "operation": "internal_consistency", "operands": [{"source": "missing"}], "rule_name": "cash_flow_tie_out"}')
    statements = total.select("doc_id", F.concat(F.lit("["), statement, F.lit(", "), missing, F.lit("]")).alias("raw"))
    summaries = total.groupBy("set_id").agg(F.max("t").alias("t")).select("set_id", F.concat(F.lit("["), claim("ratio", F.lit("0.5"), F.array(t, t * 2)), F.lit(", "), claim("sum", F.lit("1"), F.array(t, t)), F.lit(', {"operation": "sum"}]')).alias("raw"))
    return docs, summaries, statements, c


@query("audit_many", f"""WITH {CONFLICTS}, n AS (SELECT set_id, count(*) AS c FROM k GROUP BY 1), s AS (SELECT DISTINCT c_mktsegment AS set_id FROM customer)
SELECT set_id AS doc_id, 3::BIGINT AS n_verified, 1::BIGINT AS n_wrong, coalesce(c, 0)::BIGINT AS n_conflict, (4 + coalesce(c, 0))::BIGINT AS total_checkable, round_even(300.0::DOUBLE / (4 + coalesce(c, 0)), 1) AS score, 1::BIGINT AS dropped FROM s LEFT JOIN n USING (set_id)""")
def audit_many(spark: SparkSession, sf: str) -> DataFrame:
    """Two filings a set: claims of the summary, statements of each filing, and conflicts between them, in one score."""
    _, _, scores = audit.many(*sets(spark, sf))
    return scores.select("doc_id", "n_verified", F.col("n_wrong_math").alias("n_wrong"), "n_conflict", "total_checkable", "score", F.col("dropped_claims").cast("long").alias("dropped"))


@query("conflict_verdicts", f"""WITH {CONFLICTS} SELECT set_id, row, 'CONFLICT' AS status, value_a, value_b, doc_b, CASE length(set_id) % 3 WHEN 0 THEN 'EXPLICIT_RESTATEMENT' WHEN 1 THEN 'POSSIBLE_RECLASSIFICATION' ELSE 'UNEXPLAINED' END AS restatement_type, CASE length(set_id) % 3 WHEN 0 THEN 'EXPLICIT_RESTATEMENT (matched ''as restated'').' WHEN 1 THEN 'POSSIBLE_RECLASSIFICATION (matched ''reclassified'').' ELSE 'UNEXPLAINED.' END AS scan FROM k""")
def conflict_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, _, c = sets(spark, sf)
    v = compare.conflict_verdicts(compare.annotated(compare.conflicts(c, 0.005), docs.select("doc_id", "text")))
    return v.select("set_id", F.regexp_extract("claim_text", "conflict on '(.*?) / ", 1).alias("row"), "status", F.col("operands")[0]["value"].alias("value_a"), F.col("operands")[1]["value"].alias("value_b"), F.col("operands")[1]["doc_id"].alias("doc_b"), "restatement_type", F.regexp_extract("explanation", "scan: (.*)$", 1).alias("scan"))


@query("conflict_lookup", f"WITH {CONFLICTS} SELECT set_id, row, doc_a, value_a, doc_b, value_b FROM k WHERE row = 'n5' ORDER BY doc_a, doc_b, value_a, value_b LIMIT 1")
def conflict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return compare.conflict_for(compare.conflicts(cells(spark, sf), 0.005), " N5", "fy2001 ").select("set_id", "row", "doc_a", "value_a", "doc_b", "value_b")


@query("labelled_source", f"""WITH {A.REVENUE}, d AS (SELECT entity, fy, '=== DOCUMENT d' || fy || CASE fy % 4 WHEN 0 THEN ' (period: FY' || fy || ', type: 10-K)' WHEN 1 THEN ' (period: FY' || fy || ')' WHEN 2 THEN ' (type: 10-K)' ELSE '' END || ' ===' || chr(10) || 'orders ' || n AS t FROM rev) SELECT entity AS set_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY fy)) AS digest FROM d GROUP BY 1""")
def labelled_source(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("fy")
    d = A.revenue(spark, sf).select(F.col("entity").alias("set_id"), F.concat(F.lit("d"), y.cast("string")).alias("doc_id"), y.alias("doc_ord"), F.concat(F.lit(" orders "), F.col("n").cast("string"), F.lit(" ")).alias("text"), F.when(y % 4 < 2, F.concat(F.lit("FY"), y.cast("string"))).alias("period"), F.when(y % 4 == 2, "10-K").when(y % 4 == 0, "10-K").otherwise("").alias("doc_type"))
    return audit.labelled(d).select("set_id", F.md5("text").alias("digest"))


@query("serialised", f"""WITH RECURSIVE {ORDERS} SELECT doc_id, ord::BIGINT AS ord, final AS status, operation, CASE WHEN key % 11 = 4 THEN NULL ELSE CASE WHEN operation = 'identity' THEN p ELSE q END END AS first_value, CASE WHEN status IN ('VERIFIED', 'WRONG_MATH') THEN truth END AS recomputed FROM op""")
def serialised(spark: SparkSession, sf: str) -> DataFrame:
    v = audit.verdicts(typed_claims(spark, sf)).withColumns({n: F.lit(None).cast("string") for n in ("claim_text", "unit", "source_text")})
    v = v.withColumn("operands", F.transform("operands", lambda o: o.withField("source_span", F.lit(None).cast("array<int>")).withField("doc_id", F.lit("d"))))
    j = lambda p: F.get_json_object("json", p)
    return audit.serialised(v).select("doc_id", "ord", j("$.status").alias("status"), j("$.claim.operation").alias("operation"), j("$.claim.operands[0].value").cast("double").alias("first_value"), j("$.recomputed_value").cast("double").alias("recomputed"))


# Records and runs.


def statement_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(replays, documents): what a model found in the statements of each part's figures: a balance sheet, earnings and cash, with and without evidence."""
    s = A.dealt(A.statements(spark, sf), "key")
    k = F.col("key")
    num = lambda c: c.cast("string")
    claim = lambda rule, params, *ops: F.concat(F.lit(f'{{"claim_text": "{rule}", "operation": "internal_consistency", "rule_name": "{rule}", "operands": ['), F.concat_ws(", ", *ops), F.lit('], "params": '), params, F.lit("}"))
    o = lambda v, extra="": F.concat(F.lit('{"value": '), num(v), F.lit(extra + "}"))
    bs = claim("balance_sheet_identity", F.when(k % 3 == 0, '{"liabilities_complete": true}').when(k % 3 == 1, '{"liabilities_complete": false}').otherwise("null"), o(F.col("assets")), o(F.col("liabilities")), o(F.col("equity")))
    cash = claim("cash_flow_tie_out", F.when(k % 2 == 0, '{"restricted_cash_disclosed": false}').otherwise("{}"), o(F.col("assets") * F.when(k % 5 == 2, 1.01).otherwise(1.0)), o(F.col("assets")))
    texts = s.filter("key % 10 <> 9").select(F.concat(F.lit("p"), num(k)).alias("doc_id"), F.when(k % 10 == 8, "no answer").when(k % 10 == 7, "[]").otherwise(F.concat(F.lit("["), bs, F.lit(", "), cash, F.lit("]"))).alias("raw"))
    return texts, s.select(F.concat(F.lit("p"), num(k)).alias("doc_id"), F.when(k % 20 == 0, "timeout").alias("fetch_error"))


RECORDS = f"""{A.STATEMENTS}, r0 AS (SELECT *, 'p' || key AS doc_id FROM st WHERE key % 10 < 7),
rec AS (SELECT doc_id, key, 0 AS ord, 'balance_sheet_identity' AS rule_name, CASE WHEN liabilities = 0 AND assets <> 0 AND equity <> 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN key % 3 <> 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(assets - (liabilities + equity)) / greatest(abs(liabilities + equity), 1e-9) <= 0.001 THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS prose, key % 3 < 2 AS emitted, key % 3 = 0 AS gate FROM r0
 UNION ALL SELECT doc_id, key, 1, 'cash_flow_tie_out', CASE WHEN key % 5 = 2 THEN 'WRONG_MATH' ELSE 'VERIFIED' END, key % 2 = 0, key % 2 = 0 FROM r0),
adj AS (SELECT *, prose = 'WRONG_MATH' AS adjudicated, CASE WHEN prose = 'WRONG_MATH' AND NOT (rule_name = 'cash_flow_tie_out' AND key % 4 = 3) THEN 'INSUFFICIENT_EVIDENCE' ELSE prose END AS status FROM rec)"""


def run_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    replays, wanted = statement_texts(spark, sf)
    parsed = audit.statement_claims(replays)
    tagged = wanted.withColumn("key", F.substring("doc_id", 2, 20).cast("long")).filter("key % 4 in (2, 3)").select("doc_id", F.lit("cash_flow_tie_out").alias("rule_name"), F.lit(None).cast("string").alias("eps_variant"), F.when(F.col("key") % 4 == 3, K.WRONG).otherwise(K.VERIFIED).alias("status"), F.lit(0).cast("long").alias("claim_id"))
    return audit.records(parsed.filter("ok"), tagged), parsed, replays, wanted


@query("claim_records", f"WITH {RECORDS} SELECT doc_id, ord::BIGINT AS ord, rule_name, prose AS prose_status, status, adjudicated, emitted AS evidence_emitted, gate AS evidence_gate_satisfied FROM adj")
def claim_records(spark: SparkSession, sf: str) -> DataFrame:
    r = run_records(spark, sf)[0]
    return r.select("doc_id", "ord", "rule_name", "prose_status", "status", "adjudicated", "evidence_emitted", "evidence_gate_satisfied")


@query("filing_runs", f"""WITH {RECORDS}, n AS (SELECT doc_id, count(*) AS c, count(*) FILTER (status <> 'INSUFFICIENT_EVIDENCE') AS ok FROM adj GROUP BY 1)
SELECT 'p' || key AS doc_id, CASE WHEN key % 20 = 0 THEN 'fetch_failed' WHEN key % 10 = 9 THEN 'extraction_unavailable' WHEN key % 10 = 8 THEN 'silent_degradation' WHEN key % 10 = 7 THEN 'extraction_empty' WHEN ok = 0 THEN 'vacuous_no_checkable' ELSE 'ok' END AS pipeline_status, coalesce(c, 0)::BIGINT AS n_claims, coalesce(ok, 0)::BIGINT AS n_checkable, CASE WHEN key % 10 = 8 THEN 1 ELSE 0 END::BIGINT AS n_dropped FROM st LEFT JOIN n ON n.doc_id = 'p' || key""")
def filing_runs(spark: SparkSession, sf: str) -> DataFrame:
    r, parsed, replays, wanted = run_records(spark, sf)
    return audit.filings(wanted, replays, parsed, r)


@query("completion", f"""WITH {RECORDS}, n AS (SELECT doc_id, count(*) FILTER (status <> 'INSUFFICIENT_EVIDENCE') AS ok FROM adj GROUP BY 1), f AS (SELECT key, CASE WHEN key % 20 = 0 OR key % 10 = 9 THEN 'no' WHEN key % 10 = 8 THEN 'bad' WHEN key % 10 = 7 THEN 'empty' WHEN ok = 0 THEN 'bad' ELSE 'ok' END AS s FROM st LEFT JOIN n ON n.doc_id = 'p' || key)
SELECT count(*)::BIGINT AS total_filings, count(*) FILTER (s <> 'no')::BIGINT AS attempted, count(*) FILTER (s = 'ok')::BIGINT AS completed, count(*) FILTER (s = 'bad')::BIGINT AS degraded, count(*) FILTER (s = 'empty')::BIGINT AS empty, round_even(count(*) FILTER (s = 'ok') * 100.0::DOUBLE / count(*) FILTER (s <> 'no'), 1) AS pct_completed FROM f""")
def completion(spark: SparkSession, sf: str) -> DataFrame:
    r, parsed, replays, wanted = run_records(spark, sf)
    return audit.completion(audit.filings(wanted, replays, parsed, r))


@query("prioritised_fixes", f"""WITH {RECORDS}, e AS (SELECT rule_name, count(*) FILTER (emitted) AS n, count(*) AS t FROM adj GROUP BY 1), a AS (SELECT count(*) AS t, count(*) FILTER (status = 'WRONG_MATH') AS w FROM adj)
SELECT 'P1' AS priority, 'extraction' AS area, rule_name AS subject, n::BIGINT AS n, t::BIGINT AS total FROM e WHERE n < t UNION ALL SELECT 'P1', 'review', 'convictions', w, t FROM a WHERE w > 0 UNION ALL SELECT 'P2', 'ingest', 'fetches', count(*) FILTER (key % 20 = 0), count(*) FROM st HAVING count(*) FILTER (key % 20 = 0) > 0 UNION ALL SELECT 'P3', 'extraction', 'dependencies', 0, t FROM a WHERE t > 0""")
def prioritised_fixes(spark: SparkSession, sf: str) -> DataFrame:
    r, parsed, replays, wanted = run_records(spark, sf)
    return audit.fixes(r, audit.filings(wanted, replays, parsed, r))


@query("verdict_summaries", f"""WITH {RECORDS}, x AS (SELECT status, rule_name, CASE WHEN key % 6 > 0 THEN 'S' || (key % 6) END AS sector, list_filter(['bank', 'reit', 'loss'], lambda s: CASE s WHEN 'bank' THEN key % 2 = 0 WHEN 'reit' THEN key % 3 = 0 ELSE key % 5 = 0 END) AS stress FROM adj),
d AS (SELECT 'rule_name' AS dimension, rule_name AS value, status FROM x UNION ALL SELECT 'sector', coalesce(sector, '(unlabeled)'), status FROM x UNION ALL SELECT 'stress', unnest(stress), status FROM x)
SELECT dimension, value, count(*)::BIGINT AS n, count(*) FILTER (status = 'VERIFIED')::BIGINT AS verified, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE')::BIGINT AS insufficient_evidence, count(*) FILTER (status = 'WRONG_MATH')::BIGINT AS wrong_math, round_even(count(*) FILTER (status = 'VERIFIED') * 100.0::DOUBLE / count(*), 1) AS pct_verified FROM d GROUP BY 1, 2""")
def verdict_summaries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("doc_id", 2, 20).cast("long")
    stress = F.array_compact(F.array(F.when(k % 2 == 0, "bank"), F.when(k % 3 == 0, "reit"), F.when(k % 5 == 0, "loss")))
    r = run_records(spark, sf)[0].withColumns({"sector": F.when(k % 6 > 0, F.concat(F.lit("S"), (k % 6).cast("string"))).otherwise(""), "stress": stress})
    return C.summaries(C.breakdown(r, "rule_name", "sector", "stress")).select("dimension", "value", "n", "verified", "insufficient_evidence", "wrong_math", "pct_verified")


@query("review_rows", f"""WITH {RECORDS} SELECT doc_id, rule_name, status AS verdict, CASE status WHEN 'VERIFIED' THEN '—(verified)' WHEN 'WRONG_MATH' THEN '—(needs_human)' ELSE CASE WHEN emitted THEN 'verifier(by_design)' WHEN rule_name = 'cash_flow_tie_out' THEN 'verifier(safety_net)' ELSE 'extraction' END END AS owner FROM adj""")
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = run_records(spark, sf)[0].withColumn("label_caught", F.lit(True))
    return C.review_rows(r).select("doc_id", "rule_name", "verdict", "owner")


@query("eps_queue", f"""WITH {A.STATEMENTS} SELECT key, CASE WHEN shares <> 0 THEN income / shares END AS computed FROM st WHERE abs(assets - (liabilities + equity)) / greatest(abs(liabilities + equity), 1e-9) > 0.001 AND NOT (liabilities = 0 AND assets <> 0 AND equity <> 0)""")
def eps_queue(spark: SparkSession, sf: str) -> DataFrame:
    s = A.statements(spark, sf)
    r = K.balance_sheet(F.array("assets", "liabilities", "equity"), F.lit(True), F.lit(False), F.lit(False))
    number = lambda c: F.struct(F.col(c).alias("value"))
    v = s.withColumn("r", r).select("key", "r.status", F.array(number("assets"), number("income"), number("shares")).alias("operands"))
    return C.eps_queue(v).select("key", "computed")


# Dashboards.


def filer_memory(spark: SparkSession, sf: str) -> DataFrame:
    """The company memory of every filer that has yearly facts."""
    return series.company_memory(A.facts(spark, sf), tags(spark)).withColumn("doc_id", F.concat(F.lit("p"), "entity"))


def restated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The filers with two documents, and the conflicts between these: the later document gives what liabilities and equity add up to as assets, and equity in
    ten thousands; what it says of that depends on how much is owed."""
    s = A.statements(spark, sf).filter(F.col("shares").cast("long") % 3 == 0).withColumn("set_id", F.concat(F.lit("p"), F.col("key").cast("string")))
    later = F.round(F.col("equity") / 10000) * 10000
    cell = lambda d, label, v: F.struct(F.lit(d).alias("doc_ord"), F.lit(label).alias("row_label"), F.lit("FY").alias("column_label"), v.alias("value"))
    rows = F.array(cell(0, "Total assets", F.col("assets")), cell(0, "Equity", F.col("equity")), cell(1, " total Assets", F.col("liabilities") + F.col("equity")), cell(1, "equity ", later))
    named = lambda d: F.concat_ws("-", "set_id", d)
    both = s.select("set_id", F.inline(rows)).withColumn("doc_id", named(F.col("doc_ord").cast("string")))
    number = lambda v: F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2))
    owed = F.col("liabilities") / F.col("equity")
    said = F.when(owed > 0.6, "as restated").when(owed > 0.4, "reclassified to conform").otherwise("as before")
    text = F.concat(F.lit("Total assets "), number(F.col("liabilities") + F.col("equity")), F.lit(" and equity "), number(later), F.lit(", "), said)
    found = compare.conflicts(both, 0.005)
    return s.select(F.col("set_id").alias("doc_id")), compare.annotated(found, s.select(named(F.lit("1")).alias("doc_id"), text.alias("text"))).withColumn("doc_id", F.col("set_id"))


@query("dashboard", f"""WITH {RECORDS}, {A.FACTS}, {TAG_ROWS}, a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (status IN ('VERIFIED', 'WRONG_MATH')) AS w, count(*) FILTER (status = 'VERIFIED') AS v, count(*) FILTER (emitted) AS e, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE') AS d, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE' AND (emitted OR adjudicated)) AS g FROM adj GROUP BY 1),
j AS (SELECT *, min(tag_rank) OVER (PARTITION BY entity, concept) AS best FROM pts JOIN t USING (tag) WHERE unit = 'USD' AND form = '10-K'), mm AS (SELECT entity, concept, any_value(tag) AS tag, any_value(tag_rank) AS r, count(*) AS n FROM j WHERE tag_rank = best GROUP BY 1, 2), dr AS (SELECT entity, tag, count(*) FILTER (NOT fit) AS dropped FROM fits WHERE unit = 'USD' AND form = '10-K' GROUP BY 1, 2),
m AS (SELECT 'p' || e.entity AS doc_id, count(*) FILTER (n >= 2) AS usable, count(*) FILTER (n >= 2 AND dropped = 0 AND r = 0) AS clean, count(*) FILTER (n >= 2 AND dropped > 0) AS cut, count(*) FILTER (n >= 2 AND r > 0) AS fallback FROM (SELECT DISTINCT entity FROM facts WHERE form = '10-K') e LEFT JOIN mm ON mm.entity = e.entity LEFT JOIN dr ON dr.entity = e.entity AND dr.tag = mm.tag GROUP BY 1),
two AS (SELECT * FROM st WHERE shares::BIGINT % 3 = 0), x AS (SELECT key, assets AS va, liabilities + equity AS vb, liabilities / equity AS owed FROM two UNION ALL SELECT key, equity, round(equity / 10000) * 10000, liabilities / equity FROM two), f AS (SELECT * FROM x WHERE abs(va - vb) / greatest(abs(vb), 1e-9) > 0.005),
z AS (SELECT two.key, count(f.key) AS n, count(*) FILTER (f.owed > 0.6) AS explicit, count(*) FILTER (f.owed > 0.4 AND f.owed <= 0.6) AS moved, count(f.key) FILTER (f.owed <= 0.4 OR f.owed IS NULL) AS unexplained FROM two LEFT JOIN f ON f.key = two.key GROUP BY 1),
q AS (SELECT 'p' || key AS doc_id, key FROM st), p(i, panel) AS (VALUES (0, 'verification_score'), (1, 'evidence_coverage'), (2, 'disclosure_quality'), (3, 'consistency_score'), (4, 'restatement_risk'))
SELECT q.doc_id, i::BIGINT AS panel_ord, panel, CASE i WHEN 0 THEN CASE WHEN a.n IS NULL THEN 'no_data' WHEN w > 0 THEN 'ok' ELSE 'unassessed' END WHEN 3 THEN CASE WHEN m.doc_id IS NULL THEN 'unassessed' WHEN usable > 0 THEN 'ok' ELSE 'no_data' END WHEN 4 THEN CASE WHEN z.key IS NOT NULL THEN 'ok' ELSE 'unassessed' END ELSE CASE WHEN a.n IS NULL THEN 'no_data' ELSE 'ok' END END AS state,
CASE i WHEN 0 THEN CASE WHEN w > 0 THEN round_even(v * 100.0::DOUBLE / w, 1) END WHEN 1 THEN round_even(e * 100.0::DOUBLE / a.n, 1) WHEN 2 THEN CASE WHEN d = 0 THEN 100.0 ELSE round_even(g * 100.0::DOUBLE / d, 1) END WHEN 3 THEN CASE WHEN usable > 0 THEN round_even(clean * 100.0::DOUBLE / usable, 1) END END AS value,
CASE WHEN i = 3 AND m.doc_id IS NOT NULL THEN 'usable ' || usable || ' clean ' || clean || ' cut ' || cut || ' fallback ' || fallback WHEN i = 4 AND z.key IS NOT NULL THEN 'conflicts ' || z.n || ' explicit ' || explicit || ' reclassified ' || moved || ' unexplained ' || unexplained END AS detail FROM q CROSS JOIN p LEFT JOIN a ON a.doc_id = q.doc_id LEFT JOIN m ON m.doc_id = q.doc_id LEFT JOIN z ON z.key = q.key""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Five panels of every filer: its records, the memory of its yearly facts, and the conflicts between its two documents where it has two."""
    r, _, _, wanted = run_records(spark, sf)
    compared, conflicts = restated(spark, sf)
    d = dashboards.assembled(wanted, dashboards.record_panels(r), dashboards.consistency_panel(filer_memory(spark, sf)), dashboards.restatement_panel(compared, conflicts))
    said = lambda **parts: F.concat_ws(" ", *[x for k, p in parts.items() for x in (F.lit(k), F.try_element_at("parts", F.lit(p)).cast("string"))])
    detail = F.when((F.col("panel_ord") == 3) & (F.size("parts") > 0), said(usable="usable_series", clean="clean_series", cut="series_with_dropped_spans", fallback="series_with_fallback_tag"))
    detail = detail.when((F.col("panel_ord") == 4) & (F.size("parts") > 0), said(conflicts="conflicts", explicit="explicit_restatement", reclassified="possible_reclassification", unexplained="unexplained"))
    return d.select("doc_id", "panel_ord", "panel", "state", "value", detail.alias("detail"))


@query("dashboard_agreement", f"WITH {RECORDS} SELECT s.status, count(adj.status)::BIGINT AS from_panels, count(adj.status)::BIGINT AS from_records, TRUE AS agrees FROM (VALUES ('VERIFIED'), ('WRONG_MATH'), ('UNSUPPORTED_NUMBER'), ('INSUFFICIENT_EVIDENCE')) s(status) LEFT JOIN adj ON adj.status = s.status GROUP BY 1")
def dashboard_agreement(spark: SparkSession, sf: str) -> DataFrame:
    r, _, _, wanted = run_records(spark, sf)
    return dashboards.agreement(dashboards.assembled(wanted, dashboards.record_panels(r)), r)


@query("records_rebuilt", f"WITH {RECORDS} SELECT doc_id, ord::BIGINT AS ord, '[' || rule_name || ']' AS claim_text, CASE WHEN ord = 0 THEN 3 ELSE 2 END AS n_operands, status FROM adj")
def records_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.rebuilt(run_records(spark, sf)[0]).select("doc_id", "ord", "claim_text", F.size("operands").alias("n_operands"), "status")


# Answers.


def record_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger, made once: gates read it several times."""
    r = run_records(spark, sf)[0].withColumn("explanation", F.concat(F.lit("gap of 12.5 in "), "rule_name"))
    return graph.cut(dashboards.ledger_of_records(r))


@query("ledger_of_records", f"WITH {RECORDS} SELECT doc_id, ord::BIGINT AS ord, rule_name AS topic, CASE WHEN status = 'VERIFIED' THEN 'F' || row_number() OVER (PARTITION BY doc_id, status = 'VERIFIED' ORDER BY ord) END AS fact_id, CASE WHEN status = 'VERIFIED' THEN NULL ELSE 'gap of [number withheld] in ' || rule_name END AS reason, CASE WHEN status = 'VERIFIED' THEN 3 - ord ELSE 0 END::INT AS n_values FROM adj")
def ledger_of_records(spark: SparkSession, sf: str) -> DataFrame:
    return record_ledger(spark, sf).select("doc_id", "ord", "topic", "fact_id", F.when(F.col("fact_id").isNull(), F.col("shown")).alias("reason"), F.size("values").alias("n_values"))


QUESTIONS = [(1, "Does the balance sheet balance?"), (2, "Does cash tie out, and is the (EPS) right?"), (3, 'Is "Cash," fine?'), (4, "What of the rest?"), (5, "Any gap anywhere?")]
TOPICS = "b AS (SELECT doc_id, max(status = 'VERIFIED') FILTER (ord = 0) AS bs, max(status = 'VERIFIED') FILTER (ord = 1) AS cash FROM adj GROUP BY 1)"


def questions(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    q = spark.createDataFrame(QUESTIONS, "question_id int, question string")
    return ledger.select("doc_id").distinct().join(F.broadcast(q))


@query("analyst_gate", f"""WITH {RECORDS}, {TOPICS} SELECT doc_id, q AS question_id, CASE q WHEN 1 THEN CASE WHEN bs THEN 'answered' ELSE 'refused_blocked' END WHEN 2 THEN CASE WHEN bs IS NULL THEN '' WHEN NOT cash THEN 'refused_blocked' ELSE 'refused_no_data' END WHEN 3 THEN CASE WHEN cash THEN 'answered' ELSE 'refused_blocked' END WHEN 4 THEN 'refused_no_data' ELSE 'refused_no_data' END AS mode,
(CASE q WHEN 1 THEN bs::INT WHEN 3 THEN cash::INT WHEN 2 THEN cash::INT ELSE 0 END)::BIGINT AS n_facts FROM b, (VALUES (1), (2), (3), (4), (5)) x(q)""")
def analyst_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gates over every filer's ledger: topics by words, blocked and absent ones refused before any answer."""
    ledger = record_ledger(spark, sf).withColumnRenamed("shown", "said")
    g = answers.gate(questions(spark, ledger), ledger)
    return g.select("doc_id", "question_id", "mode", F.size("facts").cast("long").alias("n_facts"))


@query("answer_check", f"""WITH {RECORDS}, {TOPICS}, x AS (SELECT b.*, key, liabilities = 0 AS zero FROM b JOIN r0 USING (doc_id))
SELECT doc_id, CASE WHEN NOT bs THEN 'refused_blocked' WHEN key % 6 IN (0, 3) THEN 'answered' ELSE 'rejected_unverified_output' END AS mode, CASE WHEN bs THEN CASE key % 6 WHEN 1 THEN 'no citations' WHEN 2 THEN 'unknown citation F9' WHEN 4 THEN 'number of no verified fact' WHEN 5 THEN 'not in the cited format' END END AS reason FROM x""")
def answer_check(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the first question: the total in two forms, without a citation, with an unknown one, with a number of its own, unreadable."""
    ledger = record_ledger(spark, sf).withColumnRenamed("shown", "said")
    s = A.statements(spark, sf).select(F.concat(F.lit("p"), F.col("key").cast("string")).alias("doc_id"), "key", "assets")
    k = F.col("key") % 6
    text = lambda number, cites: F.concat(F.lit('[{"answer": "Of 3 checks: total $'), number, F.lit(' [F1].", "citations": ['), F.lit(cites), F.lit("]}]"))
    exact = F.format_number("assets", 2)
    raw = F.when(k == 0, text(exact, '"F1"')).when(k == 1, text(exact, "")).when(k == 2, text(exact, '"F1", "F9"')).when(k == 3, F.concat(F.lit("```json\n"), text(F.format_number("assets", 0), '"F1"'), F.lit("\n```"))).when(k == 4, text(F.format_number(F.col("assets") * 3 + 100, 2), '"F1"')).otherwise("It balances.")
    q = questions(spark, ledger).filter("question_id = 1")
    given = s.select("doc_id", F.lit(1).alias("question_id"), raw.alias("raw"))
    return answers.judged(answers.gate(q, ledger), given).select("doc_id", "mode", "reason")


@query("analyst_sweep", f"""WITH {RECORDS}, {TOPICS} SELECT (count(*) FILTER (bs) + count(*) FILTER (cash))::BIGINT AS answered, (count(*) FILTER (NOT bs) + count(*) FILTER (NOT cash))::BIGINT AS refused_blocked, 0::BIGINT AS refused_no_data, (count(*) FILTER (NOT bs) + count(*) FILTER (NOT cash))::BIGINT AS adversarial, (count(*) FILTER (NOT bs) + count(*) FILTER (NOT cash))::BIGINT AS adversarial_refused, 0::BIGINT AS answered_from_nothing FROM b""")
def analyst_sweep(spark: SparkSession, sf: str) -> DataFrame:
    ledger = record_ledger(spark, sf).withColumnRenamed("shown", "said")
    topics = spark.createDataFrame([(1, "balance_sheet_identity"), (3, "cash_flow_tie_out")], "question_id int, topic string")
    return answers.sweep(answers.gate(questions(spark, ledger).filter("question_id in (1, 3)"), ledger), ledger, topics)


@query("trust_gates", f"""WITH {RECORDS}, d AS (SELECT doc_id, max(CASE WHEN ord = 0 THEN status END) AS bs, max(CASE WHEN ord = 1 THEN status END) AS cash, substr(doc_id, 2)::BIGINT AS k FROM adj GROUP BY 1)
SELECT doc_id, 'cash' AS about, CASE cash WHEN 'WRONG_MATH' THEN 'DECLINE_DISPUTED' WHEN 'VERIFIED' THEN 'ANSWER' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'DECLINE_UNVERIFIED' ELSE 'NO_BASIS' END AS decision FROM d
UNION ALL SELECT doc_id, 'eps', CASE WHEN k % 3 = 0 THEN CASE bs WHEN 'WRONG_MATH' THEN 'DECLINE_DISPUTED' WHEN 'VERIFIED' THEN 'ANSWER' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'DECLINE_UNVERIFIED' ELSE 'NO_BASIS' END
 WHEN k % 3 = 1 THEN CASE WHEN 'WRONG_MATH' IN (coalesce(bs, ''), coalesce(cash, '')) THEN 'DECLINE_DISPUTED' WHEN 'VERIFIED' IN (coalesce(bs, ''), coalesce(cash, '')) THEN 'ANSWER' WHEN 'INSUFFICIENT_EVIDENCE' IN (coalesce(bs, ''), coalesce(cash, '')) THEN 'DECLINE_UNVERIFIED' ELSE 'NO_BASIS' END ELSE 'NO_BASIS' END FROM d""")
def trust_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Gates of two questions over every filer's verdicts: claims of every third filer speak of earnings per share, of the next one both do, of the others none."""
    k = F.substring("doc_id", 2, 20).cast("long") % 3
    cash = F.col("rule_name") == "cash_flow_tie_out"
    v = run_records(spark, sf)[0].withColumn("claim_text", F.concat(F.when(cash, "Cash flow ties").otherwise("Balance sheet"), F.when((k == 0) & ~cash, ", and Earnings Per Share too").when(k == 1, " as EPS does").otherwise("")))
    v = v.select("doc_id", "claim_text", "status")
    return answers.trust(v, answers.CASH_WORDS, True, "doc_id").withColumn("about", F.lit("cash")).unionByName(answers.trust(v, answers.EPS_WORDS, False, "doc_id").withColumn("about", F.lit("eps")))


# Gold.


def gold_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, gold): a customer's orders as gold claims, and what was read of them: some lost, some with other words, numbers or operations, and one made up
    from each of the order's items."""
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("total of "), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", " ")), F.lit(" order in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" was "), F.col("o_orderstatus"))
    g = A.dealt(o, "o_custkey").select(F.col("o_custkey").alias("doc_id"), k.alias("ord"), text.alias("claim_text"), F.col("o_totalprice").alias("stated_value"), F.get(F.array(*map(F.lit, OPS)), (k % 5).cast("int")).alias("operation"))
    p = g.filter("ord % 9 <> 4").select("doc_id", (F.col("ord") * 2).alias("ord"), F.when(F.col("ord") % 4 == 1, F.concat(F.lit("figure "), F.substring("claim_text", 10, 40))).otherwise(F.col("claim_text")).alias("claim_text"), F.when(F.col("ord") % 5 == 2, F.col("stated_value") * 1.2).when(F.col("ord") % 5 == 3, F.col("stated_value") * 1.005).otherwise(F.col("stated_value")).alias("stated_value"), F.when(F.col("ord") % 3 == 1, "sum").otherwise(F.col("operation")).alias("operation"))
    items = A.table(spark, sf, "lineitem").join(o.select(k.alias("l_orderkey"), F.col("o_custkey").alias("doc_id")), "l_orderkey")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    made_up = items.select("doc_id", (n * 2 + 1).cast("long").alias("ord"), F.concat(F.lit("item shipped "), F.date_format("l_shipdate", "MMMM yyyy")).alias("claim_text"), F.col("l_extendedprice").alias("stated_value"), F.lit("identity").alias("operation"))
    return p.unionByName(made_up), g


def match_sql(pred: str, gold: str) -> str:
    """CTEs after which `matched` holds (doc_id, pred, gold) of tables with doc_id, ord, claim_text, stated_value, operation: all pairs of a document, best first, taken one by one."""
    words = "list_distinct(list_filter(string_split_regex(lower(coalesce(claim_text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.GOLD_STOPWORDS) + "], t)))"
    return f"""mp AS (SELECT *, {words} AS w FROM {pred}), mg AS (SELECT *, {words} AS w FROM {gold}),
ms AS (SELECT doc_id, mp.ord AS pred, mg.ord AS gold, 3 * CASE WHEN len(list_concat(mp.w, mg.w)) > 0 THEN len(list_intersect(mp.w, mg.w))::DOUBLE / len(list_distinct(list_concat(mp.w, mg.w))) ELSE 0 END
 + CASE WHEN mp.stated_value IS NULL OR mg.stated_value IS NULL THEN (mp.stated_value IS NULL AND mg.stated_value IS NULL)::INT ELSE (abs(mp.stated_value - mg.stated_value) <= greatest(abs(mg.stated_value) * 0.01, 0.05))::INT END + CASE WHEN mp.operation = mg.operation THEN 0.3::DOUBLE ELSE 0 END AS score FROM mp JOIN mg USING (doc_id)),
ml AS (SELECT doc_id, list([{{'p': pred, 'g': gold, 's': score}}] ORDER BY score DESC, pred DESC, gold DESC) AS pairs FROM ms WHERE score > 0.15 GROUP BY 1),
mt AS (SELECT doc_id, unnest(list_reduce(pairs, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.p = x[1].p OR y.g = x[1].g)) > 0 THEN a ELSE list_concat(a, x) END)) AS m FROM ml),
mm AS (SELECT doc_id, m.p AS pred, m.g AS gold, m.s AS score FROM mt),
matched AS (SELECT doc_id, pred, gold, score FROM mm UNION ALL SELECT doc_id, NULL, ord, NULL FROM mg WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.doc_id = mg.doc_id AND mm.gold = mg.ord) UNION ALL SELECT doc_id, ord, NULL, NULL FROM mp WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.doc_id = mp.doc_id AND mm.pred = mp.ord))"""


GOLD_SETS = """gg AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, 'total of ' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', ' ', 'g')) || ' order in ' || strftime(o_orderdate, '%B %Y') || ' was ' || o_orderstatus AS claim_text, o_totalprice AS stated_value, ['sum', 'difference', 'percent_change', 'ratio', 'identity'][(o_orderkey % 5 + 1)::INT] AS operation FROM orders),
pp AS (SELECT doc_id, ord * 2 AS ord, CASE WHEN ord % 4 = 1 THEN 'figure ' || substr(claim_text, 10, 40) ELSE claim_text END AS claim_text, CASE ord % 5 WHEN 2 THEN stated_value * 1.2::DOUBLE WHEN 3 THEN stated_value * 1.005::DOUBLE ELSE stated_value END AS stated_value, CASE WHEN ord % 3 = 1 THEN 'sum' ELSE operation END AS operation FROM gg WHERE ord % 9 <> 4
 UNION ALL SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) * 2 + 1, 'item shipped ' || strftime(l_shipdate, '%B %Y'), l_extendedprice, 'identity' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("gold_match", f"WITH {GOLD_SETS}, {match_sql('pp', 'gg')} SELECT doc_id, pred, gold, score FROM matched")
def gold_match(spark: SparkSession, sf: str) -> DataFrame:
    return gold.matches(*gold_sets(spark, sf))


def gold_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, predictions, gold) as verdicts: each claim of an order is predicted as it is, or with its operands swapped, changed or of another source, some under other
    words; which prediction is of which claim is for the assignment to find."""
    k = F.col("key")
    c = typed_claims(spark, sf).withColumns({"ord": k, "claim_text": F.concat(F.lit("claim of order "), k.cast("string"))})
    swapped = F.when(k % 6 == 1, F.reverse("operands")).when(k % 6 == 2, F.transform("operands", lambda o: o.withField("value", o["value"] * 1.5))).when(k % 6 == 3, F.transform("operands", lambda o: o.withField("source", F.lit("inferred")))).otherwise(F.col("operands"))
    p = c.filter("key % 8 <> 5").withColumns({"operands": swapped, "stated_value": F.when(k % 10 == 7, F.col("stated_value") * 2).otherwise(F.col("stated_value")), "claim_text": F.when(k % 4 == 1, F.concat(F.lit("figure "), F.floor(k / 7).cast("string"))).otherwise(F.col("claim_text"))})
    extra = p.filter("key % 12 = 4").withColumn("ord", -F.col("ord"))
    every = p.unionByName(extra)
    return gold.matches(every, c), C.verify(every), C.verify(c)


def near_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL ELSE abs({a} - {b}) <= greatest(abs({b}) * 0.01, 0.05) END"


#: gp and ge: each prediction and each gold claim with values v1, v2 (null where missing), sources and verdict; ev: what is right of each pair of `matched`.
GOLD = f"""{ORDERS}, g1 AS (SELECT *, key % 11 = 4 AS missing, operation <> 'identity' AS two, key % 6 = 3 AS other, CASE WHEN operation = 'identity' THEN p ELSE q END AS b1, CASE WHEN key % 10 = 7 THEN stated * 2 ELSE stated END AS ps FROM ov),
g2 AS (SELECT *, CASE WHEN key % 6 = 1 AND two THEN p WHEN key % 6 = 2 THEN b1 * 1.5::DOUBLE ELSE b1 END AS a1, CASE key % 6 WHEN 1 THEN q WHEN 2 THEN p * 1.5::DOUBLE ELSE p END AS a2 FROM g1),
g3 AS (SELECT *, CASE operation WHEN 'sum' THEN a1 + a2 WHEN 'difference' THEN a1 - a2 WHEN 'percent_change' THEN (a2 - a1) / a1 * 100 WHEN 'ratio' THEN a1 / a2 ELSE a1 END AS calc FROM g2),
g4 AS (SELECT *, CASE WHEN missing AND NOT other THEN 'UNSUPPORTED_NUMBER' WHEN ps IS NULL THEN 'AMBIGUOUS' WHEN CASE WHEN operation = 'percent_change' THEN abs(ps - calc) <= 0.5 ELSE abs(ps - calc) / greatest(abs(calc), 1e-9) <= 0.005 END THEN 'VERIFIED' ELSE 'WRONG_MATH' END AS pv FROM g3),
ge AS (SELECT doc_id, key AS ord, 'claim of order ' || key AS claim_text, stated AS stated_value, operation, two, CASE WHEN NOT missing THEN b1 END AS v1, CASE WHEN NOT missing AND two THEN p END AS v2, CASE WHEN missing THEN 'missing' ELSE 'grounded' END AS source, status FROM g2),
g5 AS (SELECT doc_id, key AS ord, CASE WHEN key % 4 = 1 THEN 'figure ' || (key // 7) ELSE 'claim of order ' || key END AS claim_text, ps AS stated_value, operation, two, CASE WHEN NOT missing OR other THEN a1 END AS v1, CASE WHEN (NOT missing OR other) AND two THEN a2 END AS v2, CASE WHEN other THEN 'inferred' WHEN missing THEN 'missing' ELSE 'grounded' END AS source, pv AS status FROM g4 WHERE key % 8 <> 5),
gp AS (SELECT * FROM g5 UNION ALL SELECT * REPLACE (-ord AS ord) FROM g5 WHERE ord % 12 = 4), {match_sql('gp', 'ge')},
e0 AS (SELECT m.doc_id, m.pred, m.gold, g.operation, m.pred IS NOT NULL AND m.gold IS NOT NULL AS matched, p.operation = g.operation AS op_ok, {near_sql('p.stated_value', 'g.stated_value')} AS stated_ok, p.two = g.two AS as_many, g.two, p.v1, p.v2, g.v1 AS w1, g.v2 AS w2, p.source = g.source AS sources, p.status = g.status AS agree,
 (p.v1 IS NULL) = (g.v1 IS NULL) AS as_missing FROM matched m LEFT JOIN gp p ON p.doc_id = m.doc_id AND p.ord = m.pred LEFT JOIN ge g ON g.doc_id = m.doc_id AND g.ord = m.gold),
ev AS (SELECT *, CASE WHEN matched AND operation IN ('difference', 'percent_change', 'ratio') AND w1 IS NOT NULL AND as_many THEN {near_sql('v1', 'w1')} AND {near_sql('v2', 'w2')} END AS order_ok,
 matched AND as_many AND as_missing AND CASE WHEN w1 IS NULL THEN TRUE WHEN two THEN {near_sql('least(v1, v2)', 'least(w1, w2)')} AND {near_sql('greatest(v1, v2)', 'greatest(w1, w2)')} ELSE {near_sql('v1', 'w1')} END AS same,
 matched AND as_many AND sources AND CASE WHEN two THEN ({near_sql('v1', 'w1')} AND {near_sql('v2', 'w2')}) OR (NOT {near_sql('v1', 'w1')} AND {near_sql('v2', 'w1')} AND {near_sql('v1', 'w2')}) ELSE {near_sql('v1', 'w1')} END AS grounding FROM e0)"""


@query("gold_evaluation", f"""WITH RECURSIVE {GOLD} SELECT operation, count(*)::BIGINT AS total_gold, count(*) FILTER (matched)::BIGINT AS recall, count(*) FILTER (matched AND op_ok)::BIGINT AS operation_ok, count(*) FILTER (matched AND stated_ok)::BIGINT AS stated_ok, count(*) FILTER (order_ok)::BIGINT AS order_ok, count(*) FILTER (order_ok IS NOT NULL)::BIGINT AS order_ok_of, count(*) FILTER (grounding)::BIGINT AS grounding_ok, count(*) FILTER (matched AND op_ok AND stated_ok AND same AND coalesce(order_ok, TRUE) AND grounding)::BIGINT AS fully_correct, count(*) FILTER (agree)::BIGINT AS verdict_agree FROM ev WHERE gold IS NOT NULL GROUP BY 1""")
def gold_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    pairs, pred, g = gold_pairs(spark, sf)
    e = gold.evaluated(pairs, pred, g).join(g.select("doc_id", F.col("ord").alias("gold"), "operation"), ["doc_id", "gold"])
    return gold.summary(e, "operation").select("operation", "total_gold", "recall", "operation_ok", "stated_ok", "order_ok", "order_ok_of", "grounding_ok", "fully_correct", "verdict_agree")


@query("gold_documents", f"WITH RECURSIVE {GOLD} SELECT doc_id, count(gold)::BIGINT AS total_gold, count(*) FILTER (matched)::BIGINT AS recall, count(*) FILTER (gold IS NULL)::BIGINT AS spurious FROM ev GROUP BY 1")
def gold_documents(spark: SparkSession, sf: str) -> DataFrame:
    return gold.summary(gold.evaluated(*gold_pairs(spark, sf)), "doc_id").select("doc_id", "total_gold", "recall", "spurious")


@query("gold_accuracy", f"WITH {RECORDS} SELECT rule_name, count(*) FILTER (prose = CASE WHEN key % 2 = 0 THEN 'VERIFIED' ELSE 'INSUFFICIENT_EVIDENCE' END)::BIGINT AS correct, count(*)::BIGINT AS total, count(*) FILTER (prose <> CASE WHEN key % 2 = 0 THEN 'VERIFIED' ELSE 'INSUFFICIENT_EVIDENCE' END)::BIGINT AS failed FROM adj GROUP BY 1")
def gold_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("doc_id", 2, 20).cast("long")
    r = run_records(spark, sf)[0].select("rule_name", F.col("prose_status").alias("status"), F.when(k % 2 == 0, K.VERIFIED).otherwise(K.INSUFFICIENT).alias("expected_status"))
    return gold.accuracy(r, "rule_name")


# Tagged facts.


EPS = f"""CASE WHEN e >= 1e-9 AND c >= 1e-9 AND greatest(e, c) / least(e, c) >= 20 THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(e - c) <= greatest(0.005, CASE WHEN e = floor(e) AND {HALF.format(v='e')} > 0.005 THEN 0.005 ELSE {HALF.format(v='e')} END + {HALF.format(v='i')} / s + i / (s * s) * {HALF.format(v='s')}) THEN 'VERIFIED' ELSE 'WRONG_MATH' END"""
FILER = f"""{A.TAGGED}, fc AS (SELECT k, entity, 'balance_sheet_identity' AS rule_name, NULL AS variant, CASE WHEN abs(assets - (liabilities + equity)) / greatest(abs(liabilities + equity), 1e-9) <= 0.001 THEN 'VERIFIED' WHEN temp_equity IS NOT NULL AND assets - (liabilities + equity) > 0 AND abs(assets - (liabilities + equity) - temp_equity) <= 0.1 * temp_equity THEN 'INSUFFICIENT_EVIDENCE' ELSE 'WRONG_MATH' END AS status FROM filer WHERE liabilities IS NOT NULL
 UNION ALL SELECT k, entity, 'eps_reconciliation', 'basic', {EPS} FROM (SELECT *, eps_basic AS e, coalesce(net_income_to_common, net_income_total) AS i, shares_basic AS s, coalesce(net_income_to_common, net_income_total) / shares_basic AS c FROM filer)
 UNION ALL SELECT k, entity, 'eps_reconciliation', 'diluted', {EPS} FROM (SELECT *, eps_diluted AS e, coalesce(net_income_to_common, net_income_total) AS i, shares_diluted AS s, coalesce(net_income_to_common, net_income_total) / shares_diluted AS c FROM filer) WHERE e IS NOT NULL AND NOT (k % 6 = 0 AND k % 5 = 0 AND shares_diluted <> shares_basic)
 UNION ALL SELECT k, entity, 'cash_flow_tie_out', NULL, CASE WHEN abs(cf_cash - bs_cash) > 1e-6 * greatest(bs_cash, 1) AND k % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(cf_cash - bs_cash) / greatest(abs(bs_cash), 1e-9) <= 0.0001 THEN 'VERIFIED' ELSE 'WRONG_MATH' END FROM filer)"""


@query("fact_pivot", f"WITH {A.TAGGED} SELECT entity, period_end, assets, liabilities, equity, temp_equity, net_income_total, net_income_to_common, eps_basic, eps_diluted, shares_basic, shares_diluted, bs_cash, cf_cash FROM filer")
def fact_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return X.pivoted(A.tagged(spark, sf)).drop("tags_used")


@query("fact_claims", f"WITH {FILER} SELECT entity AS doc_id, rule_name, variant AS eps_variant, status FROM fc")
def fact_claims(spark: SparkSession, sf: str) -> DataFrame:
    return C.verify(X.claims_of(X.pivoted(A.tagged(spark, sf)))).select("doc_id", "rule_name", "eps_variant", "status")


@query("filer_run", f"WITH {FILER}, n AS (SELECT entity, status, count(*) AS c FROM fc GROUP BY 1, 2) SELECT f.entity, f.period_end, sum(c)::BIGINT AS n_claims, string_agg(status || '=' || c, ',' ORDER BY status) AS verdicts FROM filer f JOIN n USING (entity) GROUP BY 1, 2")
def filer_run(spark: SparkSession, sf: str) -> DataFrame:
    r = X.run(A.tagged(spark, sf))
    return r.withColumn("verdicts", F.array_join(F.transform(F.array_sort(F.map_entries("verdicts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("offline_audit", f"WITH {FILER} SELECT entity, count(*)::BIGINT AS results, arg_min(status, (rule_name, coalesce(variant, ''))) AS first FROM fc GROUP BY 1")
def offline_audit(spark: SparkSession, sf: str) -> DataFrame:
    p = X.payloads(A.tagged(spark, sf))
    r = F.from_json(F.get_json_object("json", "$.results"), "array<struct<status: string, claim: struct<rule_name: string, eps_variant: string>>>")
    order = F.array_sort(F.transform(r, lambda x: F.struct(x["claim"]["rule_name"].alias("rule"), F.coalesce(x["claim"]["eps_variant"], F.lit("")).alias("variant"), x["status"].alias("status"))))
    return p.select("entity", F.size(r).cast("long").alias("results"), F.get(order, F.lit(0))["status"].alias("first"))


@query("pinned_run", f"WITH {A.TAGGED}, p AS (SELECT k, min(fy) AS fy FROM w2 GROUP BY 1) SELECT w2.k::VARCHAR AS entity, make_date(p.fy, 12, 31) AS period_end, w2.v AS assets, w2.eps AS eps_basic FROM w2 JOIN p USING (k, fy)")
def pinned_run(spark: SparkSession, sf: str) -> DataFrame:
    """The first year of every filer, pinned."""
    f = A.tagged(spark, sf)
    pins = f.filter("form = '10-K' and tag = 'Assets'").groupBy("entity").agg(F.min("end").alias("end"))
    return X.pivoted(f, pins=pins).select("entity", "period_end", "assets", "eps_basic")


@query("directional_claims", f"""WITH {A.REVENUE}, l AS (SELECT k, entity, fy, v, lag(v) OVER (PARTITION BY k ORDER BY fy) AS old, max(fy) OVER (PARTITION BY k) AS last FROM rev), x AS (SELECT *, (v - old) / abs(old) * 100 AS pct FROM l WHERE fy = last)
SELECT entity AS doc_id, i::BIGINT AS ord, dir AS trend_dir, CASE WHEN old IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(pct) <= 2 OR dir = 'flat' THEN 'NEEDS_REVIEW' WHEN (dir = 'up') = (pct > 0) THEN 'VERIFIED' ELSE 'CONFLICT' END AS status FROM x, (VALUES (0, 'up'), (1, 'down'), (2, 'flat')) d(i, dir)""")
def directional_claims(spark: SparkSession, sf: str) -> DataFrame:
    """What a discussion says of revenue, read from JSON, against the last two years."""
    r = A.revenue(spark, sf)
    points = r.select("entity", F.lit("revenue").alias("concept"), F.col("fy").alias("end"), F.col("v").alias("val"))
    item = lambda d: f'{{"metric": " revenue", "direction": "{d} ", "excerpt": "it went {d}"}}'
    raw = "[" + ", ".join([item("Up"), item("down"), item("FLAT"), item("sideways"), '{"metric": "", "direction": "up", "excerpt": "x"}']) + "]"
    said = claims_json.directions(r.select(F.col("entity").alias("doc_id"), F.lit(raw).alias("raw")).distinct()).filter("reason is null").withColumnRenamed("metric", "concept")
    return C.verify(X.directional(points, said)).select("doc_id", "ord", "trend_dir", "status")


@query("table_claims", f"""WITH {A.STATEMENTS} SELECT 'p' || key AS doc_id, 'balance_sheet_identity' AS rule_name, floor(assets) / 1000 AS first FROM st WHERE key % 3 > 0 UNION ALL SELECT 'p' || key, 'cash_flow_tie_out', floor(equity) / 1000 FROM st WHERE key % 2 = 0""")
def table_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of statements in pipe tables: some tables lack a row."""
    s = A.statements(spark, sf)
    row = lambda label, c: F.concat(F.lit(f"| {label} | $"), F.format_number(F.floor(c), 0), F.lit(" | 1 |\n"))
    k = F.col("key")
    text = F.concat(F.lit("Amounts in thousands\n| | FY2024 | FY2023 |\n|---|---|---|\n"), row("Total assets", "assets"), F.when(k % 3 > 0, row("Total liabilities", "liabilities")).otherwise(""), row("Total shareholders equity", "equity"), F.when(k % 2 == 0, row("Cash and cash equivalents, end of year", "equity")).otherwise(""), F.when(k % 2 == 0, row("Cash and cash equivalents", "equity")).otherwise(""))
    cells_ = tables.millions(tables.cells(s.select(F.concat(F.lit("p"), k.cast("string")).alias("doc_id"), text.alias("text"))))
    return audit.table_claims(cells_, "FY2024").select("doc_id", "rule_name", F.col("operands")[0]["value"].alias("first"))


# The store.


@query("audit_history", f"""WITH RECURSIVE {ORDERS} SELECT doc_id, count(*) FILTER (final = 'VERIFIED')::BIGINT AS verified, count(*)::BIGINT AS results, 'T' || doc_id AS ticker FROM op GROUP BY 1""")
def audit_history(spark: SparkSession, sf: str) -> DataFrame:
    v = audit.verdicts(typed_claims(spark, sf)).withColumns({n: F.lit(None).cast("string") for n in ("claim_text", "unit", "source_text")})
    v = graph.cut(v.withColumn("operands", F.transform("operands", lambda o: o.withField("source_span", F.lit(None).cast("array<int>")).withField("doc_id", F.lit("d")))))
    rows = store.audit_rows(audit.serialised(v).join(v.select("doc_id", "ord", "status"), ["doc_id", "ord"]), audit.scored(v), org=F.lit(1), ticker=F.concat(F.lit("t"), "doc_id"), label=F.lit("orders"), at=F.lit("2024-01-01").cast("timestamp"))
    counts = F.from_json("verdict_counts_json", "map<string, bigint>")
    return rows.select("doc_id", F.coalesce(F.try_element_at(counts, F.lit(K.VERIFIED)), F.lit(0)).alias("verified"), F.json_array_length(F.get_json_object("result_json", "$.results")).cast("long").alias("results"), "ticker")
