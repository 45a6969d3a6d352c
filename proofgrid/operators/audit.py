"""Audits: model output to claims, claims to verdicts, propagated errors, conflicts and scores, over many documents at once.

Extraction itself is not done here: what models answered is a table of texts (a replay). Summaries audit a document set; statements audit each of
its documents; every step is a DataFrame, so a set of filings and a million of them take the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T
from proofgrid.sources import claims_json

from . import claims as C
from . import compare, graph, reach

#: How reasons start of elements that never became a claim.
DROPPED = ("array element is not an object", "JSON decode error", "no JSON array", "empty model response", "no claim text", "unknown ", "stated value", "operand is", "span has")


def statement_claims(texts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Parsed claims of statements (texts: doc_id, raw): those whose operands are all missing go to the issues, as their rule does not apply; where the
    document's text (documents: doc_id, text) speaks of preferred dividends, earnings claims have that flag unless params say otherwise."""
    x = claims_json.parsed(texts)
    gone = (F.col("operation") == "internal_consistency") & (F.size("operands") > 0) & F.forall("operands", lambda o: o["source"] == "missing")
    x = x.withColumns({"reason": F.when(F.col("ok") & gone, F.concat(F.lit("dropped "), F.coalesce("rule_name", F.lit("rule")), F.lit(": all operands missing"))).otherwise(F.col("reason")), "ok": F.col("ok") & ~F.coalesce(gone, F.lit(False))})
    if documents is None:
        return x
    named = documents.filter(F.col("text").rlike(K.TO_COMMON)).select("doc_id", F.lit(True).alias("__preferred")).distinct()
    flag = F.coalesce("__preferred", F.lit(False)) & (F.col("rule_name") == "eps_reconciliation") & ~F.map_contains_key("params", F.lit("preferred_dividends_present"))
    return x.join(named, "doc_id", "left").withColumn("params", F.when(flag, F.map_concat("params", F.create_map(F.lit("preferred_dividends_present"), F.lit("true")))).otherwise(F.col("params"))).drop("__preferred")


def joined(summary: DataFrame, statements: DataFrame) -> DataFrame:
    """Claims of summaries and then of statements, numbered on within a document; both with the same columns, ord from 0."""
    n = summary.groupBy("doc_id").agg((F.max("ord") + 1).alias("__n"))
    after = statements.join(n, "doc_id", "left").withColumn("ord", F.col("ord") + F.coalesce("__n", F.lit(0))).drop("__n")
    return summary.unionByName(after, allowMissingColumns=True)


def with_links(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with node_id and depends_on extended by derived links: an operand that no number of the source (doc_id, text) states and that one derived
    claim gives. Ends of a link without an id are c<ord>. Links that close a cycle are left out."""
    known = sources.select("doc_id", F.explode(T.source_numbers(F.col("text"))).alias("value")).distinct()
    ids = claims.withColumn("claim_id", F.coalesce("node_id", F.concat(F.lit("c"), F.col("ord").cast("string"))))
    links = compare.linked(ids.select("doc_id", "claim_id", "ord", "operation", "stated_value", F.filter(F.transform("operands", lambda o: o["value"]), lambda v: v.isNotNull()).alias("operands"), "depends_on"), known)
    out = links.groupBy("doc_id", F.col("src").alias("claim_id")).agg(F.array_sort(F.collect_set("dst")).alias("__new"))
    ends = links.select("doc_id", F.explode(F.array("src", "dst")).alias("claim_id")).distinct().withColumn("__end", F.lit(True))
    x = ids.join(out, ["doc_id", "claim_id"], "left").join(ends, ["doc_id", "claim_id"], "left")
    none = F.array().cast("array<string>")
    return x.withColumns({"node_id": F.coalesce("node_id", F.when(F.col("__end"), F.col("claim_id"))), "depends_on": F.array_union(F.coalesce("depends_on", none), F.coalesce("__new", none))}).drop("claim_id", "__new", "__end")


def verdicts(claims: DataFrame) -> DataFrame:
    """Claims (doc_id, ord, node_id, depends_on, and what verify reads) with verdicts, errors propagated; a cycle raises. downstream: how many claims
    depend on each."""
    v = graph.cut(C.verify(claims).withColumn("node", graph.node_of()))  # read several times below
    e = graph.cut(graph.edges(v))
    near = graph.cut(reach.reach(e, graph.failing(v), graph.cut))
    if not near.filter("cyclic").isEmpty():
        graph.assert_acyclic(e)
    p = graph.propagate(v.select("doc_id", "node", "ord", "status"), e, near).select("doc_id", "ord", F.col("status").alias("__status"), "caused_by")
    n = near.filter("n > 0").select("doc_id", "node", F.col("n").alias("downstream"))
    x = v.join(p, ["doc_id", "ord"]).withColumn("status", F.col("__status")).drop("__status")
    return x.join(n, ["doc_id", "node"], "left").drop("node")


def scored(results: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Scores by document with the number of dropped elements and why (issues: doc_id, ok, reason). Results of conflicts count like others. Weights are added up in the
    order of the claims (ord), as the original does: that decides scores which lie between two places."""
    s = C.score(results, ["doc_id"], "downstream", order="ord")
    if issues is None:
        return s
    lost = issues.filter(~F.col("ok") & (F.exists(F.array(*map(F.lit, DROPPED)), lambda p: F.startswith(F.col("reason"), p))))
    d = lost.groupBy("doc_id").agg(F.count("*").alias("dropped_claims"), F.array_sort(F.collect_list(F.substring("reason", 1, 200))).alias("dropped_reasons"))
    return s.join(d, "doc_id", "left").withColumn("dropped_claims", F.coalesce("dropped_claims", F.lit(0)))


def one(summaries: DataFrame, sources: DataFrame, statements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, scores) of documents by themselves. summaries and statements: doc_id, raw; sources: doc_id, text."""
    parsed = graph.cut(claims_json.parsed(summaries))  # read for claims, links and issues
    issues = parsed
    claims = with_links(parsed.filter("ok"), sources)
    if statements is not None:
        s = graph.cut(statement_claims(statements, sources))
        issues = issues.unionByName(s)
        claims = joined(claims, s.filter("ok"))
    results = verdicts(C.with_evidence(claims))
    return results, scored(results, issues)


def many(documents: DataFrame, summaries: DataFrame, statements: DataFrame, cells: DataFrame, rel: float = 0.005) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, conflicts, scores) of sets of documents. documents: set_id, doc_id, doc_ord, text; summaries: set_id, raw; statements: doc_id, raw; cells: set_id,
    doc_id, doc_ord, row_label, column_label, value. Statements are checked document by document, their operands told by document; the same figure
    under one label with different values is a conflict, added after propagation and before the score."""
    sources = parts(documents).select(F.col("set_id").alias("doc_id"), F.col("part").alias("text"))  # numbers are read document by document
    parsed = graph.cut(claims_json.parsed(summaries.select(F.col("set_id").alias("doc_id"), "raw")))
    own = graph.cut(statement_claims(statements.select("doc_id", "raw"), documents.select("doc_id", "text")))
    stamped = F.transform("operands", lambda o: o.withField("doc_id", F.coalesce(o["doc_id"], F.col("doc_id"))))
    sizes = own.groupBy("doc_id").agg((F.max("ord") + 1).alias("n")).join(documents.select("doc_id", "set_id", "doc_ord"), "doc_id")
    ahead = Window.partitionBy("set_id").orderBy("doc_ord", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    order = sizes.select("doc_id", "set_id", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))  # one row a document
    per = own.withColumn("operands", stamped).join(order, "doc_id").withColumns({"ord": F.col("before") + F.col("ord"), "doc_id": F.col("set_id")}).drop("set_id", "before")
    results = verdicts(C.with_evidence(joined(with_links(parsed.filter("ok"), sources), per.filter("ok"))))
    texts = documents.select("doc_id", "text")
    conflicts = graph.cut(compare.conflict_verdicts(compare.annotated(compare.conflicts(cells, rel), texts)))
    last = F.lit(2**63 - 1).cast("long").alias("ord")  # conflicts come after all claims, and all weigh the same
    every = results.select("doc_id", "ord", "status", "downstream").unionByName(conflicts.select(F.col("set_id").alias("doc_id"), last, "status", F.lit(0).cast("long").alias("downstream")))
    return results, conflicts, scored(every, parsed.unionByName(per))


def parts(documents: DataFrame) -> DataFrame:
    """(set_id, doc_ord, part): each document under a head with its id, period and type. documents: set_id, doc_id, doc_ord, text, and where there are any
    period and doc_type."""
    has = set(documents.columns)
    own = lambda c: F.nullif(F.col(c), F.lit("")) if c in has else F.lit(None).cast("string")
    both = F.concat_ws(", ", F.concat(F.lit("period: "), own("period")), F.concat(F.lit("type: "), own("doc_type")))
    head = F.concat(F.lit("=== DOCUMENT "), "doc_id", F.when(both != "", F.concat(F.lit(" ("), both, F.lit(")"))).otherwise(""), F.lit(" ===\n"))
    return documents.select("set_id", "doc_ord", F.concat(head, F.trim("text")).alias("part"))


def labelled(documents: DataFrame) -> DataFrame:
    """(set_id, text): the parts of each set in order, joined into one text, as a model is asked with. A set of filings fits in one row by contract; audits read the
    parts themselves."""
    return parts(documents).groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def serialised(results: DataFrame) -> DataFrame:
    """(doc_id, ord, json): each result as nested JSON; a missing operand has no value."""
    operands = F.transform("operands", lambda o: F.struct(F.when(o["source"] != "missing", o["value"]).alias("value"), o["source"].alias("source"), o["source_text"].alias("source_text"), o["source_span"].alias("source_span"), o["doc_id"].alias("doc_id")))
    claim = F.struct("claim_text", "operation", "stated_value", "unit", "source_text", "node_id", "depends_on", operands.alias("operands"))
    return results.select("doc_id", "ord", F.to_json(F.struct("status", F.col("recomputed").alias("recomputed_value"), "delta", "caused_by", claim.alias("claim")), {"ignoreNullFields": "false"}).alias("json"))


def records(claims: DataFrame, tagged: DataFrame) -> DataFrame:
    """Flat records of statement claims: verdict before and after adjudication by tagged verdicts, evidence, values. claims: parsed, with doc_id, ord."""
    v = C.verify(C.with_evidence(C.emission(claims.filter("operation = 'internal_consistency'")))).withColumnRenamed("ord", "claim_id")
    a = C.adjudicated(v.withColumn("prose_status", F.col("status")), tagged).withColumnRenamed("claim_id", "ord")
    values = F.transform("operands", lambda o: o["value"])
    return a.select("doc_id", "ord", "rule_name", "operation", "status", "prose_status", "adjudicated", values.alias("operand_values"), "operands", "evidence_emitted", "evidence_gate_satisfied", "eps_variant", "node_id", "depends_on", (F.size("depends_on") > 0).alias("has_graph_dep"))


def filings(wanted: DataFrame, replays: DataFrame, parsed: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, pipeline_status, n_claims, n_checkable, n_dropped) of every filing wanted (doc_id, fetch_error). replays: doc_id, raw; parsed: their elements;
    records: of the claims kept."""
    r = records.groupBy("doc_id").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("status").isin(*C.UNCHECKABLE)).alias("n_checkable"))
    lost = parsed.filter(~F.col("ok") & ~F.col("reason").contains("all operands missing")).groupBy("doc_id").agg(F.count("*").alias("n_dropped"))
    have = replays.select("doc_id", F.lit(True).alias("available")).distinct()
    x = wanted.join(have, "doc_id", "left").join(r, "doc_id", "left").join(lost, "doc_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_claims", "n_checkable", "n_dropped")})
    fetched, there = F.col("fetch_error").isNull(), F.coalesce("available", F.lit(False))
    status = C.pipeline_status(fetched, there, (F.col("n_claims") == 0) & (F.col("n_dropped") > 0), F.col("n_claims"), F.col("n_checkable"))
    return x.select("doc_id", status.alias("pipeline_status"), "n_claims", "n_checkable", "n_dropped")


def completion(filings: DataFrame) -> DataFrame:
    """One row: filings attempted, completed, degraded and empty, and the share completed of those attempted (null where none was)."""
    n = lambda *s: F.count_if(F.col("pipeline_status").isin(*s))
    attempted = F.count("*") - n("fetch_failed", "extraction_unavailable")
    return filings.agg(F.count("*").alias("total_filings"), attempted.alias("attempted"), n("ok").alias("completed"), n("silent_degradation", "vacuous_no_checkable").alias("degraded"), n("extraction_empty").alias("empty"), F.bround(F.try_divide(n("ok") * 100.0, attempted), 1).alias("pct_completed"))


def fixes(records: DataFrame, filings: DataFrame) -> DataFrame:
    """(priority, area, subject, n, total): what to mend first, from the aggregates: flags not emitted by rule, convictions to confirm, failed fetches,
    ambiguous claims, and that no claim depends on another. One row that says none where there is nothing."""
    r = records
    flags = r.filter(F.col("rule_name").isin(*C.FLAGS)).groupBy("rule_name").agg(F.count_if("evidence_emitted").alias("n"), F.count("*").alias("total")).filter("n < total")
    every = r.agg(F.count("*").alias("t"), F.count_if(F.col("status") == K.WRONG).alias("w"), F.count_if(F.col("status") == K.AMBIGUOUS).alias("a"), F.count_if("has_graph_dep").alias("g"))
    lost = filings.agg(F.count_if(F.col("pipeline_status") == "fetch_failed").alias("n"), F.count("*").alias("total"))
    row = lambda df, p, area, subject, n, total: df.select(F.lit(p).alias("priority"), F.lit(area).alias("area"), (F.col(subject) if subject in df.columns else F.lit(subject)).alias("subject"), F.expr(n).cast("long").alias("n"), F.expr(total).cast("long").alias("total"))
    out = row(flags, "P1", "extraction", "rule_name", "n", "total").unionByName(row(every.filter("w > 0"), "P1", "review", "convictions", "w", "t")).unionByName(row(lost.filter("n > 0"), "P2", "ingest", "fetches", "n", "total"))
    out = out.unionByName(row(every.filter("a > 0"), "P2", "extraction", "ambiguous", "a", "t")).unionByName(row(every.filter("t > 0 and g = 0"), "P3", "extraction", "dependencies", "g", "t"))
    none = out.agg(F.count("*").alias("c")).filter("c = 0")
    return out.unionByName(row(none, "none", "", "", "0", "0"))


def table_claims(cells: DataFrame, period: str) -> DataFrame:
    """(doc_id, ord, claim fields) of tables whose cells in a period support them: the balance sheet, diluted earnings, cash. cells: in millions."""
    from proofgrid.sources import tables

    labels = {"assets": "Total assets", "liab": "Total liabilities", "equity": "Total shareholders equity", "income": "Net income", "shares": "Diluted shares outstanding", "eps": "Diluted earnings per share", "cf": "Cash and cash equivalents, end", "bs": "Cash and cash equivalents"}
    spark = cells.sparkSession
    want = cells.select("doc_id").distinct().join(F.broadcast(spark.createDataFrame([(k, v) for k, v in labels.items()], "key string, want string"))).withColumn("column", F.lit(period))
    found = tables.lookup(cells, want.drop("key")).join(F.broadcast(spark.createDataFrame([(k, v) for k, v in labels.items()], "key string, want string")), "want")
    x = found.groupBy("doc_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in labels])
    number = lambda k, category=None: F.struct(F.col(k).alias("value"), F.lit("grounded_table_cell").alias("source"), F.lit(category).cast("string").alias("category"))
    all_ = lambda *ks: F.forall(F.array(*ks), lambda v: v.isNotNull())
    claim = lambda rule, operands, variant=None: F.struct(F.lit("internal_consistency").alias("operation"), F.lit(None).cast("double").alias("stated_value"), F.array(*operands).alias("operands"), F.lit(rule).alias("rule_name"), F.lit(variant).cast("string").alias("eps_variant"))
    made = F.array(F.when(all_("assets", "liab", "equity"), claim("balance_sheet_identity", [number("assets"), number("liab"), number("equity")])), F.when(all_("eps", "income", "shares"), claim("eps_reconciliation", [number("eps"), number("income"), number("shares", "diluted")], "diluted")), F.when(all_("cf", "bs"), claim("cash_flow_tie_out", [number("cf"), number("bs")])))
    return x.select("doc_id", F.posexplode(F.array_compact(made)).alias("ord", "q")).select("doc_id", F.col("ord").cast("long").alias("ord"), "q.*")
