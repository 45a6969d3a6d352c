"""Model output as claims: an array, an object that wraps one, or fenced text, with rejected elements kept aside.

All of it runs in the JVM: Spark's JSON reader itself stops at the end of the first array, quotes and escapes honoured. Every element
is read for itself, so that one that is malformed costs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import text as T

OPERAND = "value string, source string, source_text string, source_span array<int>, doc_id string, category string, category_scheme_version string"
ELEMENT = f"claim_text string, operation string, stated_value string, operands array<struct<{OPERAND.replace(' ', ': ').replace(',:', ',')}>>, unit string, source_text string, notes string, rule_name string, eps_variant string, trend_dir string, superlative string, params map<string, string>, node_id string, depends_on array<string>"
TYPED = "array<struct<value: double, source: string, source_text: string, source_span: array<int>, doc_id: string, category: string, category_scheme_version: string>>"
#: Names of operations and sources, and what else models call them.
OPERATIONS = "percent_change absolute_change sum difference ratio margin_percent average product identity unsupported internal_consistency trend_direction superlative consecutive_count aggregate_filter mda_xbrl_consistency definitional_flag".split()
SOURCES = "grounded inferred missing grounded_table_cell grounded_prose category_inferred".split()
OPERATION_ALIASES = {"percentchange": "percent_change", "percentage_change": "percent_change", "growth_rate": "percent_change", "change_percent": "percent_change", "margin": "margin_percent", "gross_margin": "margin_percent", "net_margin": "margin_percent", "operating_margin": "margin_percent", "divide": "ratio", "quotient": "ratio", "addition": "sum", "subtract": "difference"}
SOURCE_ALIASES = {"grounded_table": "grounded_table_cell", "table_cell": "grounded_table_cell", "prose": "grounded_prose", "grounded_text": "grounded"}
#: Words of a direction, an extreme and a share count.
CHOICES = {"trend_dir": ("up", "down", "flat"), "superlative": ("max", "min"), "eps_variant": ("basic", "diluted")}


def array_text(raw: Column) -> Column:
    """The text from the start of the first array on; of an object, its first list. Null where there is none."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    body = F.regexp_replace(F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).otherwise(raw), r"^\s+|\s+$", "")
    walk = F.when(F.instr(body, "[") > 0, F.substr(body, F.instr(body, "[")))
    first = F.to_json(F.get(F.filter(F.map_values(F.from_json(body, "map<string, variant>")), lambda v: F.schema_of_variant(v).startswith("ARRAY")), F.lit(0)))
    return F.when(body.startswith("{"), F.coalesce(first, walk)).otherwise(walk)


def elements(texts: DataFrame) -> DataFrame:
    """(doc_id, ord, element): the elements of each text's array as JSON; one row with a null ord for a text without one. texts: doc_id, raw."""
    return texts.select("doc_id", "raw", array_text(F.col("raw")).alias("__array")).select("doc_id", "raw", "__array", F.posexplode_outer(F.from_json("__array", "array<string>")).alias("ord", "element"))


def name(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), key), key) if aliases else key


def no_number(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"[,$%\s]", "").isin("", "n/a", "na", "none", "null")


def parsed(texts: DataFrame) -> DataFrame:
    """(doc_id, ord, ok, reason, note, claim fields): every element of a text, however many; ok false, with a reason, where it can't be a
    claim; an empty array has no row, a text without one a single row without ord. Missing operands keep a null value."""
    x = elements(texts).withColumn("c", F.from_json("element", ELEMENT)).filter("ord is not null or __array is null or from_json(__array, 'array<string>') is null")
    op, stated = name(F.col("c.operation"), OPERATION_ALIASES), T.dirty_number(F.col("c.stated_value"))
    given = F.coalesce("c.operands", F.array().cast(f"array<struct<{OPERAND.replace(' ', ': ').replace(',:', ',')}>>"))
    source = lambda o: F.coalesce(name(o["source"], SOURCE_ALIASES), F.lit("grounded"))
    operands = F.transform(given, lambda o: F.struct(T.dirty_number(o["value"]).alias("value"), source(o).alias("source"), o["source_text"].alias("source_text"), o["source_span"].alias("source_span"), o["doc_id"].alias("doc_id"), o["category"].alias("category"), o["category_scheme_version"].alias("category_scheme_version")))
    reason = (
        F.when(F.col("raw").isNull() | (F.trim("raw") == ""), "empty model response")
        .when(F.col("__array").isNull(), "no JSON array found in model response")
        .when(F.col("ord").isNull(), "JSON decode error")
        .when(~F.coalesce(F.trim("element").startswith("{"), F.lit(False)) | F.col("c").isNull(), "array element is not an object")
        .when(F.col("c.claim_text").isNull(), "no claim text")
        .when(~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "unknown operation")
        .when(stated.isNull() & ~no_number(F.col("c.stated_value")), "stated value is no number")
        .when(F.exists(operands, lambda o: ~o["source"].isin(*SOURCES)), "unknown source")
        .when(F.exists(given, lambda o: T.dirty_number(o["value"]).isNull() & ~no_number(o["value"])), "operand is no number")
        .when(F.exists(operands, lambda o: F.size(o["source_span"]) != 2), "span has no two places")
    )
    for field, known in CHOICES.items():
        reason = reason.when(F.col(f"c.{field}").isNotNull() & ~F.col(f"c.{field}").isin(*known), f"unknown {field}")
    said = F.lower(F.concat_ws(" ", "c.claim_text", "c.source_text", "c.notes", "c.unit"))
    margin = (op == "identity") & (F.size(operands) == 2) & said.contains("margin") & stated.isNotNull()
    one = (op == "identity") & (F.size(operands) > 1) & said.rlike("eps|earnings per share") & ~margin
    note = F.when(F.col("element").rlike(r'[{,]"params":null[,}]'), "repaired: params was null, treated as empty")
    keep = [F.col(f"c.{n}").alias(n) for n in ("unit", "source_text", "notes", "rule_name", "eps_variant", "trend_dir", "superlative")]
    return x.select(
        "doc_id", F.col("ord").cast("long").alias("ord"), reason.isNull().alias("ok"), reason.alias("reason"), note.alias("note"), F.col("c.claim_text").alias("claim_text"),
        F.when(margin, "margin_percent").otherwise(op).alias("operation"), stated.alias("stated_value"), F.when(one, F.slice(operands, 1, 1)).otherwise(operands).cast(TYPED).alias("operands"), *keep,
        F.coalesce("c.params", F.create_map().cast("map<string, string>")).alias("params"), F.col("c.node_id").alias("node_id"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"),
    )


def conflict_figures(texts: DataFrame) -> DataFrame:
    """(doc_id, row_label, column_label, value): figures under one of the ten metrics, of a period and with a number; others are dropped,
    for a figure half understood could make up a conflict."""
    c = F.from_json("element", "metric string, period string, value string")
    x = elements(texts).select("doc_id", "ord", c.alias("c")).select("doc_id", "ord", T.metric(F.col("c.metric")).alias("row_label"), T.period(F.trim("c.period")).alias("column_label"), T.dirty_number(F.col("c.value")).alias("value"))
    return x.filter("row_label is not null and column_label is not null and value is not null").drop("ord")


def directions(texts: DataFrame) -> DataFrame:
    """(doc_id, ord, metric, direction, excerpt, period, confidence, reason): directional claims of a discussion; an unknown direction is kept with
    a reason, an element without metric or excerpt goes."""
    c = F.from_json("element", "metric string, direction string, excerpt string, period string, confidence string")
    x = elements(texts).filter("ord is not null").select("doc_id", F.col("ord").cast("long").alias("ord"), c.alias("c")).select("doc_id", "ord", F.trim("c.metric").alias("metric"), F.lower(F.trim("c.direction")).alias("direction"), F.trim("c.excerpt").alias("excerpt"), "c.period", "c.confidence")
    known = F.coalesce(F.col("direction").isin(*CHOICES["trend_dir"]), F.lit(False))
    return x.filter("metric <> '' and excerpt <> ''").withColumn("reason", F.when(~known, F.concat(F.lit("unknown direction "), F.coalesce("direction", F.lit("")))))


def split_fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]
