"""Pipe tables and multi-document texts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import text as T

#: Lines that start a document, with its label; periods and types that heads and texts name.
HEADERS = (r"(?i)^\s*(?:source\s+)?document\s+([A-Z0-9][\w-]*)\s*[—\-:.]", r"(?i)^\s*={2,}\s*document\s+([\w-]+).*?={2,}\s*$", r"(?i)^\s*(?:exhibit|filing)\s+([A-Z0-9][\w-]*)\s*[—\-:.]")
PERIODS = (r"(?i)\bFY\s?(\d{4})\b", r"(?i)fiscal\s+(?:year\s+)?(\d{4})")
DOC_TYPE = r"(?i)\b(10-K|10-Q|8-K|press\s+release|annual\s+report|earnings\s+release)\b"


def separator(cells: Column) -> Column:
    return F.forall(F.filter(cells, lambda c: c != ""), lambda c: c.rlike(r"^:?-{2,}:?$"))


def cells(texts: DataFrame) -> DataFrame:
    """(doc_id, row_ord, col_ord, row_label, column_label, value, unit_footnote): the first piped line that is no separator is the header of the
    whole text; cells that are no numbers are skipped; a column without a header is col<i>; the first scale footnote holds for all.
    Lines are split and indexed inside a row, so nothing is shuffled."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: x.contains("|"))
    trimmed = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    rows = F.filter(trimmed, lambda c: ~separator(c))
    piped = texts.withColumns({"__rows": rows, "__lines": F.size(lines), "__scale": T.scale_footnote(F.col("text"))}).filter("__lines >= 2")
    body = piped.select("doc_id", F.get("__rows", F.lit(0)).alias("head"), F.posexplode("__rows").alias("row_ord", "cells"), "__scale").filter("row_ord > 0")
    flat = body.select("doc_id", "row_ord", "head", F.get("cells", F.lit(0)).alias("row_label"), F.posexplode("cells").alias("col_ord", "raw"), "__scale").filter("col_ord > 0")
    label = F.coalesce(F.get("head", F.col("col_ord")), F.concat(F.lit("col"), (F.col("col_ord") - 1).cast("string")))
    return flat.select("doc_id", "row_ord", "col_ord", "row_label", label.alias("column_label"), T.table_number(F.col("raw")).alias("value"), F.col("__scale").alias("unit_footnote")).filter("value is not null")


def lookup(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (doc_id, want, column) the cell with exactly that row label, else the first whose label contains it."""
    same = F.lower(F.trim("row_label")) == F.lower(F.trim("want"))
    part = F.contains(F.lower("row_label"), F.lower(F.trim("want")))
    column = F.col("column").isNull() | (F.lower(F.trim("column_label")) == F.lower(F.trim("column")))
    hit = wanted.join(found, "doc_id").filter(column & (same | part))
    return hit.groupBy("doc_id", "want", "column").agg(F.min_by(F.struct("row_label", "column_label", "value"), F.struct(F.when(same, 0).otherwise(1), "row_ord", "col_ord")).alias("c")).select("doc_id", "want", "column", "c.*")


def millions(found: DataFrame) -> DataFrame:
    """Values in millions by the footnote, but for per-share rows."""
    share = F.lower("row_label").rlike(r"per share|per-share|\beps\b|earnings per")
    return found.withColumn("value", F.when(share, F.col("value")).otherwise(T.rescale(F.col("value"), F.col("unit_footnote"))))


def first_of(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that a text has; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def documents(texts: DataFrame) -> DataFrame:
    """(doc_id, part, id, period, doc_type, body): a text with two heads or more is cut at each, and a part's id is its label with its period; others
    stay whole, as DOC_1. A text is cut inside its row, so nothing is shuffled."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    heads = F.filter(F.sequence(F.lit(0), F.size("__l") - 1), lambda i: first_of(F.get("__l", i), *HEADERS).isNotNull())
    x = texts.withColumn("__l", lines).withColumn("__h", heads)
    multi = F.size("__h") >= 2
    spans = F.when(multi, F.transform("__h", lambda h, j: F.struct(h.alias("a"), F.coalesce(F.get("__h", j + 1), F.size("__l")).alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.size("__l").alias("b"))))
    y = x.select("doc_id", "text", "__l", multi.alias("multi"), F.posexplode(spans).alias("part", "s"))
    cut = F.regexp_replace(F.array_join(F.slice("__l", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")), "\n"), r"^\s+|\s+$", "")
    y = y.select("doc_id", "part", "multi", F.get("__l", F.col("s.a")).alias("head"), F.when(F.col("multi"), cut).otherwise(F.coalesce("text", F.lit(""))).alias("body")).filter("not multi or body <> ''")
    period = F.when(F.col("multi"), F.concat(F.lit("FY"), F.coalesce(first_of(F.col("head"), *PERIODS), first_of(F.col("body"), *PERIODS))))
    kind = F.when(F.col("multi"), F.regexp_replace(F.coalesce(first_of(F.col("head"), DOC_TYPE), first_of(F.col("body"), DOC_TYPE)), r"\s+", " "))
    label = F.upper(first_of(F.col("head"), *HEADERS))
    named = F.when(~F.col("multi"), "DOC_1").when(period.isNotNull(), F.concat_ws("_", label, period)).otherwise(F.concat(F.lit("DOC_"), label))
    return y.select("doc_id", F.col("part").cast("long").alias("part"), named.alias("id"), period.alias("period"), kind.alias("doc_type"), "body")
