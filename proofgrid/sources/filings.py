"""Filings' feeds as rows: tagged facts, submissions, insider transactions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folders

FACT = "struct<start: string, end: string, val: double, fy: int, fp: string, form: string, filed: string>"
#: An explicit schema: inference would make a struct field of every tag.
COMPANY = f"cik long, entityName string, facts map<string, map<string, struct<units: map<string, array<{FACT}>>>>>"
FEED = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>, items array<string>"
#: Of a filing's folder: its documents by name.
FOLDER = "item array<struct<name: string>>"
FORM4 = "reportingOwner struct<reportingOwnerId: struct<rptOwnerName: string>>, nonDerivativeTable struct<nonDerivativeTransaction: array<struct<securityTitle: struct<value: string>, transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>>>>>"


def facts(companies: DataFrame) -> DataFrame:
    """facts(entity, taxonomy, tag, unit, start, end, val, fy, fp, form, filed, pos) of rows with the COMPANY schema."""
    t = companies.select(F.col("cik").cast("string").alias("entity"), F.explode("facts").alias("taxonomy", "tags"))
    u = t.select("entity", "taxonomy", F.explode("tags").alias("tag", "d")).select("entity", "taxonomy", "tag", F.explode("d.units").alias("unit", "fs"))
    x = u.select("entity", "taxonomy", "tag", "unit", F.posexplode("fs").alias("pos", "f"))
    day = lambda c: F.try_to_date(F.col(f"f.{c}")).alias(c)
    return x.select("entity", "taxonomy", "tag", "unit", day("start"), day("end"), "f.val", "f.fy", "f.fp", "f.form", day("filed"), "pos")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return facts(spark.read.schema(COMPANY).json(path, multiLine=True))


def companies(texts: DataFrame) -> DataFrame:
    """texts (entity, json) with company, a VARIANT that keeps whatever keys the file has; null where it is no JSON."""
    return texts.select("entity", F.try_parse_json("json").alias("company"))


def read_companies(spark: SparkSession, path: str, prefix: str = "_raw_") -> DataFrame:
    """(entity, company) of a folder of company files, each named after its entity; filters on the entity choose files by name."""
    return companies(folders.read_folder(spark, path, prefix).select("entity", F.col("text").alias("json")))


def exploded(rows: DataFrame, column: str, key: str, value: str, place: str | None = None) -> DataFrame:
    """A row for each key of an object, or each place of an array, of a VARIANT column; other kinds of values, and null, have none."""
    rows.createOrReplaceTempView(view := f"__variants_{uuid.uuid4().hex}")
    own = ", ".join(f"t.`{c}`" for c in rows.columns if c != column)
    out = rows.sparkSession.sql(f"SELECT {own}, {f'e.pos AS {place}' if place else f'e.key AS {key}'}, e.value AS {value} FROM {view} t, LATERAL variant_explode(t.`{column}`) e")
    rows.sparkSession.catalog.dropTempView(view)
    return out


def concepts(companies: DataFrame) -> DataFrame:
    """(entity, taxonomy, tag, label, description, units) of company files, read without a schema: units stays a VARIANT."""
    read = lambda path, kind="string": F.try_variant_get("concept", f"$.{path}", kind)
    groups = exploded(companies.filter("company is not null").select("entity", F.try_variant_get("company", "$.facts", "variant").alias("groups")), "groups", "taxonomy", "tags")
    return exploded(groups, "tags", "tag", "concept").select("entity", "taxonomy", "tag", read("label").alias("label"), read("description").alias("description"), read("units", "variant").alias("units"))


def raw_facts(concepts: DataFrame) -> DataFrame:
    """(entity, taxonomy, tag, label, unit, pos, fact, keys) of every fact: the whole VARIANT and the names of all its keys, known or not."""
    units = exploded(concepts.select("entity", "taxonomy", "tag", "label", "units"), "units", "unit", "list")
    x = exploded(units, "list", "", "fact", "pos")
    return x.withColumn("keys", F.coalesce(F.array_sort(F.map_keys(F.try_variant_get("fact", "$", "map<string, variant>"))), F.array().cast("array<string>")))


def typed_facts(raw: DataFrame, *also: Column) -> DataFrame:
    """The columns of facts() of raw facts, and others beside them."""
    get = lambda name, kind: F.try_variant_get("fact", f"$.{name}", kind).alias(name)
    day = lambda name: F.try_to_date(F.try_variant_get("fact", f"$.{name}", "string")).alias(name)
    return raw.select("entity", "taxonomy", "tag", "unit", day("start"), day("end"), get("val", "double"), get("fy", "int"), get("fp", "string"), get("form", "string"), day("filed"), "pos", *also)


def submissions(feeds: DataFrame) -> DataFrame:
    """Filings of parallel arrays (entity and the FEED columns); a ragged array counts as blanks."""
    n = F.size("accessionNumber")
    at = lambda c: F.when(F.size(c) == n, F.get(c, F.col("pos"))).otherwise("").alias(c)
    x = feeds.withColumn("pos", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return x.select("entity", "pos", *[at(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "items")])


def latest_filing(filings: DataFrame, form: str = "10-K") -> DataFrame:
    """The first filing of exactly a form in each feed; amendments don't count."""
    return filings.filter(F.col("form") == form).groupBy("entity").agg(F.min_by(F.struct("accessionNumber", "filingDate", "reportDate", "primaryDocument"), "pos").alias("f")).select("entity", "f.*")


def cik_lookup(wanted: DataFrame, tickers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, unknown): wanted (ticker) with cik and title of exactly that ticker in any case, and those that are not there."""
    key = F.upper(F.trim("ticker"))
    own, known = wanted.withColumn("ticker", key), tickers.select(key.alias("ticker"), "cik", "title").dropDuplicates(["ticker"])
    return own.join(known, "ticker"), own.join(known, "ticker", "left_anti")


def with_industry(entities: DataFrame, codes: DataFrame) -> DataFrame:
    """entities (ticker) with sic and sic_description; null where the code is not known. codes: ticker, sic, sic_description."""
    key = F.upper(F.trim("ticker"))
    return entities.withColumn("ticker", key).join(codes.select(key.alias("ticker"), "sic", "sic_description").dropDuplicates(["ticker"]), "ticker", "left")


def form4_filings(filings: DataFrame, most: int = 10) -> DataFrame:
    """The first filings of form 4 of each feed, in its order, at most so many (the feature)."""
    w = Window.partitionBy("entity").orderBy("pos")
    return filings.filter("form = '4'").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)


def ownership_document(names: Column) -> Column:
    """The first name of a folder that is an XML document and no style sheet."""
    return F.get(F.filter(names, lambda n: F.lower(n).endswith(".xml") & ~F.lower(n).startswith("xsl")), F.lit(0))


def two_feeds(timeline: DataFrame, other: DataFrame, form: str = "10-K") -> DataFrame:
    """(entity, ok, detail): whether both feeds have the same latest filing of a form. timeline: entity, form, filing_date, accession; other: entity,
    accession, filing_date, pos, in feed order."""
    ours = timeline.filter(F.col("form") == form).groupBy("entity").agg(F.max(F.struct("filing_date", "accession")).alias("a"))
    theirs = other.groupBy("entity").agg(F.min_by(F.struct("filing_date", "accession"), "pos").alias("b"))
    x = ours.join(theirs, "entity", "full")
    same = (F.col("a.accession") == F.col("b.accession")) & (F.col("b.filing_date").isNull() | (F.col("a.filing_date") == F.col("b.filing_date")))
    return x.select("entity", F.coalesce(same, F.lit(False)).alias("ok"), F.when(F.col("a").isNull(), "no filing in timeline").when(F.col("b").isNull(), "no filing in the other feed").when(same, "agrees").otherwise("mismatch").alias("detail"))


GOLD = "documents array<struct<id: string, name: string, source: string, summary: string, gold_claims: array<struct<id: string, claim_text: string, operation: string, stated_value: double, operands: array<struct<value: double, source: string, source_text: string>>, unit: string, expected_status: string>>>>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ord, claim fields, expected_status) of gold files."""
    d = spark.read.schema(GOLD).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    return d.select(F.col("d.id").alias("doc_id"), F.posexplode("d.gold_claims").alias("ord", "c")).select("doc_id", F.col("ord").cast("long").alias("ord"), "c.*")


def read_replays(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, raw) of files with what a model answered, one a ticker."""
    return spark.read.schema("ticker string, raw string").json(path, multiLine=True).select(F.upper("ticker").alias("doc_id"), F.coalesce("raw", F.lit("[]")).alias("raw"))


def read_replay_folder(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """The same of a folder with a file a ticker, named after it in upper case; of tickers only their files are opened."""
    files = folders.read_folder(spark, path)
    some = files if tickers is None else files.filter(F.col("entity").isin([t.upper() for t in tickers]))
    return some.select(F.col("entity").alias("doc_id"), F.coalesce(F.get_json_object("text", "$.raw"), F.lit("[]")).alias("raw"))


def replayed(wanted: DataFrame, replays: DataFrame) -> DataFrame:
    """wanted (doc_id) with raw and available; without a replay an empty array, and not available."""
    return wanted.join(replays, "doc_id", "left").withColumns({"available": F.col("raw").isNotNull(), "raw": F.coalesce("raw", F.lit("[]"))})


def example_of(requests: DataFrame, examples: DataFrame) -> DataFrame:
    """requests (source, summary) with the example's id whose texts are the same but for white space; null where there is none."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    known = examples.select(flat("source").alias("__s"), flat("summary").alias("__t"), F.col("id").alias("example_id")).dropDuplicates(["__s", "__t"])
    return requests.withColumns({"__s": flat("source"), "__t": flat("summary")}).join(known, ["__s", "__t"], "left").drop("__s", "__t")


def newest_file(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The file that was written last of those with a name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def latest_run(runs: DataFrame, mode: str = "replay") -> DataFrame:
    """The records of the newest run of a mode, and of no other: an entity that it does not have has none. runs: run_id, at, mode, and records."""
    last = runs.filter(F.col("mode") == mode).agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))
    return runs.join(F.broadcast(last), "run_id", "left_semi")


def requested(filings: DataFrame, tickers: list[str] | None = None, most: int | None = None) -> DataFrame:
    """A filing set cut to tickers, in any case, and then to the first so many by their place."""
    x = filings if tickers is None else filings.filter(F.upper("ticker").isin(*[t.upper() for t in tickers]))
    return x if most is None else x.orderBy("pos").limit(most)


def forms_of(filings: DataFrame, forms: DataFrame) -> DataFrame:
    """The Form 4 documents (accession, xml) of filings (accession, form), so that no other document is parsed."""
    return forms.join(filings.filter("form = '4'").select("accession"), "accession", "left_semi")


def insider_transactions(forms: DataFrame) -> DataFrame:
    """(entity, accession, owner, code, shares, price, date, title, filed) of Form 4 documents (column xml, and filing_date where there is one); rows without
    readable shares go."""
    filed = F.col("filing_date") if "filing_date" in forms.columns else F.lit(None).cast("date")
    x = forms.select("entity", "accession", filed.alias("filed"), F.from_xml("xml", FORM4).alias("d"))
    t = x.select("entity", "accession", "filed", F.col("d.reportingOwner.reportingOwnerId.rptOwnerName").alias("owner"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    num = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    return t.select("entity", "accession", "owner", F.col("t.transactionCoding.transactionCode").alias("code"), num("t.transactionAmounts.transactionShares.value").alias("shares"), num("t.transactionAmounts.transactionPricePerShare.value").alias("price"), F.try_to_date("t.transactionDate.value").alias("date"), F.coalesce(F.col("t.securityTitle.value"), F.lit("")).alias("title"), "filed").filter("shares is not null")
