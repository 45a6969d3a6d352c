"""Text kernels: filings' HTML to text, numbers, money, labels and periods, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that filings use.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#160;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8212;", "—"), ("&#8211;", "–")]
#: White space of \s, and of \s by Unicode.
BLANK = " \t\n\x0b\f\r"
ANY_BLANK = BLANK + "\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Money suffixes in millions.
MILLIONS = {"k": 1e-3, "thousand": 1e-3, "thousands": 1e-3, "m": 1.0, "mm": 1.0, "million": 1.0, "millions": 1.0, "b": 1e3, "bn": 1e3, "billion": 1e3, "billions": 1e3, "t": 1e6, "trillion": 1e6, "trillions": 1e6}
MONEY = r"(?i)^\s*\$?\s*(-?\d[\d,]*\.?\d*)\s*(k|mm|m|bn|b|t|thousand|thousands|million|millions|billion|billions|trillion|trillions)?\s*$"
#: Metric keys that conflicts may use.
METRICS = {"total_revenue": "Total revenue", "net_income": "Net income", "total_assets": "Total assets", "total_liabilities": "Total liabilities", "total_equity": "Total stockholders' equity", "gross_profit": "Gross profit", "operating_income": "Operating income", "cash_and_equivalents": "Cash and cash equivalents", "diluted_eps": "Diluted EPS", "basic_eps": "Basic EPS"}
#: Disclosure language, the most specific first.
RESTATED = [r"(?i)\bas\s+restated\b", r"(?i)\bprior[-\s]period\s+adjustment\b", r"(?i)\bpreviously\s+reported\b", r"(?i)\brestatement\b", r"(?i)\brestated\b"]
RECLASSIFIED = [r"(?i)\breclassified\b", r"(?i)\breclassification\b", r"(?i)\brecast\b", r"(?i)\brealigned\b", r"(?i)\bsegment\s+realignment\b", r"(?i)\bconformed\s+to\s+(?:the\s+)?current\s+(?:period\s+)?presentation\b", r"(?i)\bto\s+conform\s+(?:to\s+)?(?:the\s+)?current\s+presentation\b"]

#: What a text with primary statements names, and rows of a balance sheet with their figures.
STATEMENT_TERMS = ("consolidated balance sheet", "consolidated statement income", "consolidated statements of income", "consolidated statement of operations", "consolidated statements of operations", "consolidated statement of cash flows", "consolidated statements of cash flows", "total assets", "net income", "earnings per common share", "weighted average", "cash and cash equivalents")
FIGURE = r"[^0-9]{0,40}\$?\s*[0-9][0-9,]{4,}"
ASSETS_ROW = r"(?i)total\s+assets" + FIGURE
CLAIMS_ROW = r"(?i)(?=[tl])(total\s+liabilities|total\s+(?:stockholders|shareholders|shareowners)['’]?\s+equity|total\s+equity|liabilities\s+and\s+(?:stockholders|shareholders|shareowners|equity))" + FIGURE
#: Number tokens of answers, numbers with a unit of sources, the units in millions.
NUMBER = r"-?\$?\(?\d[\d,]*\.?\d*\)?%?"
NUMBER_UNIT = r"(?i)(-?\$?\s*\d[\d,]*(?:\.\d+)?)\s*(billion|bn|million|mm|m|thousand|k)?"
UNITS = {"billion": 1000.0, "bn": 1000.0, "million": 1.0, "mm": 1.0, "m": 1.0, "thousand": 0.001, "k": 0.001}
#: Shapes of keys and tokens; what may be shown of them in groups.
SECRET = r"(gsk_)[A-Za-z0-9]{8,}|(sk-)(?=[A-Za-z0-9._\-]{8,})(ant-)?[A-Za-z0-9._\-]*|(AIza)[A-Za-z0-9._\-]{8,}|(AQ\.)[A-Za-z0-9._\-]{8,}|(Bearer)\s+[A-Za-z0-9._\-]{8,}"
#: Words that don't tell topics apart in questions, and in gold claims.
STOPWORDS = "the a an is are was were did do does why how what which of to in on for and or with by from at it its this that company s".split()
GOLD_STOPWORDS = "the was were and a an of to in at is its over year with for on from".split()
#: Forward-looking terms of tags, and terms that make them something else.
GUIDANCE = r"(?i)guidance|outlook|projection|forecast|expectedrevenue|expectedearnings"
NOT_GUIDANCE = r"(?i)hedge|hedging|derivative|forecastedtransaction|reinsurance|expectedcost|expectednumber|amortization|tax|qualifying"


def strip_html(html: Column) -> Column:
    x = without_blocks(F.coalesce(html, F.lit("")))
    x = where(F.regexp_replace(x, r"<[^>]+>", " "), "&", decoded)
    x = single_spaces(x)
    x = where(x, "\n", lambda t: F.regexp_replace(F.regexp_replace(t, r"\s*\n\s*", "\n"), r"\n{3,}", "\n\n"))
    return F.btrim(x, F.lit(BLANK))


def without_blocks(html: Column) -> Column:
    """A text without scripts and styles; the expressions only see texts with a tag of their first letter."""
    bare = lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}.*?</{tag}>", " ")
    return once(html, lambda t: F.when(F.contains(t, F.lit("<s")) | F.contains(t, F.lit("<S")), bare(bare(t, "script"), "style")).otherwise(t))


def single_spaces(text: Column) -> Column:
    """One space for each run of spaces, tabs and fixed spaces."""
    x = text
    for char in ("\t", "\u00a0"):
        x = F.replace(x, F.lit(char), F.lit(" "))
    return where(x, "  ", lambda t: F.regexp_replace(t, "  +", " "))


def once(x: Column, f) -> Column:  # noqa: ANN001
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def where(text: Column, char: str, f) -> Column:  # noqa: ANN001
    """f(text) where the text has the character; others are passed over once instead of once a step of f. The text is evaluated once."""
    return once(text, lambda t: F.when(F.contains(t, F.lit(char)), f(t)).otherwise(t))


def decoded(x: Column) -> Column:
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, r"&#x?[0-9a-fA-F]+;", " "), r"&[a-zA-Z]+;", " ")


def table_number(cell: Column) -> Column:
    """A table cell as a number; parentheses are a minus; null where it is none."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    negative = s.rlike(r"^\(.*\)$")
    bare = F.trim(F.regexp_replace(F.when(negative, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s), r"[,$%]", ""))
    value = F.when(bare.rlike(r"^-?\d*\.?\d+$"), bare.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def dirty_number(x: Column) -> Column:
    """A finite number of a claim; words for none are null, suffixes are not scaled but rejected as null, and so are 1e999 and the like."""
    s = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[,$%]", ""))
    v = F.when(s.rlike(r"^-?\d*\.?\d+(e[-+]?\d+)?$"), s.try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def millions(raw: Column) -> Column:
    number, suffix = F.regexp_extract(raw, MONEY, 1), F.lower(F.regexp_extract(raw, MONEY, 2))
    scale = F.create_map(*[F.lit(x) for kv in MILLIONS.items() for x in kv])
    return F.when(raw.rlike(MONEY), F.regexp_replace(number, ",", "").try_cast("double") * F.coalesce(F.try_element_at(scale, suffix), F.lit(1.0)))


def scale_footnote(text: Column) -> Column:
    m = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)in\s+(thousands|millions|billions)", 1))
    return F.when(m != "", F.concat(F.lit("in "), m))


def rescale(value: Column, footnote: Column) -> Column:
    f = F.lower(footnote)
    return F.when(f.contains("thousand"), value * 1e-3).when(f.contains("billion"), value * 1e3).otherwise(value)


def metric(raw: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv]), key)


def period(raw: Column) -> Column:
    q, n = r"(?i)Q([1-4])[\s-]*(\d{4})", r"(\d{4})"
    return F.when(raw.rlike(q), F.concat(F.lit("Q"), F.regexp_extract(raw, q, 1), F.lit("-"), F.regexp_extract(raw, q, 2))).when(raw.rlike(n), F.concat(F.lit("FY"), F.regexp_extract(raw, n, 1)))


def disclosure(context: Column) -> Column:
    """struct(kind, matched): restatement language before reclassification language, the most specific first."""
    c = F.coalesce(context, F.lit(""))
    found = [F.when(c.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(c, p, 0).alias("matched"))) for kind, ps in (("EXPLICIT_RESTATEMENT", RESTATED), ("POSSIBLE_RECLASSIFICATION", RECLASSIFIED)) for p in ps]
    return F.coalesce(*found, F.struct(F.lit("UNEXPLAINED").alias("kind"), F.lit(None).cast("string").alias("matched")))


def numeric_density(text: Column) -> Column:
    """How many numbers of three digits or more a text has; real statements are dense with them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]{2,}(?:\.\d+)?")).cast("long")


def statement_score(text: Column) -> Column:
    """How many of the statement terms a text contains."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(F.array(*map(F.lit, STATEMENT_TERMS)), lambda t: F.contains(low, t)))).cast("long")


def slice_quality(text: Column) -> Column:
    """Whether a text has both rows of the balance sheet identity with their figures, one, or none."""
    t = F.coalesce(text, F.lit(""))
    both = t.rlike(ASSETS_ROW).cast("int") + t.rlike(CLAIMS_ROW).cast("int")
    return F.when(both == 2, "full_identity").when(both == 1, "partial").otherwise("no_identity")


def renderings(value: Column) -> Column:
    """How a text may write a number: plain, with separators, with two places; none for null, NaN and infinity."""
    whole = F.format_string("%.0f", value)
    plain = F.regexp_replace(value.try_cast("decimal(38, 12)").cast("string"), "0+$", "")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%f", value), "0+$", ""), r"\.$", "")
    forms = F.when(value == F.floor(value), F.array(F.concat(whole, F.lit(".0")), whole, F.format_string("%,.0f", value), short)).otherwise(F.array(plain, F.format_string("%.2f", value), F.format_string("%,.2f", value), short))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(forms)))


def context_windows(text: Column, value: Column, around: int = 200) -> Column:
    """The text around each place where a number is written, around characters to each side."""
    text = F.coalesce(text, F.lit(""))

    def places(form: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda s, part: F.struct((s["at"] + F.length(part) + F.length(form)).alias("at"), F.array_append(s["all"], s["at"] + F.length(part)).alias("all"))
        every = F.aggregate(F.split(text, F.concat(F.lit("\\Q"), form, F.lit("\\E"))), zero, step, lambda s: s["all"])
        low = lambda i: F.greatest(i - around, F.lit(0))
        return F.transform(F.slice(every, F.lit(1), F.size(every) - 1), lambda i: F.substring(text, low(i) + 1, i + F.length(form) + around - low(i)))

    return F.flatten(F.transform(renderings(value), places))


def numbers(text: Column) -> Column:
    """The numbers of a text, citations like [F3] left out; parentheses on both sides are a minus."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[F\d+\]", ""), F.lit(NUMBER), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"[,$%]", ""))
    value = lambda t: F.regexp_replace(t, r"[()]", "").try_cast("double")
    return F.filter(F.transform(bare, lambda t: F.when(t.rlike(r"^\(.*\)$"), -value(t)).otherwise(value(t))), lambda x: x.isNotNull())


def withheld(text: Column) -> Column:
    """A text without its numbers."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NUMBER, "[number withheld]")


def allowed(number: Column, facts: Column) -> Column:
    """A number may stand in an answer: an integer up to 12, a fact or its size within half a percent or 0.01, or within half a unit of a fact
    rounded to 0 to 3 places."""
    near = lambda w: (F.abs(number - w) <= F.greatest(F.abs(w) * 0.005, F.lit(0.01))) | F.exists(F.array(*[F.struct(F.bround(w, d).alias("v"), F.lit(10.0**-d / 2 + 1e-9).alias("by")) for d in range(4)]), lambda r: F.abs(number - r["v"]) <= r["by"])
    return ((number == F.floor(number)) & (F.abs(number) <= 12)) | F.exists(facts, lambda w: near(w) | near(F.abs(w)))


def source_numbers(text: Column) -> Column:
    """Every number of a source, and what it is in millions where a unit follows."""
    found = F.zip_with(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_UNIT), F.lit(1)), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_UNIT), F.lit(2)), lambda n, u: F.struct(F.regexp_replace(n, r"[$,\s]", "").try_cast("double").alias("v"), F.lower(u).alias("u")))
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.array_distinct(F.array_compact(F.flatten(F.transform(found, lambda f: F.array(f["v"], f["v"] * F.try_element_at(scale, f["u"]))))))


def redacted(text: Column) -> Column:
    """A text whose keys and tokens are masked but for their first letters."""
    return F.regexp_replace(text, SECRET, "$1$2$3$4$5$6***REDACTED***")


def plain_words(text: Column, edge: str) -> Column:
    """Words between white space, without the characters of edge around them."""
    return F.transform(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: F.btrim(w, F.lit(edge)))


def overlaps(question: Column, text: Column) -> Column:
    """Whether they share a word of more than three letters that is no stop word and has no digit."""
    telling = lambda ws: F.filter(ws, lambda w: (F.length(w) > 3) & ~w.rlike(r"\d") & ~w.isin(*STOPWORDS))
    return F.arrays_overlap(telling(plain_words(question, "?.,!()'\"")), telling(plain_words(text, "?.,!()'\"$%")))


def forward_looking(tag: Column, label: Column, description: Column) -> Column:
    """struct(raw, candidate): a tag that speaks of what is expected, and one that is not of another kind."""
    hay = F.concat_ws(" ", tag, F.coalesce(label, F.lit("")), F.coalesce(description, F.lit("")))
    return F.struct(hay.rlike(GUIDANCE).alias("raw"), (hay.rlike(GUIDANCE) & ~hay.rlike(NOT_GUIDANCE)).alias("candidate"))


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*stop) if stop else F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
