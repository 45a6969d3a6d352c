"""Verification kernels: Column expressions that recompute a stated number and name a verdict.

Every kernel returns struct(status, recomputed, delta); delta is stated minus recomputed. Missing or contradictory
evidence gives INSUFFICIENT_EVIDENCE, never WRONG_MATH. Divisions are try_divide, so no row can fail a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERIFIED, WRONG, UNSUPPORTED, AMBIGUOUS = "VERIFIED", "WRONG_MATH", "UNSUPPORTED_NUMBER", "AMBIGUOUS"
UNCHECKED, REVIEW, CONFLICT, INSUFFICIENT, PROPAGATED = "UNCHECKED", "NEEDS_REVIEW", "CONFLICT", "INSUFFICIENT_EVIDENCE", "PROPAGATED_ERROR"
#: Tolerances of the verdicts.
PCT_TOL, REL_TOL, FLOOR = 0.5, 0.005, 1e-9
BS_TOL, EPS_TOL, CASH_TOL, ULP_CAP, SCALE_RATIO = 0.001, 0.005, 0.0001, 0.001, 20.0
TREND_FLAT, AGG_TOL, MDA_BAND = 0.001, 0.005, 2.0
TWO = ("percent_change", "absolute_change", "difference", "ratio", "margin_percent")
MANY = ("sum", "average", "product")
PERCENT = ("percent_change", "margin_percent")
#: Words that assert constancy without a number.
CONSTANCY = ["flat", "stable", "steady", "unchanged", "roughly", "approximately", "about", "around", "in line", "consistent", "comparable", "similar", "modest", "slight", "marginal", "minimal", "negligible"]
#: Phrases of a grounded context.
NCI = r"(?i)(noncontrolling\s+(?:redeemable\s+)?interest|redeemable\s+noncontrolling\s+interest|non-controlling\s+interest|minority\s+interest|limited\s+partners[’']?\s+\w*\s*interest|interest\s+in\s+the\s+operating\s+partnership|redeemable\s+\w*\s*interest)"
REDEEMABLE = r"(?i)(redeemable\s+noncontrolling\s+interest|redeemable\s+operating\s+partnership|redeemable\s+(?:limited\s+)?partnership\s+units?|temporary\s+equity|mezzanine\s+equity|redeemable\s+\w*\s*units?)"
TO_COMMON = r"(?i)(net\s+income\s+(?:applicable|available|attributable)\s+(?:to\s+)?common|net\s+income\s+applicable\s+common|(?:income|earnings)\s+available\s+to\s+common|preferred\s+(?:stock\s+)?dividend|preferred\s+(?:stock\s+)?(?:distributions|redemption))"
RESTRICTED_LABEL = r"(?i)(and\s+restricted\s+cash|restricted\s+cash)"
RESTRICTED_NOTE = r"(?i)\b(restricted\s+cash|escrow|reconcil(?:e|ed|iation|ing)|difference\s+attribut(?:able|ed)|included\s+in\s+cash\s+and\s+cash\s+equivalents)\b"


def verdict(status: Column | str, recomputed: Column | None = None, delta: Column | None = None) -> Column:
    number = lambda x, name: (F.lit(None) if x is None else x).cast("double").alias(name)
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), number(recomputed, "recomputed"), number(delta, "delta"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def recompute(op: Column, v: Column) -> Column:
    """The operation over an array of doubles; null where it does not apply."""
    a, b = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return (
        F.when(op == "percent_change", F.try_divide(b - a, a) * 100)
        .when(op == "absolute_change", b - a)
        .when(op == "difference", a - b)
        .when(op == "ratio", F.try_divide(a, b))
        .when(op == "margin_percent", F.try_divide(a, b) * 100)
        .when(op == "sum", total)
        .when(op == "average", F.try_divide(total, F.size(v)))
        .when(op == "product", F.aggregate(v, F.lit(1.0), lambda s, x: s * x))
        .when(op == "identity", a)
    )


def arity_ok(op: Column, v: Column) -> Column:
    n = F.size(v)
    return F.when(op.isin(*TWO), n == 2).when(op == "identity", n == 1).when(op.isin(*MANY), n >= 2).otherwise(False)


def within(stated: Column, calc: Column, op: Column, pct: float = PCT_TOL, rel: float = REL_TOL) -> Column:
    gap = F.abs(stated - calc)
    return F.when(op.isin(*PERCENT), gap <= pct).otherwise(gap / F.greatest(F.abs(calc), F.lit(FLOOR)) <= rel)


def verify_scalar(op: Column, v: Column, sources: Column, stated: Column, pct: float = PCT_TOL, rel: float = REL_TOL) -> Column:
    """The ladder for plain operations; the first rule that applies decides."""
    calc = recompute(op, v)
    return (
        F.when(op == "unsupported", verdict(UNCHECKED))
        .when(F.exists(sources, lambda s: s == "missing"), verdict(UNSUPPORTED))
        .when(stated.isNull(), verdict(AMBIGUOUS))
        .when(~finite(stated) | F.exists(v, lambda x: ~finite(x)), verdict(AMBIGUOUS))
        .when(~arity_ok(op, v), verdict(AMBIGUOUS))
        .when(~finite(calc), verdict(AMBIGUOUS))
        .otherwise(verdict(F.when(within(stated, calc, op, pct, rel), VERIFIED).otherwise(WRONG), calc, stated - calc))
    )


def classify(stated: Column, calc: Column, absolute: Column | None = None, rel: float | None = None) -> Column:
    gap = F.abs(stated - calc)
    ok = gap <= absolute if absolute is not None else gap / F.greatest(F.abs(calc), F.lit(FLOOR)) <= rel
    return F.when(~finite(stated) | ~finite(calc), verdict(AMBIGUOUS)).otherwise(verdict(F.when(ok, VERIFIED).otherwise(WRONG), calc, stated - calc))


def bind(x: Column, f) -> Column:  # noqa: ANN001
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def declined(result: Column, when: Column) -> Column:
    """A conviction that evidence in the context explains becomes a decline."""
    return bind(result, lambda r: F.when((r["status"] == WRONG) & F.coalesce(when, F.lit(False)), verdict(INSUFFICIENT, r["recomputed"], r["delta"])).otherwise(r))


def balance_sheet(v: Column, complete: Column, nci: Column, redeemable: Column, rel: float = BS_TOL) -> Column:
    a, li, e = (F.get(v, F.lit(i)) for i in range(3))
    return (
        F.when(F.size(v) != 3, verdict(AMBIGUOUS))
        .when((li == 0) & (a != 0) & (e != 0), verdict(INSUFFICIENT))
        .when(~F.coalesce(complete, F.lit(False)), verdict(INSUFFICIENT))
        .otherwise(declined(classify(a, li + e, rel=rel), F.coalesce(nci, F.lit(False)) | F.coalesce(redeemable, F.lit(False))))
    )


def itemized_balance_sheet(assets: Column, parts: Column, equity: Column, complete: Column, rel: float = BS_TOL) -> Column:
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(parts) <= 0) | ~F.coalesce(complete, F.lit(False)), verdict(INSUFFICIENT)).otherwise(classify(assets, total + equity, rel=rel))


def basis(tag: Column) -> Column:
    t = F.lower(F.trim(tag))
    return F.when(t.contains("continu"), "continuing").when(t.contains("common"), "common").when(t.rlike("total|net income|including|consolidated"), "total")


def basis_consistent(eps: Column, income: Column) -> Column:
    a, b = basis(eps), basis(income)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when((a == "total") & (b == "common"), True).otherwise(a == b)


def variant_consistent(variant: Column, category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    shares = F.when(c.contains("basic"), "basic").when(c.contains("diluted"), "diluted")
    return variant == shares


def far_apart(stated: Column, calc: Column) -> Column:
    a, b = F.abs(stated), F.abs(calc)
    return F.coalesce((a >= FLOOR) & (b >= FLOOR) & (F.try_divide(F.greatest(a, b), F.least(a, b)) >= SCALE_RATIO), F.lit(False))


def half_ulp(value: Column) -> Column:
    """Half the last published digit's unit, read from the shortest decimal form of the value."""
    v = F.abs(value)

    def of_digits(p: Column) -> Column:
        frac = F.length(p) - F.instr(p, ".")
        zeros = F.length(p) - 1 - F.length(F.rtrim(F.rtrim(p, F.lit(".")), F.lit("0")))
        half = F.lit(0.5) * F.pow(F.lit(10.0), F.when(frac > 0, -frac).otherwise(zeros))
        return F.when((frac > 0) | (zeros == 0), half).otherwise(F.least(half, v * ULP_CAP))

    digits = F.rtrim(v.try_cast("decimal(38, 21)").cast("string"), F.lit("0"))
    return F.when(~finite(v) | (v == 0), 0.0).when((v >= 1e16) | (v < 1e-4), F.least(F.lit(0.5), v * ULP_CAP)).otherwise(bind(digits, of_digits))


def eps_tolerance(eps: Column, income: Column, shares: Column, floor: float = EPS_TOL) -> Column:
    own = bind(half_ulp(eps), lambda h: F.when((eps == F.floor(eps)) & (h > floor), F.lit(floor)).otherwise(h))
    spread = own + F.try_divide(half_ulp(income), F.abs(shares)) + F.try_divide(F.abs(income), shares * shares) * half_ulp(shares)
    return F.when((shares == 0) | ~finite(eps) | ~finite(income) | ~finite(shares), floor).otherwise(F.greatest(F.lit(floor), spread))


def eps(v: Column, eps_basis: Column, income_basis: Column, to_common: Column) -> Column:
    stated, income, shares = (F.get(v, F.lit(i)) for i in range(3))
    calc, same = F.try_divide(income, shares), basis_consistent(eps_basis, income_basis)
    return (
        F.when(F.size(v) != 3, verdict(AMBIGUOUS))
        .when(~F.coalesce(same, F.lit(False)), verdict(INSUFFICIENT))
        .when(shares == 0, verdict(AMBIGUOUS))
        .when(far_apart(stated, calc), verdict(INSUFFICIENT, calc))
        .otherwise(declined(classify(stated, calc, absolute=eps_tolerance(stated, income, shares)), to_common))
    )


def cash(v: Column, restricted: Column, rel: float = CASH_TOL) -> Column:
    flow, sheet = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    return F.when(F.size(v) != 2, verdict(AMBIGUOUS)).when(F.coalesce(restricted, F.lit(False)), verdict(INSUFFICIENT)).otherwise(classify(flow, sheet, rel=rel))


def restricted_flag(flag: Column, label: Column, note: Column) -> Column:
    """The cash line's own label decides over the flag; a note nearby only where the flag is not set."""
    return F.when(F.coalesce(label, F.lit("")).rlike(RESTRICTED_LABEL), True).when(flag.isNull() & F.coalesce(note, F.lit("")).rlike(RESTRICTED_NOTE), True).otherwise(flag)


def steps(v: Column) -> Column:
    """(before, after) of neighbours of a series, in its given order."""
    return F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def trend(v: Column, direction: Column) -> Column:
    flat = lambda p: F.abs(p["b"] - p["a"]) <= F.greatest(F.abs(p["a"]), F.lit(FLOOR)) * TREND_FLAT
    ok = F.when(direction == "up", F.forall(steps(v), lambda p: p["b"] > p["a"])).when(direction == "down", F.forall(steps(v), lambda p: p["b"] < p["a"])).when(direction == "flat", F.forall(steps(v), flat))
    return F.when((F.size(v) < 2) | ok.isNull(), verdict(AMBIGUOUS)).otherwise(verdict(F.when(ok, VERIFIED).otherwise(WRONG)))


def superlative(periods: Column, v: Column, which: Column, target: Column) -> Column:
    """The target period, or else the last, has the extreme of the series; equality is exact."""
    at = F.when(target.isNull(), F.size(v)).otherwise(F.array_position(periods, target)).cast("int")
    subject = F.get(v, at - 1)
    best = F.when(which == "max", F.array_max(v)).when(which == "min", F.array_min(v))
    return F.when((F.size(v) < 1) | (at < 1) | best.isNull(), verdict(AMBIGUOUS)).otherwise(verdict(F.when(subject == best, VERIFIED).otherwise(WRONG), best, subject - best))


def consecutive(v: Column, direction: Column, stated: Column) -> Column:
    """The trailing run of steps in a direction; flat means equal here."""
    good = lambda p: F.when(direction == "up", p["b"] > p["a"]).when(direction == "down", p["b"] < p["a"]).otherwise(p["b"] == p["a"])
    run = F.aggregate(steps(v), F.lit(0), lambda n, p: F.when(good(p), n + 1).otherwise(0)).cast("double")
    return F.when(direction.isNull() | stated.isNull() | (F.size(v) < 2), verdict(AMBIGUOUS)).otherwise(verdict(F.when(run == stated, VERIFIED).otherwise(WRONG), run, stated - run))


def aggregate_filter(v: Column, stated: Column, mode: Column, rel: float = AGG_TOL) -> Column:
    calc = F.when(mode == "sum", F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).when(mode == "count", F.size(v).cast("double"))
    return F.when(stated.isNull() | calc.isNull() | (F.size(v) < 1), verdict(AMBIGUOUS)).otherwise(classify(stated, calc, rel=rel))


def mda(direction: Column, pct: Column, band: float = MDA_BAND) -> Column:
    agrees = ((direction == "up") & (pct > 0)) | ((direction == "down") & (pct < 0))
    return F.when(direction.isNull() | pct.isNull(), verdict(INSUFFICIENT)).when((F.abs(pct) <= band) | (direction == "flat"), verdict(REVIEW, pct)).otherwise(verdict(F.when(agrees, VERIFIED).otherwise(CONFLICT), pct))


def change_over_prior(prior: Column, current: Column) -> Column:
    """Percent change over the size of the prior value; differs from percent_change where that is negative."""
    return F.try_divide(current - prior, F.abs(prior)) * 100


def definitional_word(text: Column) -> Column:
    """The longest word of constancy in a text, ties by alphabet; null where there is none."""
    words = sorted(CONSTANCY, key=lambda w: (-len(w), w))
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(rf"(^|[^a-z0-9_]){w}([^a-z0-9_]|$)"), w) for w in words])


def definitional(text: Column) -> Column:
    return verdict(F.when(definitional_word(text).isNotNull(), REVIEW).otherwise(UNCHECKED))
