"""Predicted claims against gold ones: assignment, evaluation of pairs and documents, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K
from proofgrid.functions import text as T

from .graph import cut

#: Operations whose operands have an order.
ORDERED = ("percent_change", "absolute_change", "difference", "ratio", "margin_percent")
#: Pairs below this score are no match.
LEAST = 0.15
#: The score of a pair that has nothing but the operation in common. No share of words alone gives it.
SAME_OPERATION = 0.3
#: Documents of at most so many pairs are decided each in a row of its own; the others pair by pair, over all tasks.
PAIRS = 100_000


def equal(a: Column, b: Column, rel: float = 0.01, floor: float = 0.05) -> Column:
    """Numbers as near as gold asks; null equals null only."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= F.greatest(F.abs(b) * rel, F.lit(floor)))


def values(operands: Column) -> Column:
    """Operands' values; null for missing ones."""
    return F.transform(operands, lambda o: F.when(o["source"] != "missing", o["value"]))


def same_values(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values in any order: as many nulls, and the others near pair by pair when sorted."""
    real = lambda x: F.array_sort(F.filter(x, lambda v: v.isNotNull()))
    return (F.size(a) == F.size(b)) & (F.size(real(a)) == F.size(real(b))) & F.forall(F.zip_with(real(a), real(b), lambda x, y: equal(x, y)), lambda ok: ok)


def same_grounding(pred: Column, gold: Column) -> Column:
    """Whether operands have the same sources once each gold operand, in turn, has taken the first free predicted one of its value."""
    v = lambda o: F.when(o["source"] != "missing", o["value"])
    step = F.struct(F.sequence(F.lit(0), F.size(pred) - 1).alias("free"), F.lit(True).alias("ok"))

    def take(s: Column, g: Column) -> Column:
        at = F.get(F.filter(s["free"], lambda i: equal(v(F.get(pred, i)), v(g))), F.lit(0))
        return K.bind(at, lambda i: F.struct(F.array_remove(s["free"], F.coalesce(i, F.lit(-1))).alias("free"), (s["ok"] & i.isNotNull() & F.coalesce(F.get(pred, i)["source"] == g["source"], F.lit(False))).alias("ok")))

    return F.when(F.size(pred) != F.size(gold), False).when(F.size(gold) == 0, True).otherwise(F.aggregate(gold, step, take, lambda s: s["ok"]))


def sides(claims: DataFrame, name: str) -> DataFrame:
    """(doc_id, name, words, stated, operation) of claims, written; name is struct(ord, copy): claims of a document that share a number are told apart."""
    own = Window.partitionBy("doc_id", "ord").orderBy("claim_text", "stated_value", "operation")
    x = claims.select("doc_id", "ord", "claim_text", "stated_value", "operation").withColumn("copy", F.row_number().over(own))
    words = F.array_sort(T.tokens(F.col("claim_text"), tuple(T.GOLD_STOPWORDS)))
    return cut(x.select("doc_id", F.struct("ord", "copy").alias(name), words.alias(f"{name}_words"), F.col("stated_value").alias(f"{name}_stated"), F.col("operation").alias(f"{name}_op")))


def worth(words: Column, pred_stated: Column, gold_stated: Column, pred_op: Column, gold_op: Column) -> Column:
    """What a pair's words (their share), stated values and operations have in common."""
    return 3 * words + equal(pred_stated, gold_stated).cast("double") + F.when(F.coalesce(pred_op == gold_op, F.lit(False)), 0.3).otherwise(0.0)


def score() -> Column:
    return worth(T.jaccard(F.col("pred_words"), F.col("gold_words")), *[F.col(c) for c in ("pred_stated", "gold_stated", "pred_op", "gold_op")])


def candidates(p: DataFrame, g: DataFrame) -> DataFrame:
    """(doc_id, pred, gold, score) of the pairs (of sides()) that share a word, or a stated value (or its absence) near enough. Each of these is an equi-join, the
    value by bins: steps a little longer than the tolerance, and shorter than a bin, so that none between is passed over. Pairs that share no more than the operation are not made: matches() counts them off."""
    bin_of = lambda c: F.when(F.abs(c) < 5, F.floor(c / 0.1).cast("double")).otherwise(F.signum(c) * (1000 + F.floor(F.log(F.abs(c)) / 0.02)))
    near = lambda c: F.explode(F.array_distinct(F.array(*[bin_of(c * (1 + d) + e) for d in (-0.0102, 0.0, 0.0102) for e in (-0.051, 0.0, 0.051)])))
    ways = (
        p.select("doc_id", "pred", F.explode("pred_words").alias("k")).join(g.select("doc_id", "gold", F.explode("gold_words").alias("k")), ["doc_id", "k"]),
        p.filter("pred_stated is not null").select("doc_id", "pred", near(F.col("pred_stated")).alias("k")).join(g.filter("gold_stated is not null").select("doc_id", "gold", bin_of(F.col("gold_stated")).alias("k")), ["doc_id", "k"]),
        p.filter("pred_stated is null").select("doc_id", "pred").join(g.filter("gold_stated is null").select("doc_id", "gold"), "doc_id"),
    )
    pairs = None
    for way in ways:
        one = way.select("doc_id", "pred", "gold")
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs.distinct().join(p, ["doc_id", "pred"]).join(g, ["doc_id", "gold"]).select("doc_id", "pred", "gold", score().alias("score")).filter(F.col("score") > LEAST)


def assigned(pairs: DataFrame) -> DataFrame:
    """(doc_id, pred, gold, score) of the pairs that taking the best pair first, again and again, leaves: by score, of equals the larger pred, then the larger gold. A round
    takes all pairs that are the best of both their ends, which that order would take as well, and drops their rivals; so many pairs of all
    documents are decided at once, and no document in one task. The best pair of each document goes in each round at least."""
    order, out = F.struct("score", "pred", "gold"), None
    left = cut(pairs.select("doc_id", "pred", "gold", "score"))
    while not left.isEmpty():
        mine = left.groupBy("doc_id", "pred").agg(F.max(order).alias("best")).select("doc_id", "best.*")
        theirs = left.groupBy("doc_id", "gold").agg(F.max(order).alias("best")).select("doc_id", "best.pred", "best.gold")
        won = cut(mine.join(theirs, ["doc_id", "pred", "gold"]).select("doc_id", "pred", "gold", "score"))
        out = won if out is None else out.unionByName(won)
        left = cut(left.join(won.select("doc_id", "pred"), ["doc_id", "pred"], "left_anti").join(won.select("doc_id", "gold"), ["doc_id", "gold"], "left_anti"))
    return left if out is None else cut(out)


def wide_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """matches() of documents of any size. Steps go down the scores, and each sees only what those before have left: claims that agree in everything; pairs that share a word or a
    value; pairs that share the operation alone, which all have one score and so pair off in order, without being made; pairs with few common words."""
    p, g = sides(pred, "pred"), sides(gold, "gold")
    found = None

    def free(x: DataFrame, side: str) -> DataFrame:
        return x if found is None else x.join(found.select("doc_id", side), ["doc_id", side], "left_anti")

    def keep(more: DataFrame) -> DataFrame:
        return more if found is None else found.unionByName(more)

    alike = p.join(g.withColumns({"pred_words": F.col("gold_words"), "pred_op": F.col("gold_op")}), ["doc_id", "pred_words", "pred_op"]).filter((F.size("pred_words") > 0) & equal(F.col("pred_stated"), F.col("gold_stated")))
    found = keep(assigned(alike.select("doc_id", "pred", "gold", score().alias("score"))))
    some = cut(candidates(free(p, "pred"), free(g, "gold")))
    found = keep(assigned(some.filter(F.col("score") > SAME_OPERATION)))
    place = lambda x, side: free(x, side).filter(F.col(f"{side}_op").isNotNull()).select("doc_id", side, F.col(f"{side}_op").alias("op"), F.row_number().over(Window.partitionBy("doc_id", f"{side}_op").orderBy(F.desc(side))).alias("place"))
    found = keep(cut(place(p, "pred").join(place(g, "gold"), ["doc_id", "op", "place"]).select("doc_id", "pred", "gold", F.lit(SAME_OPERATION).alias("score"))))
    found = keep(assigned(free(free(some.filter(F.col("score") < SAME_OPERATION), "pred"), "gold")))
    rest = lambda x, side: free(x, side).select("doc_id", F.col(f"{side}.ord").alias(side))
    both = found.select("doc_id", F.col("pred.ord").alias("pred"), F.col("gold.ord").alias("gold"), "score")
    return both.unionByName(rest(g, "gold"), allowMissingColumns=True).unionByName(rest(p, "pred"), allowMissingColumns=True)


def row_matches(claims: DataFrame) -> DataFrame:
    """matches() of documents whose pairs fit in a row (claims of both sides, with gold: which side): claims go to their document once, and neither they nor pairs are written.
    Claims are taken by their places in the order of number, text, value and operation, so claims that share a number are told apart."""
    claim = F.struct("ord", "claim_text", "stated_value", "operation")
    side = lambda gold: F.array_sort(F.collect_list(F.when(F.col("gold") == gold, claim)))
    telling = lambda cs: F.transform(cs, lambda c: F.struct(c["ord"].alias("ord"), T.tokens(c["claim_text"], tuple(T.GOLD_STOPWORDS)).alias("words"), c["stated_value"].alias("stated"), c["operation"].alias("op")))

    def pair(p: Column, i: Column, g: Column, j: Column) -> Column:
        common = F.size(F.array_intersect(p["words"], g["words"]))
        return F.struct(worth(F.coalesce(F.try_divide(common, F.size(p["words"]) + F.size(g["words"]) - common), F.lit(0.0)), p["stated"], g["stated"], p["op"], g["op"]).alias("score"), i.alias("pred"), j.alias("gold"))

    def pairs(p: Column, g: Column) -> Column:
        return F.flatten(F.transform(p, lambda x, i: F.filter(F.transform(g, lambda y, j: pair(x, i, y, j)), lambda s: s["score"] > LEAST)))

    def taken(every: Column) -> Column:
        start = F.array().cast("array<struct<score: double, pred: int, gold: int>>")
        return F.aggregate(F.sort_array(every, asc=False), start, lambda won, x: F.when(F.exists(won, lambda w: (w["pred"] == x["pred"]) | (w["gold"] == x["gold"])), won).otherwise(F.array_append(won, x)))

    def result(p: Column, g: Column, won: Column) -> Column:
        row = lambda pred, gold, score: F.struct(pred.alias("pred"), gold.alias("gold"), score.alias("score"))
        no, none = F.lit(None).cast(claims.schema["ord"].dataType), F.lit(None).cast("double")
        free = lambda cs, at: F.filter(cs, lambda c, i: ~F.exists(won, lambda w: w[at] == i))
        both = F.transform(won, lambda w: row(F.get(p, w["pred"])["ord"], F.get(g, w["gold"])["ord"], w["score"]))
        return F.concat(both, F.transform(free(g, "gold"), lambda c: row(no, c["ord"], none)), F.transform(free(p, "pred"), lambda c: row(c["ord"], no, none)))

    whole = K.bind(F.struct(telling(F.col("p")).alias("p"), telling(F.col("g")).alias("g")), lambda d: K.bind(taken(pairs(d["p"], d["g"])), lambda won: result(d["p"], d["g"], won)))
    lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("lone")  # claims of no document match nothing
    return claims.select("*", lone).groupBy("doc_id", "lone").agg(side(False).alias("p"), side(True).alias("g")).select("doc_id", F.inline(whole))


def matches(pred: DataFrame, gold: DataFrame, most: int = PAIRS) -> DataFrame:
    """(doc_id, pred, gold, score): one-to-one assignment within a document, the best score first, of equals the larger numbers first, and what is left over with a
    null on the other side. Claims of a document that share a number are claims of their own, each with its row; of those the one with the larger text, value and
    operation comes first. Documents of more than most pairs are decided over all tasks, with the same result."""
    of = lambda x: x.select("doc_id", "ord", "claim_text", "stated_value", "operation")
    sizes = pred.select("doc_id", F.lit(0).alias("gold")).unionByName(gold.select("doc_id", F.lit(1).alias("gold"))).groupBy("doc_id").agg(F.count_if(F.col("gold") == 0).alias("p"), F.count_if(F.col("gold") == 1).alias("g"))
    large = cut(sizes.filter((F.col("p") * F.col("g") > most) & F.col("doc_id").isNotNull()).select("doc_id"))
    some = not large.isEmpty()
    small = lambda x, side: (x.join(large, "doc_id", "left_anti") if some else x).withColumn("gold", F.lit(side))
    rows = row_matches(small(of(pred), False).unionByName(small(of(gold), True)))
    return rows.unionByName(wide_matches(of(pred).join(large, "doc_id", "left_semi"), of(gold).join(large, "doc_id", "left_semi"))) if some else rows


def evaluated(pairs: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row a pair of matches: matched, spurious, operation_ok, stated_ok, order_ok (null where order means nothing or a gold operand is missing),
    order_flip, grounding_ok, fully_correct, verdict_agree. pred and gold are verdicts: doc_id, ord, operation, stated_value, operands, status."""
    side = lambda x, s: x.select("doc_id", F.col("ord").alias(s), F.col("operation").alias(f"{s}_op"), F.col("stated_value").alias(f"{s}_stated"), F.col("operands").alias(f"{s}_operands"), F.col("status").alias(f"{s}_status"))
    x = pairs.select("doc_id", "pred", "gold").join(side(pred, "pred"), ["doc_id", "pred"], "left").join(side(gold, "gold"), ["doc_id", "gold"], "left")
    both = F.col("pred").isNotNull() & F.col("gold").isNotNull()
    a, b = values(F.col("pred_operands")), values(F.col("gold_operands"))
    asks = F.col("gold_op").isin(*ORDERED) & ~F.exists(b, lambda v: v.isNull()) & (F.size(a) == F.size(b))
    order = F.when(both & asks, F.forall(F.zip_with(a, b, lambda p, g: equal(p, g)), lambda ok: ok))
    sorted_ = lambda v: F.array_sort(F.filter(v, lambda y: y.isNotNull()))
    x = x.withColumns({
        "matched": both, "spurious": F.col("gold").isNull(), "operation_ok": F.when(both, F.col("pred_op") == F.col("gold_op")), "stated_ok": F.when(both, equal(F.col("pred_stated"), F.col("gold_stated"))), "order_ok": order,
        "order_flip": F.coalesce(~order & (sorted_(a) == sorted_(b)), F.lit(False)), "grounding_ok": F.when(both, same_grounding(F.col("pred_operands"), F.col("gold_operands"))), "operands_ok": F.when(both, same_values(a, b)),
        "verdict_agree": F.coalesce(F.col("pred_status") == F.col("gold_status"), F.lit(False)),
    })
    full = F.coalesce(F.col("operation_ok") & F.col("stated_ok") & F.col("operands_ok") & F.coalesce("order_ok", F.lit(True)) & F.col("grounding_ok"), F.lit(False))
    return x.select("doc_id", "pred", "gold", "matched", "spurious", "operation_ok", "stated_ok", "order_ok", "order_flip", "grounding_ok", full.alias("fully_correct"), "verdict_agree")


def summary(evaluations: DataFrame, *keys: str) -> DataFrame:
    """Counts with each metric's own denominator: gold claims for recall and verdicts, matched ones for the rest, those with an order for order."""
    g = evaluations.groupBy(*keys) if keys else evaluations.groupBy()
    gold = ~F.col("spurious")
    rate = lambda n: (F.count_if(F.col(n)).alias(n), F.count(n).alias(f"{n}_of"))
    return g.agg(F.count_if(gold).alias("total_gold"), F.count_if("matched").alias("recall"), *rate("operation_ok"), *rate("stated_ok"), *rate("order_ok"), *rate("grounding_ok"), F.count_if("fully_correct").alias("fully_correct"), F.count_if(gold & F.col("verdict_agree")).alias("verdict_agree"), F.count_if("spurious").alias("spurious"))


def accuracy(verdicts: DataFrame, *keys: str) -> DataFrame:
    """(keys, correct, total, failed) of verdicts with an expected status: gold replays by rule, or all together."""
    g = verdicts.groupBy(*keys) if keys else verdicts.groupBy()
    return g.agg(F.count_if(F.col("status") == F.col("expected_status")).alias("correct"), F.count("*").alias("total"), F.count_if(~F.col("status").eqNullSafe(F.col("expected_status"))).alias("failed"))
