"""Claim graphs: edges, reachability, cycles, nearest failing root. Edges say that src depends on dst.

What is asked of all nodes at once (dependents, cycles, causes) is answered by bits in reach.py; closure() lists the pairs themselves, breadth first. Every round is
cut by a checkpoint in the shared folder, so lineage stays short and a lost executor costs one round. Paths that meet (diamonds) do not multiply.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions import kernels as K

from . import reach
from .claims import FAILING

MOST_ROUNDS = 1000


class CycleError(ValueError):
    """Claims that depend, over any number of steps, on themselves."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in local mode (tests)."""
    import tempfile

    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="proofgrid-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the user has set, or else the cluster."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def node_of(ord_: str = "ord"):
    """A claim's node: its id; a claim that depends on others without having an id is a node nothing can name."""
    return F.coalesce("node_id", F.when(F.size("depends_on") > 0, F.concat(F.lit("__anon_"), F.col(ord_).cast("string"))))


def edges(claims: DataFrame) -> DataFrame:
    """(doc_id, src, dst) of claims with doc_id, ord, node_id and depends_on; what depends on an unknown node is dropped."""
    wanted = claims.select("doc_id", node_of().alias("src"), F.explode("depends_on").alias("dst")).distinct()
    known = claims.filter("node_id is not null").select("doc_id", F.col("node_id").alias("dst")).distinct()
    return wanted.join(known, ["doc_id", "dst"], "left_semi").select("doc_id", "src", "dst")


def missing_references(claims: DataFrame) -> DataFrame:
    """(doc_id, src, dst) of dependencies on nodes that are not there."""
    wanted = claims.select("doc_id", node_of().alias("src"), F.explode("depends_on").alias("dst")).distinct()
    return wanted.join(claims.select("doc_id", F.col("node_id").alias("dst")).filter("dst is not null").distinct(), ["doc_id", "dst"], "left_anti").select("doc_id", "src", "dst")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The (doc_id, node) of nodes that depend on nothing."""
    return nodes.join(edges.select("doc_id", F.col("src").alias("node")).distinct(), ["doc_id", "node"], "left_anti")


def dependents(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, node, dependent): what directly depends on the nodes (doc_id, node)."""
    return of.join(edges.select("doc_id", F.col("dst").alias("node"), F.col("src").alias("dependent")).distinct(), ["doc_id", "node"])


def closure(edges: DataFrame, roots: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(doc_id, root, node, dist) of everything that depends, over any number of steps, on the roots (doc_id, root); the root itself is left out
    unless a cycle leads back to it."""
    e = edges.select("doc_id", F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    front = cut(roots.select("doc_id", "root", F.col("root").alias("node")).distinct())
    seen = front.select("doc_id", "root", "node", F.lit(0).alias("dist")).filter("false")
    for dist in range(1, most + 1):
        step = front.join(e, ["doc_id", "node"]).select("doc_id", "root", F.col("next").alias("node")).distinct()
        front = cut(step.join(seen, ["doc_id", "root", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front.withColumn("dist", F.lit(dist)))
    raise ValueError(f"no end of the graph after {most} steps")


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges between nodes that reach themselves: every cycle is made of such edges."""
    on = cut(reach.reach(edges, None, cut).filter("cyclic").select("doc_id", "node"))
    return edges.join(on.withColumnRenamed("node", "src"), ["doc_id", "src"], "left_semi").join(on.withColumnRenamed("node", "dst"), ["doc_id", "dst"], "left_semi").select("doc_id", "src", "dst").distinct()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(doc_id, path) of each document with a cycle: the one that the smallest successors lead to from its smallest node on a cycle, from its own smallest node back to it.
    Pointers are doubled, so the rounds are the logarithm of the longest cycle: first every node learns where it is after more steps than there are nodes, and the
    smallest node of the cycle there; then the nodes of that cycle learn how far they are from it."""
    succ = cut(on_cycles(cut(edges)).groupBy("doc_id", F.col("src").alias("node")).agg(F.min("dst").alias("next")))
    most = succ.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jump, steps = succ.withColumn("low", F.least("node", "next")), 1
    while steps < most:
        then = jump.select("doc_id", F.col("node").alias("next"), F.col("next").alias("after"), F.col("low").alias("lower"))
        jump = cut(jump.join(then, ["doc_id", "next"]).select("doc_id", "node", F.col("after").alias("next"), F.least("low", "lower").alias("low")))
        steps *= 2
    start = jump.groupBy("doc_id").agg(F.min_by("next", "node").alias("node"))
    head = cut(start.join(jump.select("doc_id", "node", "low"), ["doc_id", "node"]).select("doc_id", F.col("low").alias("head")))
    ring = jump.select("doc_id", F.col("next").alias("node")).distinct().join(succ, ["doc_id", "node"]).join(head, "doc_id")
    far, steps = cut(ring.select("doc_id", "head", "node", F.col("next").alias("at"), F.lit(1).cast("long").alias("dist"))), 1
    while steps < most:  # a node that has come to the head stays there; those of other cycles never do
        then = far.select("doc_id", F.col("node").alias("at"), F.col("at").alias("after"), F.col("dist").alias("more"))
        there = F.col("at") == F.col("head")
        both = far.join(then, ["doc_id", "at"])
        far = cut(both.select("doc_id", "head", "node", F.when(there, F.col("at")).otherwise(F.col("after")).alias("at"), F.when(there, F.col("dist")).otherwise(F.col("dist") + F.col("more")).alias("dist")))
        steps *= 2
    own = far.filter("at = head").groupBy("doc_id", "head").agg(F.sort_array(F.collect_list(F.struct("dist", "node")), asc=False).alias("nodes"))
    return own.select("doc_id", F.concat(F.transform("nodes", lambda x: x["node"]), F.array("head")).alias("path"))


def assert_acyclic(edges: DataFrame) -> None:
    """Raise CycleError with the path of the first document's cycle, if there is one."""
    first = cycle_paths(edges).orderBy("doc_id").first()
    if first is not None:
        raise CycleError(f"{first.doc_id}: " + " -> ".join(map(str, first.path)))


def cycles(edges: DataFrame) -> DataFrame:
    """(doc_id, node) that reach themselves."""
    return reach.reach(edges, None, cut).filter("cyclic").select("doc_id", "node")


def without_cycles(new: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """The new edges (doc_id, src, dst, rank), not among those given, that close no cycle when they are added to given by rank. Only edges on cycles of all of them together
    need that order; they are decided document by document, the others are taken at once. Documents without a new edge are not looked at."""
    own = ["doc_id", "src", "dst"]
    new = cut(new if given is None else new.join(given, own, "left_anti"))
    if new.isEmpty():
        return new.select(*own)
    every = new.select(*own) if given is None else new.select(*own).unionByName(given.select(*own).join(new.select("doc_id").distinct(), "doc_id", "left_semi"))
    tied = cut(on_cycles(cut(every)))
    free = new.join(tied, own, "left_anti").select(*own)
    if tied.isEmpty():
        return free
    ranked = tied.join(new.select(*own, "rank"), own, "left").select(*own, "rank")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, after = None, {}
        for f in frames:
            taken = []
            for d, src, dst, given_ in zip(f["doc_id"].array, f["src"].array, f["dst"].array, f["given"].array, strict=True):
                if d != doc:
                    doc, after = d, {}
                stack, seen = [] if given_ else [dst], set()
                while stack and src not in seen:
                    at = stack.pop()
                    if at not in seen:
                        seen.add(at)
                        stack += after.get(at, ())
                if src not in seen:
                    after.setdefault(src, []).append(dst)
                taken.append(not given_ and src not in seen)
            yield f.loc[taken, own]

    # many documents a task, one after the other; a group for each would cost a frame each
    inorder = reach.dealt(ranked).sortWithinPartitions("doc_id", F.col("rank").asc_nulls_first(), "src", "dst").select(*own, F.col("rank").isNull().alias("given"))
    return free.unionByName(inorder.mapInPandas(decide, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.select(*own).schema)))


def downstream(edges: DataFrame) -> DataFrame:
    """(doc_id, node, n) of every node with dependents."""
    return reach.reach(edges, None, cut).filter("n > 0").select("doc_id", "node", "n")


def failing(verdicts: DataFrame) -> DataFrame:
    """(doc_id, node, root_ord) of failing claims that others can name."""
    return verdicts.filter(F.col("status").isin(*FAILING) & F.col("node").isNotNull()).select("doc_id", "node", F.col("ord").alias("root_ord"))


def propagate(verdicts: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Whatever depends on a failing claim becomes a propagated error, caused by the nearest failing root, of equals the first by ord.
    A failing claim keeps its verdict. verdicts: doc_id, node, ord, status. reached: reach() from the failing claims, where it is there already."""
    if reached is None:
        reached = reach.reach(edges, failing(verdicts), cut)
    cause = failing(verdicts).withColumnRenamed("node", "caused_by")
    near = reached.filter("dist > 0").select("doc_id", "node", "root_ord").join(cause, ["doc_id", "root_ord"]).select("doc_id", "node", "caused_by")
    hit = F.col("caused_by").isNotNull() & ~F.col("status").isin(*FAILING)
    return verdicts.join(near, ["doc_id", "node"], "left").withColumns({"caused_by": F.when(hit, F.col("caused_by")), "status": F.when(hit, K.PROPAGATED).otherwise(F.col("status"))})


def injected(verdicts: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, root, relabelled): for each node that others depend on, how many claims would be propagated errors caused by it if it alone
    had failed besides those that fail already. verdicts: doc_id, node, ord, status."""
    n = reach.relabelled(edges, verdicts.select("doc_id", "node", "ord", F.col("status").isin(*FAILING).alias("failing")), cut)
    return edges.select("doc_id", F.col("dst").alias("node")).distinct().join(n, ["doc_id", "node"], "left").select("doc_id", F.col("node").alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("relabelled"))


def measured(claims: DataFrame) -> DataFrame:
    """(doc_id, claims, edges, with_upstream, with_downstream, with_evidence, missing_refs) of each document. claims: doc_id, ord, node_id, depends_on,
    source_text."""
    c = claims.withColumns({"node": F.coalesce("node_id", F.concat(F.lit("claim-"), (F.col("ord") + 1).cast("string"))), "depends_on": F.coalesce("depends_on", F.array().cast("array<string>"))})
    wanted = c.select("doc_id", F.col("node").alias("src"), F.explode("depends_on").alias("dst"))
    known = c.select("doc_id", F.col("node").alias("dst"), F.lit(True).alias("there")).distinct()
    refs = wanted.join(known, ["doc_id", "dst"], "left")
    own = c.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("source_text").isNotNull()).alias("with_evidence"))
    e = refs.groupBy("doc_id").agg(F.count_if("there").alias("edges"), F.count_if(F.col("there").isNull()).alias("missing_refs"), F.count_distinct(F.when(F.col("there"), F.col("src"))).alias("with_upstream"), F.count_distinct(F.when(F.col("there"), F.col("dst"))).alias("with_downstream"))
    counts = ("edges", "with_upstream", "with_downstream", "with_evidence", "missing_refs")
    return own.join(e, "doc_id", "left").select("doc_id", "claims", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts])
