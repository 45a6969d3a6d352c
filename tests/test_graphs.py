"""Reachability by bits, cycles, faults and the assignment of claims, against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import gold, graph, reach


@pytest.fixture(scope="module")
def graphs() -> dict:
    """Edges by document: small and large ones (more than a block of 64 nodes), with and without cycles, with edges to themselves."""
    rng, out = random.Random(3), {}
    for d, (n, m, acyclic) in enumerate([*((rng.choice([3, 10, 60, 64]), rng.randrange(1, 70), k % 3 > 0) for k in range(12)), (200, 260, True), (150, 170, False), (65, 100, True)]):
        order, edges = rng.sample(range(n), n), set()
        while len(edges) < min(m, n):
            a, b = rng.randrange(n), rng.randrange(n)
            if not acyclic or a > b:
                edges.add((order[a], order[b]))
        out[d] = edges
    return out


def above(edges: set) -> dict:
    """What each node depends on, with the number of steps, over at least one."""
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
    out = {}
    for v in {x for e in edges for x in e}:
        dist, todo = {}, deque((u, 1) for u in up[v])
        while todo:
            u, k = todo.popleft()
            if u not in dist:
                dist[u] = k
                todo.extend((w, k + 1) for w in up[u])
        out[v] = dist
    return out


def frame(spark, graphs):
    return spark.createDataFrame([(d, a, b) for d, edges in graphs.items() for a, b in sorted(edges)], "doc_id int, src int, dst int")


def test_reach_meets_brute_force(spark, graphs):
    rng = random.Random(5)
    sources = [(d, rng.randrange(60), rng.randrange(9)) for d in graphs for _ in range(3)]
    n, cyclic, best = defaultdict(int), set(), {}
    for d, edges in graphs.items():
        own: dict = {}
        for _, v, o in (s for s in sources if s[0] == d):
            own[v] = min(o, own.get(v, o))
        for v, up in above(edges).items():
            for u in up:
                if u == v:
                    cyclic.add((d, v))
                else:
                    n[d, u] += 1
            near = [(0, own[v])] if v in own else [(k, own[u]) for u, k in up.items() if u in own]
            if near:
                best[d, v] = min(near)
    e = frame(spark, graphs)
    got = reach.reach(e, spark.createDataFrame(sources, "doc_id int, node int, root_ord int"), graph.cut).collect()
    assert {(r.doc_id, r.node): r.n for r in got if r.n} == dict(n)
    assert {(r.doc_id, r.node) for r in got if r.cyclic} == cyclic
    assert {(r.doc_id, r.node): (r.dist, r.root_ord) for r in got if r.dist is not None} == best
    paths = graph.cycle_paths(e).collect()
    assert {r.doc_id for r in paths} == {d for d, _ in cyclic}
    for r in paths:
        assert r.path[0] == r.path[-1] == min(r.path) and len(set(r.path)) == len(r.path) - 1 and set(zip(r.path, r.path[1:], strict=False)) <= graphs[r.doc_id]


def test_faults_meet_brute_force(spark, graphs):
    rng, rows, state, want = random.Random(6), [], {}, {}
    for d, edges in graphs.items():
        nodes = sorted({x for e in edges for x in e})
        for v, o in zip(nodes, rng.sample(range(len(nodes)), len(nodes)), strict=True):
            state[d, v] = (o, rng.choice(["WRONG_MATH", "VERIFIED", "VERIFIED", "UNCHECKED"]))
            rows.append((d, v, *state[d, v]))
        want |= {(d, b): 0 for _, b in edges}
        for v, up in above(edges).items():
            if state[d, v][1] == "WRONG_MATH":
                continue
            own = min(((k, state[d, u][0]) for u, k in up.items() if state[d, u][1] == "WRONG_MATH"), default=None)
            for u, k in up.items():
                if u != v and (own is None or (k, state[d, u][0]) <= own):
                    want[d, u] += 1
    got = graph.injected(spark.createDataFrame(rows, "doc_id int, node int, ord int, status string"), frame(spark, graphs)).collect()
    assert {(r.doc_id, r.root): r.relabelled for r in got} == want


def test_a_chain_of_5000_claims(spark):
    """A row a node, and about log2(n) rounds; a list of pairs would have 12,497,500 rows."""
    e = spark.range(1, 5000).select(F.lit("d").alias("doc_id"), F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    r = reach.reach(e, spark.createDataFrame([("d", 0, 7)], "doc_id string, node long, root_ord int"), graph.cut)
    assert tuple(r.agg(F.count("*"), F.sum("n"), F.max("n"), F.max("dist"), F.count_if("cyclic")).first()) == (5000, 12497500, 4999, 4999, 0)


def test_claims_that_share_a_number_are_matched_one_by_one(spark):
    schema = "doc_id int, ord long, claim_text string, stated_value double, operation string"
    p = [(1, 5, "net income rose", 10.0, "sum"), (1, 5, "cash fell", 3.0, "ratio"), (1, 5, "cash fell", 3.0, "ratio"), (1, 6, None, None, None)]
    g = [(1, 1, "net income rose", 10.0, "sum"), (1, 2, "cash fell", 3.0, "ratio"), (1, 2, "cash fell", 3.0, "ratio"), (1, 2, "no such words", 77.0, "product"), (2, 1, "x", 1.0, "sum")]
    got = sorted(((r.doc_id, r.pred, r.gold) for r in gold.matches(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema)).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 2), (1, 5, 2), (1, None, 2), (1, 6, None), (2, None, 1)], key=str)


def test_pairs_of_one_operation_pair_off_without_being_made(spark):
    """800 claims without a word or value in common, all of one operation: the largest numbers meet, and no list of 640,000 pairs is made."""
    p = spark.range(800).selectExpr("1 as doc_id", "id as ord", "concat('left', id) as claim_text", "cast(id * 1000 + 100 as double) as stated_value", "'sum' as operation")
    g = spark.range(700).selectExpr("1 as doc_id", "id as ord", "concat('right', id) as claim_text", "cast(-id * 1000 - 100 as double) as stated_value", "'sum' as operation")
    rows = gold.matches(p, g).collect()
    assert sorted((r.pred, r.gold) for r in rows if r.gold is not None) == [(k + 100, k) for k in range(700)] and sorted(r.pred for r in rows if r.gold is None) == list(range(100))
    assert gold.candidates(gold.sides(p, "pred"), gold.sides(g, "gold")).isEmpty()


def test_near_values_meet_at_the_edge_of_a_bin(spark):
    """Values within the tolerance and without a common word, where the first lies just over the start of a bin: the bin below was passed over."""
    at = [(-1) ** k * math.exp(0.02 * k + 0.0001) for k in range(300, 900)] + [0.1 * k + 0.001 for k in range(-60, 60)]
    p = spark.createDataFrame([(i, 1, "left", v, "sum") for i, v in enumerate(at)], "doc_id int, ord long, claim_text string, stated_value double, operation string")
    for share in (-0.0099, -0.005, 0.0099):
        g = p.selectExpr("doc_id", "ord", "'right' as claim_text", f"stated_value + if(abs(stated_value) < 5, 5 * {share}, stated_value * {share}) as stated_value", "'ratio' as operation")
        assert {r.score for r in gold.matches(p, g).collect()} == {1.0}


def test_cycles_are_decided_without_a_frame_a_document(spark):
    """Documents of up to 64 claims in rings, decided in streams over all partitions and not a group each; the last edge of every ring goes (F12)."""
    docs = {d: 2 + d % 63 for d in range(130)}
    edges = [(d, i, (i + 1) % n, i) for d, n in docs.items() for i in range(n)]
    new = spark.createDataFrame(edges, "doc_id long, src long, dst long, rank int")
    taken = graph.without_cycles(new)
    plan = taken._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in taken.collect()} == {(d, s, t) for d, s, t, r in edges if r < docs[d] - 1}
    assert {tuple(r) for r in graph.cycles(new).collect()} == {(d, i) for d, n in docs.items() for i in range(n)}
    assert {r.doc_id: r.path for r in graph.cycle_paths(new).collect()} == {d: [*range(n), 0] for d, n in docs.items()}
