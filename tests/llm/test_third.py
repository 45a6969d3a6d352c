"""Resampling, packing and the prefix trie against brute force on difficult rows; ranks, places and joins with hot keys."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same
from pyspark.sql import functions as F

from proofgrid.llm import packing, ranges, resampling, trie
from proofgrid.llm import words as W

from .test_llm import edge, edge_rows, empty, sha  # noqa: F401

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_checksums_of_words_and_pairs():
    rng = random.Random(4)
    texts = ["", "a", "Hello World foo", "é" * 40 + " x " + "b" * 100 + " c", " ".join("w" * rng.randint(1, 70) for _ in range(50)), "x" * 64 + " " + "y" * 65 + " " + "z" * 64, "  ,, "]
    for lo, hi, data, offsets in W.chunks(pa.array(texts)):
        found, n = resampling.buckets(data, offsets)
        found, at = found.tolist(), 0
        for t, k in zip(texts[lo:hi], n, strict=True):
            w = re.findall(WORD, lowered(t))
            assert [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]] == found[at : at + k]
            at += k


def test_resampling_edges(spark, edge):  # noqa: F811
    same(resampling.query(spark, edge), resampling.SQL, edge)


def test_resampling_of_many_copies(spark, tmp_path, monkeypatch):
    """A third of all rows has one text; so few keys count as hot that copies go both ways through the join."""
    monkeypatch.setattr(ranges, "SHARE", 6)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["red", "Green", "blue", "x1"]) for _ in range(rng.randrange(60)))
    common, second = text() + " red" * 30, text() + " blue" * 30
    rows = [(i, common if i % 3 == 0 else second if i % 10 == 1 else rng.choice([None, "", text()])) for i in range(400)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "rank": ["clash"] * 400, "key": [1] * 400}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": ["a", "b"], "text": ["red green red", None]}), tmp_path / "benchmark.parquet")
    same(resampling.query(spark, str(tmp_path)), resampling.SQL, str(tmp_path))


def test_ranks_and_places_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, rng.randrange(50)]), rng.choice([None, *range(6)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, i long")
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    got = ranges.ranked(df, F.asc("k"), F.asc_nulls_first("t"), F.asc("i")).collect()
    assert [(r.k, r.t, r.i) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 901))
    seen: Counter = Counter()
    places = {}
    for r in want:
        places[r] = seen[r[0]]
        seen[r[0]] += 1
    assert {(r.k, r.t, r.i): r.pos for r in ranges.numbered(df, "k", F.asc_nulls_first("t"), F.asc("i")).collect()} == places


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_edges(spark, edge, tokenizer):  # noqa: F811
    rows = edge_rows() + [(900, "a <|endoftext|> b<|endoftext|>"), (901, "it's  two spaces and 数字12 é\n\n \t x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    for size in (1024, 7):
        import public_tokenizers

        tokens = packing.tokenized(df, public_tokenizers.path(packing.MODEL_NAME))
        got = packing.pieces(tokens, size).collect()
        ids = defaultdict(list)
        for i, t in rows:
            ids[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
        laid: dict[int, dict[int, int]] = defaultdict(dict)
        for r in got:
            assert 0 < r.length <= size and r.offset + r.length <= size
            fits = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x[r.start : r.start + r.length])) == r.ids_crc32]
            assert fits
            for k, v in enumerate(fits[0][r.start : r.start + r.length]):
                assert r.offset + k not in laid[r.sequence_id]
                laid[r.sequence_id][r.offset + k] = v
        total = sum(len(x) for many in ids.values() for x in many)
        assert sum(r.length for r in got) == total and sorted(laid) == list(range(-(-total // size))) and all(sorted(x) == list(range(len(x))) for x in laid.values())
        assert all(len(x) == size for s, x in laid.items() if s < max(laid))
        made = {r.sequence_id: r for r in packing.sequences(tokens, size).collect()}
        for s, x in laid.items():
            n = len(x)
            assert bytes(made[s].ids) == b"".join(x[k].to_bytes(4, "little") for k in range(n)) and made[s].n_tokens == n
            assert made[s].padded == (n if n & (n - 1) == 0 else size)
        assert len(made) == len(laid)


def test_packing_encodes_as_the_library_does(tokenizer):
    encode, _ = packing.encoder(tokenizer.to_str())
    assert packing.plain_ranks(__import__("json").loads(tokenizer.to_str()))
    rng = random.Random(8)
    chars = [*"ab Z'srevmld1.!? \n\t", "é", "ß", "数", " ", " ", "\U0001f600", "́", "²", "�", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)] + [a * 5000 for a in "a é!"]
    assert [list(x) for x in encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def brute_trie(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    ends = {p: sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends[p]) for p, m in members.items())


def conversations(rng: random.Random, n: int) -> list[tuple]:
    """Conversations of few different turns, so that long prefixes are shared; one has a third of all rows, some are whole copies, some have null or equal turns."""
    rows = []
    for c in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            rows += [(c * 7, t, "user", f"same turn {t}") for t in range(rng.choice([9, 40]))]
        else:
            rows += [(c * 7, rng.choice([t, None, 2]) if kind == 1 else t, rng.choice(["user", None]), rng.choice([None, "", "a b", f"own {c}"])) for t in range(rng.randrange(8))]
    rows += [(0, t, "user", f"same turn {t}") for t in range(len(rows) // 2)] + [(None, 0, "user", "x"), (3, 1, "user", "x" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_meets_brute_force(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(trie, "MOST", 16)
    monkeypatch.setattr(trie, "BLOCK", 32)
    monkeypatch.setattr(trie, "STRETCH", 8)
    monkeypatch.setattr(ranges, "SHARE", 20)
    rows = conversations(random.Random(seed), 60)
    cols = dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))
    pq.write_table(pa.table({**{k: pa.array(v, pa.int64() if k in ("conv_id", "turn") else pa.string()) for k, v in cols.items()}, "depth": ["clash"] * len(rows), "pos": [0] * len(rows)}), tmp_path / "conversations.parquet")
    q = trie.query(spark, str(tmp_path))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert q.columns == cols
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in q.collect()), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_of_turnless_conversations(spark, tmp_path):
    """A conversation whose only turns are replaced by those of one that is not there stays as a member of the root."""
    rows = [(c, 0, "user", "hi there") for c in range(21, 40)]
    pq.write_table(pa.table({"conv_id": [r[0] for r in rows], "turn": [0] * len(rows), "role": ["user"] * len(rows), "text": ["hi there"] * len(rows)}), tmp_path / "conversations.parquet")
    got = sorted((tuple(r) for r in trie.query(spark, str(tmp_path)).collect()), key=lambda r: (r[1], r[0]))
    assert got == sorted(brute_trie(rows), key=lambda r: (r[1], r[0])) and got[0][3] == 19
    only = [(c, 0, "user", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    pq.write_table(pa.table({"conv_id": [r[0] for r in only], "turn": [0] * len(only), "role": ["user"] * len(only), "text": ["x"] * len(only)}), tmp_path / "conversations.parquet")
    assert [tuple(r) for r in trie.query(spark, str(tmp_path)).collect()] == brute_trie(only)
