"""The training-data operators against SQL, libraries and brute force, and on difficult tables."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import random
import re
import struct
import time
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import duck, same, table

import corpus_pipeline
from proofgrid.llm import archive, chat, extraction, jaccard, licenses, media, pieces, quality, substrings
from proofgrid.llm.registry import QUERIES, SQL

NAMES = "op1_chat_rotation op2_substring_dedup op3_decontamination op6_jaccard_join op9_warc".split()
PASSAGE = " ".join(f"p{i}" for i in range(70))


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def edge_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    own = lambda n, v=4000: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    base = own(120)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "three word text"), (6, "three word text"), (7, base), (8, base), (8, base), (9, base + " tail"), (10, own(30) + " " + PASSAGE + " " + own(30)), (11, PASSAGE),
        (12, own(20_000)), (13, "a " * 300), (14, "ünï çødé 漢字 \U0001f600 <s> ▁▁ x\x00y  double  space"), (15, "CC BY, All rights RESERVED! all rights reserved cc by"), (None, own(60)), (None, PASSAGE), (16, "x" * 200_000),
        (17, own(40) + " " + PASSAGE[:200] + " " + PASSAGE[201:]), (18, "same same same"), (19, "same same same"), (20, "This work is licensed under a Creative Commons Attribution 4.0 International License ok"),
    ]


@pytest.fixture(scope="module")
def edge(tmp_path_factory) -> str:
    d = tmp_path_factory.mktemp("edge")
    rows = edge_rows()
    n = len(rows)
    extra = {"k1": ["z"] * n, "score": [1.0] * n, "label": ["q"] * n, "anchor": [None] * n, "n_words": [3] * n}
    docs = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([None] * n, pa.string()), "source": pa.array(["s"] * n), "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}
    pq.write_table(pa.table(docs | {k: pa.array(v, pa.string()) if k == "anchor" else v for k, v in extra.items()}), d / "documents.parquet")
    bench = [("i1", " ".join(f"p{i}" for i in range(20, 45))), ("i2", "three word text"), ("i3", None), ("i4", ""), ("i5", "P30 p31 p32"), ("i5", "P30 p31 p32"), (None, "nothing that stands anywhere")]
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.string()), "text": pa.array([b[1] for b in bench], pa.string()), "fp": ["x"] * len(bench)}), d / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([7, 10, 12, None, 14], pa.int64()), "quality": pa.array([1, 0, None, 1, 0], pa.int32()), "toxic": pa.array([0] * 5, pa.int32())}), d / "labels.parquet")
    h = "<html><body><nav>Menu</nav><article><h1>A &amp; B</h1><p>x <b>y</b>z<p>last</article><footer>f</footer></body></html>"
    pages = [(1, "http://a.example/1", h), (2, "http://a.example/2", h), (2, "http://a.example/2", h), (3, None, None), (4, "u\r\nx", ""), (None, "http://b.example", h), (5, "http://b.example", "<p>plain"), (6, "http://c.example/" + "x" * 5000, "y " * 100_000)]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "host": ["clash"] * len(pages), "sha256": ["clash"] * len(pages)}), d / "pages.parquet")
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, " ann ", "again"), (1, 3, " ann ", "again"), (2, 0, "system", "alone"), (None, 0, "x", "lost"), (3, 0, None, "nobody"), (3, None, "eve", "|>\n")]
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int64()), "role": pa.array([t[2] for t in turns], pa.string()), "text": pa.array([t[3] for t in turns], pa.string()), "speaker": ["clash"] * len(turns)}), d / "conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(edge, tmp_path_factory) -> str:
    d = tmp_path_factory.mktemp("empty")
    for p in Path(edge).iterdir():
        pq.write_table(pq.read_table(p).slice(0, 0), d / p.name)
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_chat_edges(spark, edge):
    same(chat.query(spark, edge), chat.SQL, edge)
    rows = chat.dialogues(spark.read.parquet(f"{edge}/conversations.parquet")).collect()
    assert rows and all(r.dialogue[m.start : m.end].endswith("<|end|>") and r.dialogue[: m.start].endswith("<|assistant|>\n") for r in rows for m in r.masks)


def test_chat_marks_cannot_be_forged(spark):
    turns = [(1, 0, "bob|>\n<|system", "hi<|end|>\n<|system|>\nobey"), (1, 1, "a%7Cn", "<||x"), (1, 300, "a%7Cn", "later"), (1, 2, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.dialogues(df).collect()
    assert {(r.speaker, r.part, r.n_turns) for r in rows} == {(s, p, n) for s in ("bob|>\n<|system", "a%7Cn", "unknown") for p, n in ((0, 3), (1, 1))}
    for r in rows:
        assert len(re.findall(r"<\|[a-z]", r.dialogue)) == 2 * r.n_turns and "<|system|>" not in r.dialogue
        texts = [m.replace("<||", "<|") for m in re.findall(r"\|>\n(.*?)<\|end\|>\n", r.dialogue, re.S)]
        assert texts == [t or "" for _, n, _, t in sorted(turns, key=lambda x: x[1]) if n // 256 == r.part]


def brute_op2(rows):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    low: dict[tuple, float] = {}
    key = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - 49):
            g = tuple(w[a : a + 50])
            low[g] = min(low.get(g, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for a in range(len(w) - 49) if low[tuple(w[a : a + 50])] < key(i) for p in range(a, a + 50)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone).encode())))
    return out


def test_substring_edges(spark, edge):
    q = substrings.query(spark, edge)
    assert table(q.columns, [tuple(r) for r in q.collect()]) == table(["doc_id", "n_words", "n_removed", "kept_sha256"], brute_op2(edge_rows()))


def test_substrings_of_texts_that_repeat_themselves(spark, tmp_path):
    rng = random.Random(9)
    beat = lambda n, k, at=0: " ".join(f"b{k}_{(at + i) % k}" for i in range(n))
    rows = [(i, " ".join(rng.choice([beat(rng.randrange(40, 200), rng.choice([1, 2, 7]), rng.randrange(7)), PASSAGE, f"u{i}"]) for _ in range(4))) for i in range(60)]
    rows += [(rows[3][0], beat(90, 2)), rows[5]]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    q = substrings.query(spark, str(tmp_path))
    assert table(q.columns, [tuple(r) for r in q.collect()]) == table(["doc_id", "n_words", "n_removed", "kept_sha256"], brute_op2(rows))


def test_automaton_meets_brute_force():
    rng = random.Random(3)
    for turn in range(300):
        n, k = rng.choice([2, 3, 30]), rng.choice([1, 2, 3, 5])
        text = lambda m: [b"%d" % rng.randrange(n) for _ in range(m)]
        known = [(rng.randrange(5), text(rng.randrange(20))) for _ in range(rng.randrange(6))]
        a = substrings.Automaton(known)
        words, number = text(rng.randrange(30)), rng.randrange(6)
        earlier = {tuple(w[i : i + k]) for j, w in known if j < number for i in range(len(w) - k + 1)}
        want = {p for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in earlier for p in range(i, i + k)}
        spans = a.matches(words, k, number)
        assert {p for x, y in spans for p in range(x, y)} == want and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)), turn


def test_decontamination_edges(spark, edge):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    items = {(b["item_id"], tuple(word.findall(lower(b["text"])))) for b in pq.read_table(f"{edge}/benchmark.parquet").to_pylist()}
    want = []
    for i, t in edge_rows():
        w = word.findall(lower(t))
        hit, ids = set(), set()
        for item, x in items:
            k = min(len(x), 10)
            for g in {x[a : a + k] for a in range(len(x) - k + 1)} if k else ():
                for a in range(len(w) - k + 1):
                    if tuple(w[a : a + k]) == g:
                        hit.update(range(a, a + k))
                        ids.add(item)
        want.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    assert sorted(map(repr, (tuple(r) for r in QUERIES["op3_decontamination"](spark, edge).collect()))) == sorted(map(repr, want))


def test_decontamination_by_items_without_id(spark, tmp_path):
    lost = " ".join(f"n{i}" for i in range(25))
    docs = [(1, "a b " + lost + " c"), (2, "x short lost item y"), (3, lost + " " + PASSAGE), (4, PASSAGE), (5, "clean"), (6, None)]
    bench = [(None, lost), (None, "short lost item"), ("i1", " ".join(PASSAGE.split()[20:45])), ("i2", lost[:80])]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [b[0] for b in bench], "text": [b[1] for b in bench]}), tmp_path / "benchmark.parquet")
    same(QUERIES["op3_decontamination"](spark, str(tmp_path)), SQL["op3_decontamination"], str(tmp_path))
    kept = corpus_pipeline.benchmark_decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {5, 6}


def brute_components(rows) -> list[tuple]:
    """(id, shingles, component) of each row."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set())
    label = {i: i for i, _ in rows if i is not None}
    linked = [(a, b) for (a, _), s in zip(rows, sets, strict=True) for (b, _), t in zip(rows, sets, strict=True) if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    for _ in rows:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return [(i, len(s), None if i is None else label[i]) for (i, _), s in zip(rows, sets, strict=True)]


def test_jaccard_edges(spark, edge):
    want = sorted(map(repr, brute_components(edge_rows())))
    assert sorted(repr(tuple(r)) for r in QUERIES["op6_jaccard_join"](spark, edge).collect()) == want


def test_jaccard_lists_that_stay_open(spark, tmp_path):
    """Many documents that share half of their shingles, in groups of near copies: lists of many components."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for g in range(30):
        own = [f"g{g}_{i}" for i in range(30)]
        for c in range(rng.randrange(1, 5)):
            w = shared + own
            if c:
                w = [*w[: 69 - rng.randrange(6)], f"c{c}"]
            rows.append((len(rows), " ".join(w)))
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    got = sorted(repr(tuple(r)) for r in QUERIES["op6_jaccard_join"](spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, brute_components(rows)))


def test_search_meets_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n, extra = int(rng.integers(1, 60)), int(rng.integers(0, 8))
        query = np.sort(rng.choice(200, n, replace=False).astype(np.uint64))
        block = []
        for _ in range(int(rng.integers(1, 20))):
            own = np.concatenate([query[rng.random(n) > rng.random() * 0.5], rng.choice(np.arange(200, 400), int(rng.integers(1, 12)), replace=False).astype(np.uint64)])
            rng.shuffle(own)
            block.append(own)
        sizes = np.array([len(x) + int(rng.integers(0, 3)) for x in block])
        both = np.array([len(set(query.tolist()) & set(x.tolist())) for x in block])
        assert jaccard.search(query, n + extra, block, sizes).tolist() == (100 * both >= 75 * (n + extra + sizes - both)).tolist()


def morse(n: int, swap: bool = False) -> str:
    """A Thue-Morse text: it and its swap have equal polynomials modulo 2**64, whatever the base."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_hashes_of_texts_made_to_agree(spark, tmp_path):
    a, b = morse(2048), morse(2048, True)
    one, two = " ".join(a[:60]), " ".join(f"{w}{i}" for i, w in enumerate((a, b)))
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, one), (6, two), (7, a + " " + b)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": ["i"], "text": [b]}), tmp_path / "benchmark.parquet")
    for name in ("op3_decontamination", "op6_jaccard_join"):
        same(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))
    got = {r.doc_id: r.ids_sha256 for r in pieces.query(spark, str(tmp_path)).collect()}
    assert got == {i: sha(struct.pack(f"<{len(ids)}I", *ids)) for i, t in rows for ids in [library().encode(t, add_bos=True, add_eos=True)]}


def test_words_solved_for_the_fixed_keys(spark, tmp_path):
    """Pairs of words with one hash under fixed keys: hashes that are compared have keys of their own in each run, and tokens are compared letter by letter."""
    from proofgrid.llm import words as W

    pair, chars = ("hhnyn7loabcdefgh", "dc9jv843nvb5m67n"), ("xef", "\U000221c7\U0005fc10\U0002eba2")
    flat = "".join(pair).encode()
    h = lambda secret: W.span_hashes(np.frombuffer(flat, "u1"), np.array([0, 16]), np.array([16, 32]), secret)
    assert len(set(h(0).tolist())) == 1 and len(set(h(W.draw()).tolist())) == 2
    tail = " ".join(f"t{i}" for i in range(60))
    rows = [(1, f"{pair[0]} {tail}"), (2, f"{pair[1]} {tail}"), (3, pair[0]), (4, pair[1]), (5, " ".join(chars)), (6, f"{chars[1]} {chars[0]} {chars[1]}"), (7, chars[1])]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": ["a", "b"], "text": [pair[1], pair[1] + " " + " ".join(f"t{i}" for i in range(9))]}), tmp_path / "benchmark.parquet")
    for name in ("op2_substring_dedup", "op3_decontamination", "op6_jaccard_join"):
        same(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))
    got = {r.doc_id: r.ids_sha256 for r in pieces.query(spark, str(tmp_path)).collect()}
    assert got == {i: sha(struct.pack(f"<{len(ids)}I", *ids)) for i, t in rows for ids in [library().encode(t, add_bos=True, add_eos=True)]}


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL_NAME))


def test_sentencepiece_of_long_words():
    import public_tokenizers

    rng, sp, m = random.Random(11), library(), pieces.load(public_tokenizers.path(pieces.MODEL_NAME))
    letters = "etaoinshrdlu"
    texts = ["ab" * 4000, "the" * 3000, "".join(rng.choice(letters) for _ in range(60_000)), "".join(rng.choice("etaoin0123456789") for _ in range(160_000)), "\u4e2d\u6587" * 500 + "\U00100041\U0010ffff a\U00100041", "x" * 5000, "".join(rng.choice("abc") for _ in range(700))]
    texts += ["".join(rng.choice(letters + " ") for _ in range(rng.randrange(2000))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    ids, counts = pieces.encode(m, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == sp.encode(t, add_bos=True, add_eos=True), t[:40]
        at += n


def test_transport_streams(spark, sf_dir, edge):
    for d in (sf_dir, edge):
        texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in pq.read_table(f"{d}/documents.parquet").to_pylist()))
        got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.query(spark, d).collect()))
        want = []
        for i, t in texts:
            b = t.encode()
            p = b + b" " * (-len(b) % 192 or (0 if b else 192))
            want.append((i, len(b), len(p), sha(p), zlib.crc32(p[-16:])))
        assert got == sorted(want)


def read_stream(ts: bytes) -> tuple[bytes, int, list[int], int]:
    """(payload, packets, timestamps, access points) of the one elementary stream, read by the standard and nothing of ours."""
    units, times, access, last = [], [], 0, None
    assert len(ts) % 188 == 0
    for at in range(0, len(ts), 188):
        p = ts[at : at + 188]
        assert p[0] == 0x47
        pid, body = (p[1] & 0x1F) << 8 | p[2], 4
        if p[3] & 0x20:
            access += pid == 0x100 and p[4] > 0 and p[5] >> 6 & 1
            body = 5 + p[4]
        if pid == 0x100:
            assert last is None or p[3] & 15 == (last + 1) % 16
            last = p[3] & 15
            if p[1] & 0x40:
                units.append(b"")
            units[-1] += p[body:]
    for u in units:
        assert u[:4] == b"\x00\x00\x01\xbd" and int.from_bytes(u[4:6], "big") == len(u) - 6
        t = u[9:14]
        times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
    return b"".join(u[9 + u[8] :] for u in units), len(ts) // 188, times, access


def test_transport_streams_read_by_the_standard(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    streams = {hashlib.sha256(r.media).hexdigest(): r.media for r in media.stored(docs).collect()}
    for r in media.query(spark, edge).collect():
        payload, packets, times, access = read_stream(streams[r.media_sha256])
        assert (sha(payload), len(payload), len(streams[r.media_sha256])) == (r.payload_sha256, r.payload_bytes, r.media_bytes)
        assert r.feature == f"pid=256;type=6;packets={packets};units={len(times)};random={access};gaps=0;repeats=0;bad_tables=0;last_time={times[-1]}"
        assert times == [3600 * i for i in range(len(times))]


def test_transport_streams_lost_and_repeated_packets():
    payload = bytes(range(256)) * 192
    ts = media.mux(payload)
    assert len(ts) % 188 == 0 and set(ts[::188]) == {0x47}
    whole = media.demux(ts)
    assert whole.payload == payload and not whole.gaps and not whole.bad_tables and any(r for *_, r in whole.times)
    assert media.demux(ts[: 188 * 5] + ts[188 * 4 :]).repeats == 1
    assert media.demux(ts[: 188 * 5] + ts[188 * 6 :]).gaps == 1
    broken = bytearray(ts)
    broken[20] ^= 1
    assert media.demux(bytes(broken)).bad_tables == 1


def test_transport_streams_without_payload_bytes_or_with_any_bytes():
    """Adaptation fields of any length in any packet, tables and heads cut short, bytes changed at random: nothing raises, and what follows is still read."""
    ts, rng = media.mux(bytes(range(256)) * 12), random.Random(6)
    for pid in (0, 1, 2, 5):
        for length in range(184):
            p = bytearray(ts[188 * pid : 188 * pid + 188])
            p[3], p[4:] = p[3] & 0x0F | 0x30, bytes([length]) + p[5:]
            media.demux(ts[: 188 * pid] + bytes(p) + ts[188 * pid + 188 :])
    only = bytes([0x47, 0x40, 0, 0x30, 183]) + bytes(183)
    s = media.demux(only + ts)
    assert s.gaps == 1 and s.payload == bytes(range(256)) * 12
    for _ in range(2000):
        b = bytearray(ts)
        for _ in range(rng.randrange(1, 40)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        media.demux(bytes(b[: rng.randrange(len(b))]))


def brute_op7(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(a, label) for phrase, label in licenses.BASE.items() for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split()]
    base, spans_of, weak = {x for _, x in at}, [], 0.0
    for label, text in licenses.TEMPLATES:
        t = text.split()
        k = min(licenses.GRAM, len(t))
        votes: dict[int, list[int]] = {}
        for i in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    votes.setdefault(i - j, []).append(i)
        spans: list[list[int]] = []
        last = None
        for d in sorted(votes):
            if last is None or d - last > licenses.NEAR:
                spans.append([])
            spans[-1] += votes[d]
            last = d
        for s in spans:
            share = min(1.0, len(s) / (len(t) - k + 1))
            weak = max(weak, share / 2)
            if share >= licenses.VOTES:
                lo, hi = max(0, min(s) - len(t)), min(len(w), max(s) + k + len(t))
                found, x, y = licenses.aligned([q.encode() for q in w[lo:hi]], [q.encode() for q in t])
                if found >= licenses.SHARE and y - x <= 2 * len(t):
                    spans_of.append((-found, x - y, lo + x, label, set(range(lo + x, lo + y))))
    kept: list[tuple] = []
    for s in sorted(spans_of, key=lambda s: s[:4]):
        if all(2 * len(s[4] & o[4]) <= len(s[4]) for o in kept):
            kept.append(s)
    labels, best = {s[3] for s in kept}, max((-s[0] for s in kept), default=0.0)
    score = 1.0 if at else best or weak
    return len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9)


def test_licenses(spark, sf_dir, edge, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        t = rng.choice(licenses.TEMPLATES)[1].split()
        a, b = sorted(rng.sample(range(len(t) + 1), 2))
        words = [x for x in t[a:b] if rng.random() > 0.08]
        rows.append((i % 50, " ".join([*(f"w{rng.randrange(99)}" for _ in range(rng.randrange(30))), *words, *rng.choice([[], ["cc", "by"], t[:9]]), "end"])))
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    for d in (sf_dir, edge, str(tmp_path)):
        q = licenses.query(spark, d)
        got = [tuple(r[:-1]) + (round(r.score, 9),) for r in q.collect()]
        assert sorted(map(repr, got)) == sorted(repr((r["doc_id"], *brute_op7(r["text"]))) for r in pq.read_table(f"{d}/documents.parquet").to_pylist())
    labels = {r.doc_id: (r.labels, r.score) for r in licenses.query(spark, edge).collect()}
    assert labels[20] == ("cc-by", 1.0) and labels[15] == ("cc-by,reserved", 1.0) and labels[4] == ("", 0.0)


class Article(HTMLParser):
    """Text blocks of <article>, for pages whose noise is outside of it."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.on = True
        if tag not in ("b", "a", "i", "em", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.on = False
        if tag not in ("b", "a", "i", "em", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_html(spark, sf_dir, edge):
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.query(spark, sf_dir).collect()}
    for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        a = Article()
        a.feed(r["html"] or "")
        want = " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in a.blocks) if x)
        assert got[r["page_id"]] == (want, len(want)), r["url"]
    rows = [(r.page_id, r.text if len(r.text) < 99 else len(r.text)) for r in extraction.query(spark, edge).collect()]
    assert sorted(rows, key=str) == sorted([(1, "A & B x yz last"), (2, "A & B x yz last"), (2, "A & B x yz last"), (3, ""), (4, ""), (None, "A & B x yz last"), (5, "plain"), (6, 199_999)], key=str)


def test_html_noise_in_any_element():
    inside = [
        ('<p class="advert">AD</p><p>a</p>', "a"), ('<p class="advert">AD<p>a', "a"), ('<ul><li>a<li class="comment">NO<li>b</ul>c', "a b c"), ('<ul><li class="ad">NO<ul><li>NO</ul>NO</ul>a', "a"), ('<h2 class="share">NO</h2>a', "a"),
        ('<dl><dt>a<dd class="notice">NO<dt>b</dl>', "a b"), ('x <span class="sponsored">NO <span>NO</span> NO</span>y', "x y"), ('<p>x <a class="share" href="#">NO</a>y <label id="subscribe">NO</label></p>z', "x y z"), ('<x-box class="promo"><div>NO</div></x-box>a', "a"),
        ('<p>a</p><article class="comment"><p>NO</article>b', "a b"), ('<p>a <a href="/x?id=ad&class=share" data-id="ad">b</a> <i data-class="ad">c</i>', "a b c"), ('<a class="share"><div>NO</a>a</div>', "a"), ('<table><tr><td class="ad">NO<td>a<tr class="promo"><td>NO<tr><td>b</table>', "a b"), ('<p id="comments">NO<br>NO<div>a</div>', "a"),
    ]
    for part, want in inside:
        for page in (f"<html><body><nav>Menu</nav><article>{part}</article><footer>f", f"<head><title>t</title><body><div>{part}</div>"):
            if "<article" in part and "<article>" not in page:
                continue
            assert extraction.main_text(page, "article") == want, page
    assert extraction.main_text("<article class='comments-open'>a</article><article class='comment'>NO</article>", "article") == "a"
    assert extraction.main_text("<div>a<section class='comments'><article>NO</article></section></div>", "article") == "a"


def test_html_shared_paragraphs_hidden_elements_and_titles(spark, tmp_path):
    """Six pages of one host whose articles share a heading and a paragraph keep them; hidden elements go; a heading in an article's header stays; names of noise before what
    a text is about are no noise."""
    page = lambda i: f"<body><nav>Menu</nav><article><h1>Report</h1><h2>Summary</h2><p>The same paragraph for all of them.</p><p>Number {i}.</p></article><footer>F</footer>"
    pq.write_table(pa.table({"page_id": list(range(6)), "url": ["http://one.example/"] * 6, "html": [page(i) for i in range(6)]}), tmp_path / "pages.parquet")
    got = {r.page_id: r.text for r in extraction.query(spark, str(tmp_path)).collect()}
    assert got == {i: f"Report Summary The same paragraph for all of them. Number {i}." for i in range(6)}
    cases = [("<header><h1>Title</h1><p>by line</p></header>a", "Title a"), ("<header class='ad'><h1>T</h1></header>a", "T a"), ("<nav><h2>N</h2></nav>a", "a"), ("<p hidden>x</p>a", "a"), ("<p style='color:red; display: none'>x</p>a", "a"), ("<p style='display:block'>x</p>a", "x a"), ("<div hidden><header><h1>x</h1></header></div>a", "a")]
    cases += [(f"<div class='{c}'>x</div>a", "x a") for c in ("comment-free-zone", "menu-of-the-day", "banner-photo", "content-ad-free")] + [(f"<div class='{c}'>x</div>a", "a") for c in ("cookie-law-info", "ad-slot-1", "comment-list", "nav-primary")]
    for part, want in cases:
        assert extraction.main_text(f"<body><header><h1>Site</h1></header><article>{part}</article>", "article") == want, part


def test_html_tags_as_browsers_read_them():
    cases = [("<p title=\"5\" tall\">Hello</p>", "Hello"), ("<p title='a>b'>x</p>", "x"), ("a<p x=1 y>b</p", "a b"), ("a <b", "a"), ("1 < 2 <3", "1 < 2 <3"), ("<p =>x", "x"), ("<div class=\"alert-fatigue\">kept</div>", "kept"), ("<div class='alert alert-info'>NO</div>a", "a"), ("<p id=cookie-notice>NO<p>a", "a"), ("<p class='comment-list'>NO<p>a", "a"), ("<p class='shared-memory ad-hoc'>kept", "kept"), ("<p><!-- x > --> y</p></ >z", "y z"), ("<script>if (a</b) {}</script >x", "x"), ("<!doctype html><p>é &lt;b&gt;", "é <b>")]
    for page, want in cases:
        assert extraction.main_text(f"<article>{page}", "article") == want, page


def test_html_long_pages_and_many_streams_take_linear_time():
    import time

    start = time.process_time()
    for page in ("<a href=\"" * 100_000, "<p " * 300_000, "<div>" * 50_000, "<p>x" * 100_000, "<a b='" + "<p>" * 200_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 300_000):
        extraction.walk(page)
    assert time.process_time() - start < 40
    rng = random.Random(1)
    streams = [[f"t{rng.randrange(300)}" for _ in range(120)] for _ in range(400)]
    start = time.process_time()
    import json

    import pandas as pd

    wrapper = json.loads(extraction.merged(pd.Series([json.dumps(s) for s in streams])))
    assert time.process_time() - start < 30 and len(wrapper) < 5000


def test_html_slots_of_hosts_without_article(spark, tmp_path):
    links = lambda i: "".join(f"<div class='link'><h3>L{i}{k}</h3><div class='by'>B{i}{k}</div></div>" for k in range(4))
    body = lambda i: [f"title {i}"] + [f"paragraph {k} of page {i} " + "word " * 40 for k in range(1 + i % 3)]
    rows, want = [], {}
    for i in range(8):
        inner = "<p>Welcome to our site</p>" + "".join(f"<p>{x}</p>" for x in body(i)) + "<p>Written for our site</p>"
        rows.append((i, f"http://one.example/{i}", f"<body><div class='wrap'><div class='links'>{links(i)}</div><div class='bod'>{inner}</div></div></body>"))
        want[i] = " ".join(" ".join(x.split()) for x in body(i))
        rows.append((100 + i, f"http://two.example/{i}", f"<body><article><p>Share this<p>text {i}</article>"))
        want[100 + i] = f"Share this text {i}"  # the article's own text, whatever all pages share
    for i in range(3):
        rows.append((200 + i, "http://few.example/", f"<body><main><p>Same<p>text {i}</main>"))
        want[200 + i] = f"Same text {i}"
        rows.append((300 + i, "http://copies.example/", f"<body><div class='ad'>{i}</div><div class='x'>all one text</div>"))
        want[300 + i] = "all one text"
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}), tmp_path / "pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.text for r in extraction.extracted(pages).collect()} == want
    assert {r.host: (r.root, len(r.constant)) for r in extraction.wrappers(pages).collect()} == {"one.example": ("div.bod", 2), "two.example": ("article", 1), "few.example": ("main", 0), "copies.example": ("div.x", 0)}


def test_wrapper_groups():
    one, two = extraction.fold("article p # /x p # /x".split()), extraction.fold("article p # /x p # /x p # /x h1 #".split())
    assert extraction.align(one, two) == extraction.align(one, two) and any(t.endswith("+") for t in one)
    assert any(t.endswith("?") for t in extraction.align(one, two))


@pytest.mark.parametrize("length", [3, 3000])
def test_wrapper_keeps_what_pages_share_whatever_their_length(length):
    """A text, and an element, that both have between middles of their own stay; the middles become optional, each token once."""
    shared = f"#{'ab' * 8}"
    page = lambda tag: ["article", *[x for i in range(length) for x in (tag, f"#{len(tag):04x}{i:012x}", f"/{tag}")], "aside", shared, "/aside", *[f"{tag}{i}" for i in range(length)], "/article"]
    start = time.monotonic()
    wrapper = extraction.align(page("p"), page("li"))
    assert extraction.constants(wrapper) == [int("ab" * 8, 16) - 2**64] and [t for t in wrapper if not t.endswith("?")] == ["article", "aside", shared, "/aside", "/article"]
    rng = random.Random(3)
    one, two = ([rng.choice(["p", "/p", "b", "#"]) for _ in range(8 * length)] for _ in "ab")
    assert len(extraction.align(one, two)) >= length and time.monotonic() - start < 20


def test_warc_edges(spark, edge):
    pages = pq.read_table(f"{edge}/pages.parquet").to_pylist()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first: dict[str, float] = {}
    for p in pages:
        k = digest(p["html"])
        first[k] = min(first.get(k, float("inf")), float("inf") if p["page_id"] is None else p["page_id"])
    want = []
    for p in pages:
        k = digest(p["html"])
        again = p["page_id"] != first[k]
        want.append((p["page_id"], len((p["html"] or "").encode()), k, "revisit" if again else "response", int(first[k]) if again else None))
    q = archive.query(spark, edge)
    assert table(q.columns, [tuple(r) for r in q.collect()]) == table(q.columns, want)


def test_quality(spark, edge):
    sf = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.85
    rows = quality.query(spark, edge).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)


def test_quality_scores_meet_brute_force(spark, edge):
    import math

    rng = np.random.default_rng(4)
    weights, bias = rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3
    buckets: dict[str, list[int]] = {}

    def of(word: str) -> list[int]:
        if word not in buckets:
            raw = word.encode()
            buckets[word] = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
            assert len(buckets[word]) == 1 + sum(max(0, len(word) + 2 - n + 1) for n in quality.NGRAMS)
        return buckets[word]

    want = []
    for i, t in edge_rows():
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        all_ = [b for w in words for b in of(w)] + [0 for a, b in zip(words, words[1:], strict=False) if a == b]
        want.append((i, 1 / (1 + math.exp(-(sum(float(weights[b]) for b in all_) / max(len(all_), 1) + bias)))))
    docs = spark.read.parquet(f"{edge}/documents.parquet").select("doc_id", "text")
    got = [(r.doc_id, r.score) for r in quality.score(docs, (weights, bias)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (i, a), (j, b) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert i == j and abs(a - b) < 1e-4


def test_pipeline_stages_on_difficult_rows(spark, edge):
    docs, rows = spark.read.parquet(f"{edge}/documents.parquet"), edge_rows()
    kept = lambda df: sorted(repr((r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())
    clash = lambda df: {(r.k1, r.score, r.label, r.anchor, r.n_words) for r in df.collect()} == {("z", 1.0, "q", None, 3)}
    label = brute_components(rows)
    once: dict[int, tuple] = {}
    for (i, t), (_, _, c) in zip(rows, label, strict=True):
        if i is not None and c == i:
            once.setdefault(i, (i, t))
    out = corpus_pipeline.near_duplicates(spark, docs, edge)
    assert out.columns == docs.columns and clash(out) and kept(out) == sorted(map(repr, [*once.values(), *[r for r in rows if r[0] is None]]))
    out = corpus_pipeline.substring_dedup(spark, docs, edge)
    want = {(i, n, gone, digest) for i, n, gone, digest in brute_op2(rows)}
    assert out.columns == docs.columns and clash(out) and out.count() == len(rows)
    plain = {(i, t) for i, t in rows}
    assert all((r.doc_id, r.text) in plain and r.n_chars == (None if r.text is None else len(r.text)) or any(i == r.doc_id and gone and sha(r.text.encode()) == digest and r.n_chars == len(r.text) for i, _, gone, digest in want) for r in out.collect())
    assert sum((r.doc_id, r.text) not in plain for r in out.collect()) == sum(bool(gone) for _, _, gone, _ in brute_op2(rows))
    out = corpus_pipeline.benchmark_decontamination(spark, docs, edge)
    hit = {(r.doc_id, r.n_words) for r in QUERIES["op3_decontamination"](spark, edge).collect() if r.contaminated}
    words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert out.columns == docs.columns and clash(out) and kept(out) == sorted(repr(r) for r in rows if (r[0], words(r[1])) not in hit)
    scored = QUERIES["op10_quality"](spark, edge).collect()
    out = corpus_pipeline.quality_classifier(spark, docs, edge)
    assert out.columns == docs.columns and out.count() == sum(r.predicted for r in scored) and (not out.count() or clash(out))
    out = corpus_pipeline.sentencepiece_encoding(spark, docs, edge)
    assert out.count() == len(rows)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        folder = tmp_path / name
        folder.mkdir()
        for t in ("labels", "benchmark"):
            (folder / f"{t}.parquet").symlink_to(Path(sf_dir, f"{t}.parquet"))
        docs.write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, sf_dir)
        assert out.columns == names or name == "sentencepiece"
        kept[name] = (str(folder), {r.doc_id for r in out.select("doc_id").collect()})
        before, docs = docs, out
        if name == "ngram_jaccard_join":
            cols, rows = duck(SQL["op6_jaccard_join"], str(folder))
            assert kept[name][1] == {r[cols.index("doc_id")] for r in rows if r[cols.index("doc_id")] == r[cols.index("component_id")]}
        if name == "substring_dedup":
            cols, rows = duck(SQL["op2_substring_dedup"], str(folder))
            want = {r[0]: (r[2], r[3]) for r in rows}
            for r in out.select("doc_id", "text", "n_chars").collect():
                assert not want[r.doc_id][0] or sha(r.text.encode()) == want[r.doc_id][1] and r.n_chars == len(r.text)
        if name == "benchmark_decontamination":
            cols, rows = duck(SQL["op3_decontamination"], str(folder))
            assert kept[name][1] == {r[0] for r in rows if not r[5]}
    assert before.count() == docs.count() > 0


def test_filter_of_ids_loses_nothing(spark):
    from pyspark.sql import functions as F

    from proofgrid.llm import shared

    rows = spark.range(20_000).select(F.when(F.col("id") % 100 != 7, F.col("id") * 7919).alias("k1"), (F.col("id") % 3).alias("k2"), "id")
    keys = shared.materialize(rows.filter("id % 50 = 3").select("k1", "k2"), "keys")
    touched, rest = shared.may_be_in(rows, keys, "k1", "k2")
    a, b = {r.id for r in touched.collect()}, {r.id for r in rest.collect()}
    assert touched.columns == rows.columns and not a & b and len(a) + len(b) == 20_000
    assert {i for i in range(20_000) if i % 50 == 3} <= a and len(a) < 600
    none = shared.may_be_in(rows, shared.materialize(keys.limit(0), "keys"), "k1", "k2")
    assert none[0].count() == 0 and none[1].count() == 20_000
    big = spark.range(10).select(F.repeat(F.lit("x"), shared.BROADCAST_BYTES // 5).alias("t"))
    assert "broadcast" not in shared.broadcast_if_small(big)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in shared.broadcast_if_small(spark.range(10))._jdf.queryExecution().analyzed().toString().lower()


def test_pipeline_runs_on_edges(spark, edge, empty):
    assert corpus_pipeline.run(spark, edge).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
