"""The prefix trie, the token shards with their index, and hard negatives, each against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import hardnegatives, prefixtrie, queries, tokenindex
from tests.compare import database, differences


@pytest.mark.parametrize("name", ["op11_prefixtrie", "op13_anchortree"])
def test_query_equals_its_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert rows and differences(rows, df.columns, database(sf), queries.SQL[name]) == []


# ---- prefix trie -----------------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, parent long, block string"


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said = f"{len(role or '')}:{role or ''}{text or ''}"
            convs[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(said.encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in nodes:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in nodes[n] if len(built[c]) == len(n)).encode()).hexdigest()
    return sorted((nodes[n][0], len(n), nodes[n[:-1]][0] if n else None, len(nodes[n]), len(kids[n]), leaves[n], saved[n], ends(n)) for n in nodes)


def trie(spark, rows):
    df = prefixtrie.prefix_trie(prefixtrie.with_openings(prefixtrie.packed_turns(spark.createDataFrame(rows, CONV))))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("convs", "per_block", "seed"), [(400, 3, 1), (300, 1, 2), (150, 50, 3)])
def test_trie_over_many_blocks(spark, monkeypatch, convs, per_block, seed):
    """Blocks of a few conversations: nearly every node crosses boundaries, and equal conversations fill whole blocks."""
    monkeypatch.setattr(prefixtrie, "CONVS", per_block)
    monkeypatch.setattr(prefixtrie, "_pack", _with_convs(per_block))
    rng, rows = random.Random(seed), []
    for c in range(convs):
        same = rng.random() < 0.4
        for t in range(5 if same else rng.choice([0, 1, 2, 3, 9])):
            rows.append((c + 95, t, "user" if t % 2 else None, "hot" if same else rng.choice(["a", "bb", "ü", None]), 1, "x"))
    got = trie(spark, rows)
    assert got == brute_trie(rows)


def _with_convs(n):
    """Packs blocks of n conversations in the workers too, which read the constant from the module."""
    pack = prefixtrie._pack

    def run(batches):
        prefixtrie.CONVS = n
        return pack(batches)

    return run


def test_trie_of_odd_conversations(spark):
    rows = [(5, None, None, None, 0, ""), (5, None, "a", "x", 0, ""), (5, 1, "a", "x", 0, ""), (5, 1, "a", "x", 0, ""), (None, 1, "a", "lost", 0, ""), (-7, 0, "b", "y" * 50_000, 0, "")]
    rows += [(100, 0, "u", "open", 0, ""), (100, 1, "v", "", 0, ""), (101, 3, "u", "open", 0, ""), (102, 0, "u", None, 0, "")]
    rows += [(300, t, "u", f"t{t}", 0, "") for t in range(150)] + [(301, t, "u", f"t{t}", 0, "") for t in range(149)]
    # Spark's remainder keeps the sign, so the hundred of -7 is 0
    assert [r for r in trie(spark, rows)] == [r for r in brute_trie([(c if c != -7 else c, *x) for c, *x in rows])]
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b", 0, "")]) == []


# ---- token shards ----------------------------------------------------------------------------------------------------


def encoded(texts, end=2):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, end] for e in tok.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "  ", "a  b", "a   b \n c", "\n\n x", "tab\t y", "trail ", "don't  stop 12 3", "<|endoftext|> a<|endoftext|>", "　wide   nbsp", "é 日本語 text", "\x1c a\x1f b", "x" * 5000, "a\r\n b  c\u0085 d", " lead", "1 2  3   4    5"]


def test_pieces_have_the_ids_of_the_whole_text():
    import public_tokenizers

    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\tab1.'s é<|>") for _ in range(rng.randrange(60))) for _ in range(3000)]
    encode = tokenindex.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2, remember=1000)
    assert encode.pieces and encode.kind == "<u2"
    got = [np.frombuffer(x, "<u2").tolist() for i in range(0, len(texts), 100) for x in encode(texts[i : i + 100])]
    assert got == encoded(texts)


def test_lines_are_encoded_word_by_word():
    """The two words around a line's end are looked up alone; the ids are those of the whole text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = tokenindex.Encoder(path, 2)
    texts = ["some es.\nThon more", "a\nb\nc d", "x\n\ny z", "q \nr", "q\n r", "one's\n's it", "\nstart end\n", "caf\u00e9.\n\u00c9t\u00e9 9\n8", "u\u0085\nv w\n\x1cx", "<s>\n</s> <s>\nok", "\n".join(["line"] * 5000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == encoded(texts)
    assert "Thon" in encode.known[False]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = tokenindex.Encoder(path, 70_000)
    assert not encode.pieces and encode.kind == "<u4"
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(["Two words", ""])] == [[*tok.encode(t, add_special_tokens=False).ids, 70_000] for t in ("Two words", "")]


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(5)
    h1, h2 = rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 2**64, 5000, np.uint64)
    levels, slot = tokenindex.perfect_hash(h1, h2)
    assert sorted(slot.tolist()) == list(range(5000)) and sum(int(np.bitwise_count(x).sum()) for x in levels) == 5000
    places = [np.arange(5000) + k for k in range(4)]
    bucket = tokenindex.pack_bucket(h1, h2, places)
    held, found = tokenindex.find(bucket, h1[::-1], h2[::-1])
    assert held.all() and (found["first_no"] == places[0][::-1]).all() and (found["last_row"] == places[3][::-1]).all()
    held, _ = tokenindex.find(bucket, rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 2**64, 5000, np.uint64))
    assert not held.any()
    assert not tokenindex.find(tokenindex.pack_bucket(h1[:0], h2[:0], [p[:0] for p in places]), h1, h2)[0].any()


def stored(spark, rows, **more):
    import public_tokenizers

    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, start long")
    return tokenindex.write_tokens(spark, docs.repartition(3), public_tokenizers.path("byte_bpe_50k.json"), 2, **more)


def test_round_trip_over_many_shards(spark):
    """Repeated keys that fill shards, null keys and texts, and small buckets; every document comes back, in order."""
    rng = random.Random(6)
    rows = [(i, rng.choice(ODD), "k", 1) for i in range(300)] + [(7, t, "k", 1) for t in ODD * 20] + [(None, "null key", "k", 1), (None, None, "k", 1), (9, None, "k", 1)]
    store = stored(spark, rows, shard_ids=200, bucket_keys=16)
    assert store.shards.count() > 20 and store.index.count() > 10
    got = sorted(((r.start, r.key, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in store.fetch(spark.createDataFrame([(r[0],) for r in rows], "key long")).collect()), key=lambda r: r[0])
    at = 0
    for start, _, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    assert [k for _, k, _, _ in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    want = defaultdict(list)
    for (key, *_), ids in zip(rows, encoded([r[1] or "" for r in rows]), strict=True):
        want[key].append(ids)
    have = defaultdict(list)
    for _, key, _, ids in got:
        have[key].append(ids)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    few = store.fetch(spark.createDataFrame([(11,), (11,), (999,), (-1,)], "key long")).collect()
    assert [(r.key, np.frombuffer(r.ids, "<u4").tolist()) for r in few] == [(11, want[11][0])]


def test_empty_table_has_no_shards(spark):
    store = stored(spark, [])
    assert (store.shards.count(), store.index.count()) == (0, 0)
    assert store.fetch(spark.createDataFrame([(1,)], "key long")).collect() == []


def test_token_query_equals_whole_texts(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, at = [], 0
    for (doc, _), ids in zip(docs, encoded([t for _, t in docs]), strict=True):
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op12_tokenindex(spark, sf).collect()) == want


# ---- hard negatives --------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=10):
    ok = [(i, r[0], r[2], [int(np.floor(256 * np.float64(x))) for x in r[1]]) for i, r in enumerate(rows) if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for u, anchor, label, v in ok:
        if anchor is None or anchor % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), i, k) for t, i, k, w in ok if t != u]
        for s, i, _ in sorted((x for x in scores if x[2] == label), key=order)[:5]:
            hits = sorted((x for x in scores if x[2] != label and 80 * s <= 100 * x[0] <= 100 * s), key=order)[:5]
            out += [(anchor, i, n + 1, h[1], s, h[0]) for n, h in enumerate(hits)]
    return sorted(out, key=str)


def negatives(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, uid long, score string")
    out = hardnegatives.hard_negatives(df.repartition(5), lambda c: c % 10 == 0)
    return sorted((tuple(r)[:6] for r in out.collect()), key=str)


def vectors(n, rng, dims=8):
    centres = rng.normal(0, 0.3, (4, dims))
    return [(i, (centres[rng.integers(4)] + rng.normal(0, 0.1, dims)).astype(np.float32).tolist(), int(rng.integers(3)), 0, "") for i in range(n)]


def test_hard_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK", 7)
    rows = vectors(600, np.random.default_rng(7))
    assert negatives(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = vectors(60, rng)
    rows += [(100, None, 1, 0, ""), (110, [0.1, None], 1, 0, ""), (120, [float("nan")] * 8, 1, 0, ""), (130, [float("inf")] * 8, 2, 0, ""), (140, rows[0][1], None, 0, ""), (None, rows[3][1], 1, 0, ""), (150, [], 1, 0, ""), (160, [0.5], 2, 0, "")]
    rows += [rows[10]] * 9 + [(200 + i, rows[20][1], i % 3, 0, "") for i in range(30)]
    assert negatives(spark, rows) == brute_negatives(rows)
    assert negatives(spark, []) == [] and negatives(spark, rows[1:9]) == []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(np.float32(2.0**20 + 100 * i)), float(np.float32(2.0**19 + i))] * 3, i % 2, 0, "") for i in range(25)]
    assert negatives(spark, rows) == brute_negatives(rows)


def test_bounds_spare_scores_and_hold():
    """Along the tree of close anchors most rows are never scored, and nothing that counts is missed."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 300, (20, 32))
    own = np.floor(np.repeat(centres, 10, 0) + rng.normal(0, 3, (200, 32)))
    rows = np.floor(np.repeat(centres, 400, 0) + rng.normal(0, 3, (8000, 32)))
    score = rows @ own.T
    low = np.sort(score, 0)[-40][:, None].astype(np.int64)
    block = hardnegatives._Block(own, np.zeros(200, int), np.arange(200) + 10**6, low.copy(), np.full((200, 1), hardnegatives.MOST), True, 5)
    needed = block.meet(rows, np.zeros(8000, int), np.arange(8000), np.zeros(8000, bool), np.arange(8000))
    assert needed < 0.25 * score.size
    for a in range(200):
        assert block.best[a, 0][0].tolist() == sorted(score[:, a], reverse=True)[:5]


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(10).normal(0, 1, (40, 3))
    order, parent, length = hardnegatives.spanning_tree(x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    seen, total = {order[0]}, 0.0
    for a in order[1:]:
        assert parent[a] in seen and np.isclose(length[a], d[a, parent[a]])
        seen.add(a)
    inside, rest = {0}, set(range(1, 40))
    while rest:
        a, b = min(((i, j) for i in inside for j in rest), key=lambda e: d[e])
        total += d[a, b]
        inside.add(b)
        rest.remove(b)
    assert np.isclose(length.sum(), total)
