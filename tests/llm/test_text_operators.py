"""Near-duplicates, repeated strings, passages, fingerprints: against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bwtmerge, compactwindows, kernels, multisethash, superminhash
from tessera.llm.components import components

DOCS = "doc_id long, text string, k1 string, source string"
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def sentence(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, a shared passage, nulls, empty and long texts, repeated rows; a column named like an internal one."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.copy()
    near[60] = "changed"
    far = [w if i % 9 else "edit" + w for i, w in enumerate(base)]
    passage = sentence(rng, 70)
    texts = [" ".join(base), " ".join(base), " ".join(near).upper(), " ".join(far), None, "", " \n", "one", "one two", "ünï çödé " * 40]
    texts += [" ".join(sentence(rng, 40) + passage + sentence(rng, 30)) for _ in range(5)]
    texts += [" ".join(sentence(rng, 3000)), "é" * 300, "it " * 200]
    rows = [(i, t, "x", "s") for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, " ".join(base), None, None), (3, texts[3], "x", "s"), (3, texts[3], "x", "s")]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def shingle_set(text, q):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + q]) for i in range(len(w) - q + 1)} if len(w) >= q else ({tuple(w)} if w else set())


def test_near_duplicates_match_all_pairs(odd):
    docs, rows = odd
    got = superminhash.near_duplicates(docs, q=4).collect()
    assert len(got) == len(rows)
    sets = [shingle_set(t, 4) for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = Counter()
    for k, (i, _, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        least = min(ids) if ids else None
        want[i, len(sets[k]), least, i is not None and i == least] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 800).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        k = int(800 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 800 - k).astype(np.uint64)])
        sig = superminhash.superminhash(np.concatenate([a, b]), np.array([0, 800, 1600]), 1024)
        assert abs((sig[0] == sig[1]).mean() - share) < 0.06
    small = superminhash.superminhash(a[:3], np.array([0, 3, 3]), 64)
    assert np.isfinite(small[0]).all() and np.isinf(small[1]).all()


def repeats(rows, length):
    raw = [(t or "").encode() for _, t, _, _ in rows]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(x), sum(gone), bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("most_forms", [2000, 1])
def test_repeated_strings_match_brute_force(odd, most_forms):
    docs, rows = odd
    got = bwtmerge.remove_repeats(docs, 200, most_forms=most_forms).collect()
    have = Counter((r.doc_id, r.text, r.source, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got)
    want = Counter((i, t or "", s, n, g, k) for (i, t, _, s), (n, g, k) in zip(rows, repeats(rows, 200), strict=True))
    assert have == want


def test_merged_transforms_find_what_counting_finds():
    rng = random.Random(2)
    base = bytes(rng.choice(b"ab") for _ in range(700))
    strings = [base[:400], base[150:600], base[390:] + b"c" * 250, b"ab" * 150, b"c" * 210]
    want = Counter(x[i : i + 200] for x in strings for i in range(len(x) - 199))
    for shards in (1, 2, 5):
        for x, flag in zip(strings, bwtmerge.repeated_windows(strings, np.ones(5), 200, shards), strict=True):
            assert [want[x[i : i + 200]] > 1 for i in range(len(x) - 199)] == flag.tolist()


def test_passages_cover_every_exact_repeat(odd):
    docs, rows = odd
    found = compactwindows.passages(docs).collect()
    covered: dict = {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    words = {(i, t): (t or "").encode().translate(LOWER).split() for i, t, _, _ in rows}
    where: dict = {}
    for key, w in words.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add((key, k))
    for places in where.values():
        if len({p[0] for p in places}) > 1:
            for (ident, _), k in places:
                assert set(range(k, k + 50)) <= covered[ident]
    assert {10, 11, 12, 13, 14} <= set(covered) and not {5, 7, 8, 15} & set(covered)
    assert all(r.similarity >= 0.8 and len(r.passage.split()) == r.n_words for r in found)


def edited(rng, words, every):
    out = words.copy()
    for i in range(rng.randrange(every), len(out), every):
        out[i] = "".join(rng.choice("klmnop") for _ in range(9))
    return out


def test_passages_of_edited_copies_and_around_a_frequent_phrase(spark):
    """Copies that are like the original but not like each other, and pairs that meet only in groups of a frequent phrase."""
    rng = random.Random(8)
    base = sentence(rng, 240)
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 48))) for i in range(1, 41)]
    phrase = sentence(rng, 5)
    for k in range(60):
        passage = sentence(rng, 24) + phrase + sentence(rng, 21)
        rows += [(100 + 2 * k + j, " ".join(sentence(rng, 30) + passage + sentence(rng, 30))) for j in (0, 1)]
    rows += [(300 + k, " ".join(sentence(rng, 60) + phrase + sentence(rng, 60))) for k in range(60)]
    found = compactwindows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(41)) | set(range(100, 220))
    assert all(abs(r.doc_id - r.rep_doc_id) <= 1 for r in found if r.doc_id >= 100)


@pytest.mark.parametrize("quoted", [5, 14])
def test_passages_whose_pieces_are_quoted_elsewhere(spark, quoted):
    """Every piece of the passage's words is quoted alone by a dozen other documents."""
    rng = random.Random(12)
    passage = sentence(rng, 60)
    rows = [(i, " ".join(sentence(rng, 40) + passage + sentence(rng, 40))) for i in (0, 1)]
    for k in range(len(passage) - quoted + 1):
        rows += [(len(rows) + j, " ".join(sentence(rng, 35) + passage[k : k + quoted] + sentence(rng, 35))) for j in range(12)]
    found = compactwindows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {0, 1}
    assert all(r.start_word <= 40 and r.start_word + r.n_words >= 100 for r in found)


def test_recall_of_edited_passages_around_hot_phrases(spark):
    """Pairs of passages of 60 words with 1 to 2 changed words, all around one phrase that 300 documents have."""
    rng = random.Random(13)
    phrase = sentence(rng, 12)
    rows, wanted = [], set()
    for k in range(150):
        passage = sentence(rng, 25) + phrase + sentence(rng, 25)
        other = edited(rng, passage, 40)
        pair = [" ".join(sentence(rng, 30) + x + sentence(rng, 30)) for x in (passage, other)]
        rows += [(2 * k + j, x) for j, x in enumerate(pair)]
        a, b = (tokens_of(" ".join(x)) for x in (passage, other))
        if any(jaccard(a[i : i + 46], b[i : i + 46]) >= 0.8 for i in range(len(a) - 45)):
            wanted |= {2 * k, 2 * k + 1}
    found = compactwindows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = {r.doc_id for r in found}
    assert len(wanted) > 100 and len(have & wanted) >= 0.95 * len(wanted)
    assert all(r.doc_id // 2 == r.rep_doc_id // 2 for r in found)


def test_every_pair_at_the_threshold_is_found(spark, monkeypatch):
    """Passages of 50 words with one changed word (41 of 51 tokens in common), some with a phrase in them twice, or moved by
    an added word; tokens are counted by many tasks."""
    monkeypatch.setattr(compactwindows, "COUNTED", 1 << 12)
    rng = random.Random(17)
    rows, wanted = [], set()
    for k in range(160):
        passage = sentence(rng, 50)
        if k % 4 == 1:
            passage[30:38] = passage[2:10]
        other, at = passage.copy(), rng.randrange(4, 46)
        if k % 4 == 2:
            other.insert(at, "added")
        else:
            other[at] = "changed"
        a, b = tokens_of(" ".join(passage)), tokens_of(" ".join(other))
        if any(jaccard(a, b[j : j + 46]) >= 0.8 for j in range(len(b) - 45)):
            wanted |= {2 * k, 2 * k + 1}
        rows += [(2 * k + j, " ".join(sentence(rng, 30) + x + sentence(rng, 30))) for j, x in enumerate((passage, other))]
    found = compactwindows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(wanted) > 200 and wanted <= {r.doc_id for r in found}
    assert all(r.doc_id // 2 == r.rep_doc_id // 2 for r in found)


def test_chains_of_alike_passages_are_one_class(spark):
    """Passages of which each has one more word changed than the one before: only near ones are alike, links lead along the chain."""
    rng = random.Random(23)
    rows, wanted = [], []
    for k in range(24):
        passage, chain = sentence(rng, 52), []
        for i, at in enumerate(rng.sample(range(5, 47), 10)):
            chain.append(passage.copy())
            rows.append((10 * k + i, " ".join(sentence(rng, 20) + passage + sentence(rng, 20))))
            passage[at] = "changed" + passage[at]
        runs = [[set(t[s : s + 46]) for s in range(len(t) - 45)] for t in (tokens_of(" ".join(x)) for x in chain)]
        wanted += [(10 * k + i, 10 * k + j) for i in range(10) for j in range(i) if any(10 * len(a & b) >= 8 * len(a | b) for a in runs[i] for b in runs[j])]
    found = compactwindows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {}
    for r in found:
        of.setdefault(r.doc_id, set()).add(r.rep_doc_id)
        of.setdefault(r.rep_doc_id, set()).add(r.doc_id)
    reached = {}
    for i in of:
        todo, seen = [i], {i}
        while todo:
            todo += (new := of[todo.pop()] - seen)
            seen |= new
        reached[i] = seen
    assert len(wanted) > 100 and not [p for p in wanted if p[0] not in reached or p[1] not in reached[p[0]]]
    classes = {r.doc_id: r.class_id for r in found}
    assert all(classes[a] == classes[b] for a, b in wanted)
    assert all(len({x // 10 for x in s}) == 1 for s in reached.values())


def test_verification_takes_turns(spark, monkeypatch):
    """What a verification moves at once is bounded by the texts, not by the pairs; the rows are the same."""
    rng = random.Random(29)
    base = sentence(rng, 200)
    rows = [(i, " ".join(edited(rng, base, 44) + sentence(rng, 10))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, stash = [], compactwindows.stash
    monkeypatch.setattr(compactwindows, "stash", lambda df, name: written.append(name) or stash(df, name))
    spans = lambda: sorted((r.doc_id, r.start_word, r.n_words, r.rep_doc_id, r.rep_start_word, r.similarity, r.class_id) for r in compactwindows.passages(docs).collect())
    at_once = spans()
    before = written.count("passages")
    written.clear()
    monkeypatch.setattr(compactwindows, "MOVED", 1 << 10)
    assert at_once == spans() and written.count("passages") > before == 3 and len({r[0] for r in at_once}) > 5


def test_runs_with_repeated_tokens_are_compared_all_at_once(monkeypatch):
    """Rows that hold tokens twice: all pairs of runs are compared as sets, without one call for each pair."""
    calls = []
    one_by_one = compactwindows.similarity
    monkeypatch.setattr(compactwindows, "similarity", lambda *x: calls.append(1) or one_by_one(*x))
    rng, least, alike = random.Random(19), 46, 0
    for k in range(40):
        a = [rng.randrange(1 << 30) for _ in range(91)]
        for i in rng.sample(range(91), 12):
            a[i] = a[rng.randrange(91)]
        b = a.copy()
        for i in rng.sample(range(22), 6) + rng.sample(range(22, 68), 1 + k % 7) + rng.sample(range(68, 91), 6):
            b[i] = rng.randrange(1 << 30)
        want = [(i, j, jaccard(a[i : i + least], b[j : j + least])) for i in range(46) for j in range(46)]
        want = [w for w in want if w[2] >= 0.8]
        calls.clear()
        one, two = (compactwindows.Side(np.array(x, np.uint64)) for x in (a, b))
        found = compactwindows.verified(one, two, [(0, 46, 0, 46)], least, 80, 100, False)
        assert bool(found) == bool(want or jaccard(a, b) >= 0.8) and len(calls) <= 1
        if want and len(found) == 1 and found[0][4] == max(w[2] for w in want):
            best = next(w for w in want if w[2] == found[0][4])
            assert found[0][0] <= best[0] and best[0] + least <= found[0][1] and found[0][2] <= best[1] and best[1] + least <= found[0][3]
            alike += 1
    assert alike > 5


def tokens_of(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_are_homomorphic():
    m = multisethash
    a, b, c = b"first paragraph here", b"second one", b"third \xc3\xa9"
    whole = m.paragraphs(b"\n".join([a, b, c]))
    assert m.pack(whole) == m.pack(m.paragraphs(b"\n".join([c, a, b])))
    assert m.pack(m.combine(m.paragraphs(b"\n".join([a, c])), m.paragraphs(b))) == m.pack(whole)
    assert m.pack(m.combine(whole, m.paragraphs(b), -1)) == m.pack(m.paragraphs(b"\n".join([a, c])))
    assert m.pack(whole) != m.pack(m.paragraphs(b"\n".join([a, a, c])))


def test_words_and_paragraphs_that_collide_under_polynomials():
    """Thue-Morse words have equal polynomial hashes modulo 2^64 under every base."""
    for size in (64, 1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        b = a.translate(str.maketrans("ab", "ba"))
        assert multisethash.pack(multisethash.paragraphs(a.encode())) != multisethash.pack(multisethash.paragraphs(b.encode()))
        data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        h = kernels.words(data, np.array([0, len(data)]))[0]
        assert len(h) == 2 and h[0] != h[1]
    texts = [f"w{i}" + "x" * (i % 90) for i in range(3000)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    assert len(np.unique(kernels.words(data, np.array([0, len(data)]))[0])) == 3000


def test_likeness_estimates_shared_runs_of_words():
    rng = random.Random(4)
    base = sentence(rng, 600)
    for keep in (600, 450, 300, 0):
        other = base[:keep] + sentence(rng, 600 - keep)
        runs = [Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for w in (base, other)]
        inner = sum(n * runs[1][k] for k, n in runs[0].items())
        want = 2 * inner / sum(n * n for r in runs for n in r.values())
        a, b = (multisethash.pack(multisethash.paragraphs(" ".join(w).encode())) for w in (base, other))
        assert abs(multisethash.likeness(a, b) - want) < 0.2
    many = multisethash.pack(multisethash.paragraphs(b"it " * 200_000))
    assert multisethash.likeness(many, multisethash.pack(multisethash.paragraphs(b"it " * 199_000))) > 0.99


def test_edited_copies(odd):
    docs, rows = odd
    got = multisethash.edited_copies(docs, bins=5).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    want = Counter()
    for k, (i, t, _, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id in (0, 1)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for run in (superminhash.near_duplicates, bwtmerge.remove_repeats, compactwindows.passages, multisethash.edited_copies):
        assert run(none).collect() == []
