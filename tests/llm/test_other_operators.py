"""Pages, licences, ordinal models, mixing, tiling and the pipeline."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import licences, ordinal, pareto, queries, sitetree, tiling
from tessera.llm.shared import stash
from tests.compare import database, differences


# ---- pages -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><nav><a href=x>Home</a></nav>
<div class="menu top">M</div><header>H</header><article><h1>A&amp;B &eacute;</h1><p><b>One  two<br>three<p>Four&nbsp;five</p>
<div class="share">Share</div><form><input>F</form></article><section id=comments>C</section><footer>&copy;</footer></body></html>"""


def kept(page: str) -> list[str]:
    """What the markup of one page alone leaves."""
    return [b["text"] for b in sitetree.page_record(page)[1] if b["prior"] > sitetree.ROLE]


def test_blocks_of_a_page():
    assert kept(PAGE) == ["A&B é", "One two three", "Four five"]


def test_hidden_parts_comments_and_broken_quotes():
    page = """<article><p>Kept</p><article class="comment"><p>Reader says</p></article><p hidden>Not seen</p><div style="color:red; display: none">Nor this</div>
<p>One <a title="x>b</p><p>Two</p></article>"""
    assert kept(page) == ["Kept", "One b", "Two"]
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    assert kept(long) == ["word & word"] * 20_000


STORY = "The story goes on for a while, as stories do, and nobody knows where it ends. " * 3


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content no-sidebar"><p>{}</p></div></body>',
        '<form id="aspnetForm"><div><p>{}</p></div><input></form>',
        '<main><article class="post comment-enabled"><p>{}</p></article></main>',
        '<section class="banner-story"><p>{}</p></section>',
        '<p class="share-price">{}</p>',
        '<article><p>Read this too</p></article><div id="story"><p>{}</p></div>',
        "<article><svg/><p>{}</p></article>",
        "<article><svg><p>{}</p></article>",
        '<article><p>{}</p></article><div class="site-footer">Us</div><ul class="comment-list"><li>I say</li></ul>',
        '<article><p>{}</p></article><div><p>Other things</p></div>',
        "<main><p>{}</p></main><div><p>" + STORY * 9 + "</p></div>",
        '<div><p>{}</p></div><form>Name <input><p>Write to us</p></form>',
        '<ul><li><a href=x>' + STORY + "</a></ul><article><p>{}</p></article>",
    ],
)
def test_ordinary_pages_keep_their_story_and_nothing_else(page):
    assert kept(page.replace("{}", STORY)) == [STORY.strip()]


@pytest.mark.parametrize("page", ["<font>x" * 100_000, "<div>x" * 100_000 + "</b>" * 100_000, "<b><div>x" * 50_000 + "</b>" * 50_000, "<svg>x" * 100_000, "<form><li>x" * 50_000])
def test_pages_nested_without_end(page):
    import time

    start = time.process_time()
    assert "".join(kept(page)).count("x") == page.count("x")
    assert time.process_time() - start < 20


PAGES = "page_id long, url string, html string, content string, uid string"


def test_site_tree_cuts_what_all_pages_of_a_host_say(spark):
    page = "<html><body><div class=box><p>Always the same</p></div><div class=story{1}><p>Story {0}</p><p>More {0}</p></div><p class=share-price>Rate us</p></body></html>"
    rows = [(i, f"http://a.com/{i}", page.format(i, i), None, "u") for i in range(30)] + [(90, None, None, None, None), (91, "u", "", "", ""), (92, "http://b.com", "<p>cut off <b", "c", "d"), (None, "http://c.com/x", "plain", "c", "d")]
    rows += [(200 + i, "http://copies.com", page.format(7, 7), "", "") for i in range(40)] + [rows[3], rows[3]]
    found = sitetree.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows)
    assert all(got[i] == f"Story {i}\nMore {i}" for i in range(30))
    assert all(r.n_cut == 2 for r in found if r.host == "a.com")
    # copies of one page are one page, which repeats nothing
    assert all(got[200 + i] == "Always the same\nStory 7\nMore 7\nRate us" for i in range(40))
    assert (got[90], got[91], got[92], got[None]) == ("", "", "cut off", "plain")
    assert sitetree.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_importance_equals_plain_counts(spark):
    import math
    import random
    from collections import Counter, defaultdict

    rng = random.Random(4)
    parts = ["<ul><li>{}</li></ul>", "<p>{}</p>", "<div class=x{}>a<b>b</b></div>", "<section>{}<h2>t</h2></section>", "<section>{}<h3>t</h3></section>"]
    rows = [(i, f"http://h{i % 3}/", "".join(rng.choice(parts).format(rng.randint(0, 3)) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    different = {(u, tuple(f), tuple(s)) for _, u, h in rows for f, s in [sitetree.parse(h)]}
    texts, shapes, pages = defaultdict(Counter), defaultdict(Counter), Counter()
    for url, blocks, forms in different:
        nodes = {b[0] for b in blocks}
        facts = {(b[0], b[1]) for b in blocks}, {x for x in forms if x[0] in nodes}
        for n in nodes:
            pages[url, n] += 1
        for n, t in facts[0]:
            texts[url, n][t] += 1
        for n, s in facts[1]:
            shapes[url, n][s] += 1
    want = {}
    for key, m in pages.items():
        base = math.log(max(m, 2))
        content = 1 - sum(math.log(n) for n in texts[key].values()) / len(texts[key]) / base
        total = sum(shapes[key].values())
        form = -sum(n / total * math.log(n / total) for n in shapes[key].values()) / base if total else content
        want[key] = (m, ((0.1 * form + 0.9 * content) * m + 1) / (m + 1))
    parsed = stash(sitetree.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "pages")
    got = {(f"http://{r.host}/", r.node): (r.pages, r.importance) for r in sitetree.node_importance(parsed).collect()}
    assert got.keys() == want.keys()
    for key, (m, x) in want.items():
        assert got[key][0] == m and got[key][1] == pytest.approx(x, abs=1e-9)


def test_real_pages_keep_their_article(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_sitetree(spark, sf).collect():
        part = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", part)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


# ---- licences --------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    rows = [(0, mit), (1, mit.upper().replace("LICENSE", "LICENCE")), (2, "Copyright 2020 Someone\n" + mit.replace(".", " !")), (3, mit + " more"), (4, None), (5, ""), (6, "text\nReleased under the MIT licence!\nx"), (6, "text\nReleased under the MIT licence!\nx")]
    got = sorted((r.doc_id, r.licence, tuple(r.notices)) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "MIT", ()), (1, "MIT", ()), (2, "MIT", ()), (3, None, ()), (4, None, ()), (5, None, ()), (6, None, ("MIT",)), (6, None, ("MIT",))]


def test_wrapped_licences(spark):
    """Every known text in lines of 78 and 60 characters, and as one line a sentence, with a statement of copyright."""
    import textwrap

    rows = []
    for name, text in licences.TEXTS.items():
        paragraphs = [x for x in text.split("\n") if not x.lower().startswith("copyright (c) <") and not x.startswith("Copyright <")]
        for width in (60, 78):
            rows.append((name, "\n\n".join([paragraphs[0], " * Copyright (c) 2019-2021, Some One <one@example.org>", *(textwrap.fill(x, width) for x in paragraphs[1:])])))
        rows.append((name, "(c) 2020 Someone\n" + text))
    got = licences.scan(spark.createDataFrame(rows, "name string, text string")).filter("licence is null or licence <> name").collect()
    assert [r.name for r in got] == []


@pytest.mark.parametrize(("name", "file"), [("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")])
def test_digests_of_published_texts(spark, name, file):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("the system has no copies of common licences")
    rows = [(path.read_text(),), (" ".join(path.read_text().upper().replace("LICENSE", "LICENCE").split(" ")),)]
    assert {r.licence for r in licences.scan(spark.createDataFrame(rows, "text string")).collect()} == {name}


def test_columns_named_like_results(spark):
    """A column that is named like a result column is replaced, all others stay."""
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "a", 1.0, 2, "t")], "doc_id long, text string, notices string, p_toxic double, selected int, tails string")
    out = licences.scan(docs)
    assert out.columns == ["doc_id", "text", "p_toxic", "selected", "tails", "canonical_sha256", "canonical_chars", "licence", "notices"] and out.first().notices == ["MIT"]
    model = ordinal.Ordinal([0.0, 1.0], {})
    out = ordinal.toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "notices", "selected", "tails", "p_toxic", "p_severe", "expected_severity", "rejected"]
    assert abs(out.first().p_toxic - 0.5) < 1e-9 and out.first().tails == "t"
    assert ordinal.quality(docs, model).columns == ["doc_id", "text", "notices", "p_toxic", "tails", "expected_grade", "p_tail", "selected"]
    assert tiling.contaminations(docs.withColumnRenamed("notices", "found"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).first().found == []


def test_cumulative_links_reach_the_likelihood_of_an_independent_fit():
    """Without shrinking, plain gradient ascent on the same likelihood ends no higher, and scores agree."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(8, 3, replace=False)) for _ in range(600)]
    strength = rng.normal(size=8)
    grade = np.digitize([strength[r].sum() + rng.logistic() for r in rows], [-0.5, 1.0])
    x = np.zeros((600, 8))
    for i, r in enumerate(rows):
        x[i, r] = 1

    def likelihood(w, theta):
        cdf = lambda k: 1 / (1 + np.exp(-(np.concatenate([[-40], theta, [40]])[k] - x @ w)))
        return np.log(np.maximum(cdf(grade + 1) - cdf(grade), 1e-12)).sum()

    w, theta = np.zeros(8), np.array([-0.5, 0.5])
    for _ in range(1500):
        grad = np.array([(likelihood(w + e, theta) - likelihood(w - e, theta)) / 2e-4 for e in np.eye(8) * 1e-4])
        push = np.array([(likelihood(w, theta + e) - likelihood(w, theta - e)) / 2e-4 for e in np.eye(2) * 1e-4])
        w, theta = w + 0.003 * grad, theta + 0.003 * push
    model = ordinal.fit(rows, grade, rounds=2000, shrink=0.0)
    own = np.array([model.weights.get(k, 0.0) for k in range(8)])
    assert likelihood(own, np.array(model.theta)) > likelihood(w, theta) - 1
    assert np.corrcoef(x @ own, x @ w)[0, 1] > 0.99


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert differences([tuple(r) for r in df.collect()], df.columns, database(sf), queries.SQL[name]) == []


# ---- ordinal models --------------------------------------------------------------------------------------------------


def test_cumulative_links_on_four_grades():
    rng = np.random.default_rng(0)
    strength = rng.normal(size=60)
    rows = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(3000)]
    score = np.array([strength[r].sum() for r in rows])
    grade = np.digitize(score, np.quantile(score, [0.4, 0.7, 0.9]))
    model = ordinal.fit(rows[:2000], grade[:2000], shrink=0.1)
    assert model.theta == sorted(model.theta) and len(model.theta) == 3
    tails = model.tails(np.array([sum(model.weights.get(int(k), 0) for k in r) for r in rows[2000:]]))
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert np.corrcoef(tails.sum(axis=1), grade[2000:])[0, 1] > 0.85


def test_held_out_labels(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    held = docs.join(labels.filter("doc_id % 5 = 0"), "doc_id")
    train = labels.filter("doc_id % 5 <> 0")
    t = {(r.toxic, r.rejected): r["count"] for r in ordinal.toxicity(held, ordinal.severity_model(docs, train)).groupBy("toxic", "rejected").count().collect()}
    assert t[1, True] >= 0.8 * (t[1, True] + t.get((1, False), 0)) and t.get((0, True), 0) <= 0.01 * t[0, False]
    q = {(r.quality, r.selected): r["count"] for r in ordinal.quality(held, ordinal.quality_model(docs, train)).groupBy("quality", "selected").count().collect()}
    assert q[0, False] >= 0.85 * (q[0, False] + q.get((0, True), 0)) and q[1, True] >= 0.97 * (q[1, True] + q.get((1, False), 0))
    assert held.filter(F.lit(False)).count() == 0


def test_odd_rows_of_ordinal_models(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (None, None, None), (2, "", ""), (3, "bad " * 5000, "y")], "doc_id long, text string, rejected string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.severity_model(docs, labels)
    assert ordinal.toxicity(docs, model).count() == 4
    empty = ordinal.severity_model(docs, labels.filter("false"))
    assert {(r.p_toxic, r.rejected) for r in ordinal.toxicity(docs, empty).collect()} == {(None, False)}
    assert ordinal.quality(docs.filter("false"), empty).collect() == []


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing_comes_near_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", "c", None][i % 4] if i % 3 else "hot") for i in range(2000)]
    rows += [(None, None, None), (5, "x y", "a"), (5, "x y", "a"), (7, "", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    one = pareto.mix_sources(docs).collect()
    two = pareto.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == len(rows)
    total: dict = {}
    for r in one:
        assert r.taken <= 2 * r.size
        total.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(t - k) <= 2 for t, k, _ in total.values())
    assert abs(sum(t for t, _, _ in total.values()) - 1.5 * sum(s for _, _, s in total.values())) < 1e-6
    assert pareto.mix_sources(docs.filter("false")).collect() == []


def test_mixing_with_one_very_long_document(spark):
    rows = [(i, "w " * 100, "a", "taken") for i in range(100)] + [(100, "w " * 20_000, "a", "x"), (101, "w " * 26_000, "b", "x")]
    got = pareto.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size string"), weights=(13, 15), carry=["doc_id", "size"]).collect()
    assert got[0].__fields__ == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    # of 84,000 words a gets 39,000: all once, and of the rest of 9,000 nothing for the long one; b is nearer to 45,000 with two copies
    taken = {s: sum(r.taken for r in got if r.source_size == s) for s in (30_000, 26_000)}
    assert taken == {30_000: 39_000, 26_000: 52_000}


def test_long_documents_have_better_ranks(spark):
    rows = [(i, "w " * (10 if i % 2 else 90), "a") for i in range(4000)] + [(5000, "w " * 200_000, "b")]
    got = pareto.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.3, weights=(1, 1)).collect()
    share = lambda size: sum(r.copies for r in got if r.size == size) / 2000
    target = next(r.target for r in got if r.size == 10)
    chance = [target * x / (2000 * (10**2 + 90**2)) for x in (10, 90)]
    assert abs(share(10) - chance[0]) < 0.04 and abs(share(90) - min(chance[1], 1)) < 0.04


# ---- tiling ----------------------------------------------------------------------------------------------------------


def brute_tiles(a, b, least):
    used_a, used_b, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        out += n


def test_tiles_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        assert sum(t[2] for t in tiling.tiles(a, b, 3)) == brute_tiles(a.tolist(), b.tolist(), min(3, len(a)))


def test_tiles_of_a_word_that_goes_on_repeating():
    item, doc = np.zeros(200, np.uint64), np.zeros(8000, np.uint64)
    assert tiling.tiles(item, doc) == [(0, 0, 200)]
    item[100] = 7
    assert sum(t[2] for t in tiling.tiles(item, doc)) == 199


def test_contaminations(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "x kappa lambda mu y Zeta eta theta iota z ALPHA beta gamma delta epsilon w"
    docs = spark.createDataFrame([(1, f"before {item} after", 0), (2, moved, 0), (3, "alpha beta gamma delta epsilon only", 0), (4, None, 0), (None, "", 0), (5, "tiny item", 0)], "doc_id long, text string, found int")
    items = spark.createDataFrame([(7, item), (8, "tiny item"), (9, None), (10, "")], "item_id long, text string")
    for filter_seeds in (0, 1_000_000):
        got = {r.doc_id: sorted(x.item_id for x in r.found) for r in tiling.contaminations(docs, items, filter_seeds=filter_seeds).collect()}
        assert got == {1: [7], 2: [7], 3: [], 4: [], None: [], 5: [8]}
    assert all(r.found == [] for r in tiling.contaminations(docs, items.filter("false")).collect())


def test_contaminations_match_brute_force_without_seeds(spark):
    """Copies with every fourth or fifth word changed, and with pieces of 3 and 4 words in another order."""
    rng = np.random.default_rng(6)
    items = [[f"w{x}" for x in rng.integers(0, 60, n)] for n in (40, 41, 25, 12, 7, 3, 2, 1)]
    docs = [[w if i % every else "new" for i, w in enumerate(x)] for x in items for every in (4, 5)]
    for x in items[:4]:
        pieces = [x[i : i + 3 + i % 2] for i in range(0, len(x), 4)]
        docs.append([w for k in rng.permutation(len(pieces)) for w in ["and", *pieces[k]]])
    docs += [[f"w{x}" for x in rng.integers(0, 60, 80)] for _ in range(10)]
    number: dict = {}
    coded = lambda x: [number.setdefault(w, len(number)) for w in x]
    want = {d: [i for i, x in enumerate(items) if brute_tiles(coded(x), coded(y), min(3, len(x))) >= 0.8 * len(x)] for d, y in enumerate(docs)}
    assert want[1][0] == 0
    rows = spark.createDataFrame([(d, " ".join(y)) for d, y in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for filter_seeds in (0, 1_000_000):
        got = {r.doc_id: sorted(x.item_id for x in r.found) for r in tiling.contaminations(rows, bench, filter_seeds=filter_seeds).collect()}
        assert got == want


# ---- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, sf), name)
        assert docs.count() <= before.count()
        if name != "mixing":
            assert docs.columns == before.columns
    assert docs.count() > 100 and docs.filter("taken > 2 * size").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, None, None, None, None), (4, "", "en", "b", 0), (5, "é " * 3000, "fr", "a", 6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of the copies 1, 1 and 2 one stays; 5 repeats itself all over
    assert sorted(str(r.doc_id) for r in left) == ["1", "4", "None"]


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    names = ["k1", "k2", "left", "spans", "kept", "n_bytes", "rejected", "found", "row", "group", "expected_severity", "__text"]
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(80))
    rows = [(i, text(i), "en", "a", 1, *(f"{c}{i}" for c in names)) for i in range(4)]
    more = ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in any of them at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, str(tmp_path)), name)
        assert sorted(tuple(r) for r in docs.collect()) == rows, name


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_arrow_batches_are_small_whatever_the_texts(spark):
    def sizes(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789"), 800).alias("text"))
    got = stash(texts.mapInArrow(sizes, "bytes long, rows long"), "sizes").agg(F.max("bytes"), F.sum("rows")).first()
    assert got[0] < 12 << 20 and got[1] == 4000
