"""Main text of web pages by site style trees (Yi, Liu and Li, 2003).

The pages of a host are merged into one tree: a style node is a path of block elements with their ids and classes (digits
in them count alike), known by a chained 64-bit hash. Two counts, made with partial aggregation over the different pages of
the host, give the importance of a node:

* presentation: the entropy, to the base of the number of pages that have the node, of the sequences of children it has;
* content: one minus the mean, over the different texts of the node, of log(pages with the text) / log(pages with the
  node): 1 where every page says something else, 0 where all say the same.

``importance = (1 - GAMMA) * presentation + GAMMA * content``, then averaged with ``DOUBT`` pages of importance 1, so that
few pages prove little and no host size is a special case. Equal pages of a host count once. A branch goes where all of its
leaves are under ``THRESHOLD``, so leaves alone are judged.

Markup is prior knowledge about what a single page can't show by repetition. It scales the importance of a block:

* by ``ROLE``, which is under the threshold whatever the tree says, where an element or a whole class name, id or ARIA role
  names another role (nav, footer, aside, class "ad", "site-footer", "comment-list", ...), or a form that isn't the frame of the page;
* by ``HINT`` where only a part of a class name does ("share-price", "banner-story"): such a block goes if the tree also
  finds it repeated. Names of states ("no-sidebar", "comment-enabled") say nothing;
* the marked article or main part has ``SUPPORT`` at least before that. What lies outside of it goes, if it is a main
  element or an article with the page's heading; other articles stand against the rest by the cube of their text outside of
  links, and the side whose odds are under the threshold goes: a teaser beside the story, or what surrounds the story.

Only counts are grouped by host, so one host with a third of all pages is a skewed key of sums. Scores are joined by
(host, node), broadcast if few by their count; then each page gets those of its own nodes.

Defined results: a null html is an empty page with an empty text; a null url is a host of its own; broken markup (unclosed
elements, cut-off tags) is read as browsers do, but that a quote which never closes ends with its tag; elements deeper than
``DEPTH`` follow their parent instead of going deeper, as in browsers; character references are decoded once; repeated rows
give a row each; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fits, stash, trimmed

GAMMA, THRESHOLD, DOUBT = 0.9, 0.15, 1.0
ROLE, HINT, SUPPORT = 0.1, 0.5, 0.2
DEPTH = 512
#: Scores up to this many rows are broadcast; more are joined by key.
FEW, SMALL = 200_000, 16 << 20

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>]|["'][^>]*)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style textarea title noscript iframe template".split()) | FOREIGN
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption head html legend optgroup option select tbody td tfoot th thead tr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
BARRIER = frozenset("ul ol dl table select".split())
#: Markup that names a role outside the main text.
NOISE_TAGS = frozenset("head nav footer aside script style noscript template iframe svg math button select textarea menu dialog object canvas video audio".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer comment comments respond disqus reply replies cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager copyright disclaimer skip".split())
#: Parts of class names that say where a role is or what it is made of, and parts that make the name a state.
PLACES = frozenset("site page global main top bottom left right upper lower box block list section area wrapper wrap container inner outer bar item items link links form slot unit posts row col column group panel thread body text primary secondary".split())
STATES = frozenset("no not without with has is enabled disabled open closed on off hide show".split())
ALWAYS = frozenset("comments disqus replies".split())
SPLIT_NAME = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")
CLOSING = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}


def hash_text(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed & ((1 << 64) - 1)) - (1 << 63)


def name_prior(own: str) -> float:
    """How ids and classes (lower case, by spaces) scale the importance of their element."""
    found = 1.0
    for name in own.split():
        parts = [x for x in SPLIT_NAME.split(name) if x]
        noisy = [x for x in parts if x in NOISE_NAMES]
        if not noisy or any(x in STATES for x in parts):
            continue
        whole = all(x in NOISE_NAMES or x in PLACES or x.isdigit() for x in parts) or any(x in ALWAYS for x in parts)
        found = min(found, ROLE if whole else HINT)
    return found


def parse(page: str) -> tuple[list[tuple[int, str, float, int, int]], list[tuple[int, int]]]:
    """Blocks (node, text, prior, place, free) in page order, and (node, hash of the children) of each block element. The
    place is 2 in a main element or in an article with a first-level heading, 1 in another article, else 0; ``free`` is how
    many code points of the text are outside of links. Time and memory grow with the page, however it is nested."""
    blocks: list[list] = []
    shapes: list[tuple[int, int]] = []
    buf: list[str] = []
    links = 0  # code points of buf that are in links
    # an element: tag, node, prior, place record, form record, children, in a link
    root = ["", hash_text(""), 1.0, None, None, {}, False]
    stack = [root]
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal links
        if buf:
            text = " ".join(htmllib.unescape("".join(buf)).split())
            buf.clear()
            if text:
                top = stack[-1]
                blocks.append([top[1], text, top[2], top[3], top[4], max(0, len(text) - links)])
        links = 0

    def left(e: list) -> None:
        opened[e[0]] -= 1
        if e[5]:
            shapes.append((e[1], hash_text(",".join(e[5]))))

    def pop(to: int) -> None:
        flush()
        for e in stack[to:]:
            left(e)
        del stack[to:]

    def text_of(part: str) -> None:
        nonlocal links
        buf.append(part)
        if stack[-1][6]:
            links += len(part)

    at, end, unclosed = 0, len(page), set()
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text_of(page[at:])
            break
        if m.start() > at:
            text_of(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if tag in BLOCKS:
                    pop(i)
                elif not any(e[0] in BLOCKS for e in stack[i + 1 :]):
                    if stack[i][2] != stack[i - 1][2]:
                        flush()
                    for e in stack[i:]:
                        left(e)
                    del stack[i:]
                else:
                    left(stack[i])
                    del stack[i]
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag in RAW:
            if tag in FOREIGN and m[3].rstrip().endswith("/"):
                continue
            close = None if tag in unclosed else CLOSING[tag].search(page, at)
            if close:
                at = page.find(">", close.start()) + 1 or end
            else:
                unclosed.add(tag)
                if tag not in FOREIGN:
                    at = end
            if tag in ("title", "noscript", "iframe", "template"):
                flush()
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"))
        if tag in ENDS and any(opened[x] > 0 for x in ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS[tag]:
                    pop(i)
                    break
                if stack[i][0] in BARRIER:
                    break
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if len(stack) > DEPTH:
            if stack[-1][0] in BLOCKS:
                pop(DEPTH)
            else:
                if stack[-1][2] != stack[-2][2]:
                    flush()
                left(stack.pop())
        up, label, prior = stack[-1], tag, 1.0
        # the page's own article may be called anything; articles in it are judged like other elements
        own_frame = tag in ("html", "body", "main") or tag == "article" and up[3] is None
        if m[3]:
            names = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])}
            own = f"{names.get('id', '')} {names.get('class', '')}".lower()
            label = tag + "".join(f".{x}" for x in sorted({DIGITS.sub("#", x) for x in own.split()}))
            if not own_frame:
                prior = name_prior(own)
                if names.get("role", "").lower() in NOISE_ROLES or "hidden" in names or names.get("aria-hidden") == "true" or UNSEEN.search(names.get("style", "")):
                    prior = ROLE
        if tag in NOISE_TAGS or tag == "header" and up[3] is None:
            prior = ROLE
        place, form = up[3], up[4]
        if tag == "form" and form is None:
            form = [False, 0]
        elif tag in ("article", "main", "h1") and form is not None:
            form[0] = True
        if tag == "main" or tag == "article" and place is None:
            place = [2 if tag == "main" else 1]
        elif tag == "h1" and place is not None:
            place[0] = 2
        prior = min(prior, up[2])
        if prior != up[2]:
            flush()
        if tag in BLOCKS:
            up[5][label] = None
            node = hash_text(label, up[1])
        else:
            node = up[1]
        stack.append([tag, node, prior, place, form, {}, up[6] or tag == "a"])
        opened[tag] += 1
    pop(1)
    if root[5]:
        shapes.append((root[1], hash_text(",".join(root[5]))))

    # a form with the page's heading, article or most of its free text is the frame of the page
    free = sum(b[5] for b in blocks if b[2] > ROLE)
    for b in blocks:
        if b[4] is not None and b[2] > ROLE:
            b[4][1] += b[5]
    for b in blocks:
        if b[4] is not None and not b[4][0] and 2 * b[4][1] <= free:
            b[2] = ROLE
    return [(n, t, p, w[0] if w else 0, f) for n, t, p, w, _, f in blocks], shapes


def judged(blocks: list[tuple[int, str, float, int, int]]) -> list[float]:
    """The prior of each block after its page's marked part was weighed: ROLE where it goes whatever the tree says."""
    live = [b for b in blocks if b[2] > ROLE]
    if any(b[3] == 2 for b in live):
        return [b[2] if b[3] == 2 else min(b[2], ROLE) for b in blocks]
    inside, outside = (sum(b[4] for b in live if (b[3] > 0) == marked) ** 3 for marked in (True, False))
    if not inside + outside:
        return [b[2] for b in blocks]
    odds = inside / (inside + outside)
    return [min(b[2], ROLE) if (odds if b[3] else 1 - odds) < THRESHOLD else b[2] for b in blocks]


BLOCK = pa.struct([("node", pa.int64()), ("text", pa.string()), ("prior", pa.float64()), ("main", pa.bool_())])
FEATURE = pa.struct([("node", pa.int64()), ("kind", pa.int8()), ("value", pa.int64())])
PARSED = "uid long, page_id long, url string, host string, content long, blocks array<struct<node:long,text:string,prior:double,main:boolean>>, features array<struct<node:long,kind:tinyint,value:long>>"
NODE, TEXT, SHAPE = 0, 1, 2


def page_record(page: str) -> tuple[int, list[dict], list[dict]]:
    """(hash of blocks and children in page order, blocks, features): the features are the different nodes, texts and child sequences of the page."""
    found, shapes = parse(page)
    blocks = [{"node": b[0], "text": b[1], "prior": p, "main": b[3] > 0} for b, p in zip(found, judged(found), strict=True)]
    seen: dict[tuple[int, int, int], None] = {}
    for b in blocks:
        seen[b["node"], NODE, 0] = None
        seen[b["node"], TEXT, hash_text(b["text"])] = None
    with_text = {b["node"] for b in blocks}
    for node, shape in shapes:
        if node in with_text:
            seen[node, SHAPE, shape] = None
    content = xxhash.xxh3_64()
    for x in found + shapes:
        content.update(repr(x))
    return content.intdigest() - (1 << 63), blocks, [dict(zip(("node", "kind", "value"), k, strict=True)) for k in seen]


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    host = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.lower(host).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(it):
        for b in it:
            contents, blocks, features = zip(*map(page_record, b.column(4).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            made = [pa.array(contents, pa.int64()), pa.array(blocks, pa.list_(BLOCK)), pa.array(features, pa.list_(FEATURE))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], ["uid", "page_id", "url", "host", "content", "blocks", "features"])

    return rows.mapInArrow(trimmed(run), PARSED)


def node_importance(parsed: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the style nodes with text of each host; ``pages`` are different pages."""
    first = parsed.groupBy("host", "content").agg(F.min("uid").alias("uid")).select("uid")
    each = parsed.select("uid", "host", "features").join(first, "uid", "left_semi").select("host", F.inline("features"))
    times = each.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"))
    # per node: pages, mean of log(n) over its texts, entropy terms of its child sequences
    node = times.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == NODE, F.col("n"))).alias("pages"),
        F.avg(F.when(F.col("kind") == TEXT, F.ln("n"))).alias("same"),
        F.sum(F.when(F.col("kind") == SHAPE, F.col("n"))).alias("shaped"),
        F.sum(F.when(F.col("kind") == SHAPE, F.col("n") * F.ln("n"))).alias("nlogn"),
    )
    base = F.ln(F.greatest("pages", F.lit(2)))
    content = 1 - F.col("same") / base
    shape = F.coalesce((F.ln("shaped") - F.try_divide("nlogn", "shaped")) / base, content)
    raw = (1 - GAMMA) * shape + GAMMA * content
    return node.select("host", "node", "pages", ((raw * F.col("pages") + DOUBT) / (F.col("pages") + DOUBT)).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, host, text, n_chars, n_cut): the main text of each page and how many blocks went because the pages of
    the host repeat them."""
    parsed = stash(parsed_pages(pages, id_col, url_col, html_col), "pages")
    low = stash(node_importance(parsed).filter(F.col("importance") < threshold / HINT).select("host", "node", "importance"), "importance")
    small = low.limit(FEW + 1).count() <= FEW
    own = parsed.select("uid", "host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: b["prior"] > ROLE), lambda b: b["node"]))).alias("node"))
    scores = own.join(F.broadcast(low) if small else low, ["host", "node"]).groupBy("uid").agg(F.collect_list(F.struct("node", "importance")).alias("scores"))
    scores = stash(scores, "scores")
    both = parsed.drop("features", "content").join(F.broadcast(scores) if fits(scores, SMALL) else scores, "uid", "left")

    def run(it):
        for b in it:
            texts, n_cut = [], []
            for blocks, found in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                tree = {x["node"]: x["importance"] for x in found or ()}
                live = [x for x in blocks if x["prior"] > ROLE]
                kept = []
                for x in live:
                    importance = tree.get(x["node"], 1.0)
                    if x["main"]:
                        importance = max(importance, SUPPORT)
                    if importance * x["prior"] >= threshold:
                        kept.append(x["text"])
                texts.append("\n".join(kept))
                n_cut.append(len(live) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(texts, pa.string()), pa.array(n_cut, pa.int64())], ["page_id", "url", "host", "text", "n_cut"])

    out = both.select("host", "page_id", "url", "blocks", "scores").mapInArrow(trimmed(run), "page_id long, url string, host string, text string, n_cut long")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
