"""Chat windows, page extraction, exact search, and the pipeline."""

import hashlib
import math
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkyard.llm import chat, html_text, queries, topk

TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversations():
    rng = random.Random(4)
    out = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(8):
        if c % 2:
            out.append((c, 0, "system", "Be \\ brief <s>"))
        for t in range(1, 60 if c == 3 else rng.randrange(2, 9)):
            text = rng.choice([None, "", "a\\", "\\\\<s>", "<</s>", "x [/INST] y\n\n", "word " * rng.randrange(1, 400), "é <|x|> 漢字"])
            out.append((c, t, rng.choice(["user", "assistant", "tool</s>", None]), text))
    out += [(None, None, "assistant", "tie"), (None, None, "assistant", "tie"), (50, None, None, None)]
    return out


def test_chat_digests(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumn("before", F.lit(1)).withColumn("parts", F.lit("x"))
    windows = chat.format_windows(df, budget=300, history=40)
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        target = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    some = windows.collect()
    assert sum(got[c]["formatted_chars"] for c in by) == sum(len(r["formatted"]) for r in some)
    long = sorted((r for r in some if r["conv_id"] == 3), key=lambda r: r["window"])
    assert len(long) > 3 and all(r["formatted"].startswith("<s>[INST]system[/INST]") and r["n_repeated"] >= 1 for r in long[1:])
    assert max(r["n_repeated"] for r in long) > 1


def test_chat_budget(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "word " * 20) for t in range(200)]
    out = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=300, history=60).collect()
    assert max(r["n_tokens"] for r in out) <= 300 and len(out) > 10


@pytest.mark.parametrize("seed", range(3))
def test_chat_budget_with_system_turn(spark, seed):
    """The system turn counts: every window keeps to the budget where no turn is longer than two strides, and history is repeated."""
    rng = random.Random(seed)
    lead = rng.choice([0, 100, 400, 560])
    rows = [(1, 0, "system", "rule " * lead)] + [(1, t, "assistant" if t % 2 else "user", "word " * rng.randrange(1, max(2, 820 - lead - 20) if t % 9 == 0 else 120)) for t in range(1, 600)]
    out = chat.format_windows(spark.createDataFrame(rows, TURNS)).collect()
    assert max(r["n_tokens"] for r in out) <= 1024
    assert all(r["n_repeated"] >= 1 for r in out if r["window"] > 0) and max(r["n_repeated"] for r in out) > 1
    assert sum(len(chat_turns(r["formatted"])) - r["n_repeated"] for r in out) == 600


def chat_turns(formatted):
    return formatted.split("</s>")[:-1]


def test_chat_beyond_the_budget(spark):
    rows = [(1, 0, "system", "rule " * 900), (1, 1, "user", "word"), (1, 2, "assistant", "word " * 5000), (1, 3, "user", "word " * 200), (2, 0, "user", "long " * 200_000), (2, 1, "assistant", "short")]
    out = sorted((r["conv_id"], r["window"], r["n_tokens"], r["n_repeated"]) for r in chat.format_windows(spark.createDataFrame(rows, TURNS)).collect())
    # System turn alone; it and a short turn; those and the long one, alone but for history; no history fits after that.
    assert [(c, n, k) for c, _, n, k in out] == [(1, 905, 0), (1, 905 + 6, 1), (1, 905 + 6 + 5005, 2), (1, 905 + 205, 1), (2, 200_005, 0), (2, 6, 0)]


def test_chat_empty(spark):
    assert chat.digests(chat.format_windows(spark.createDataFrame([], TURNS))).count() == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("plain <b>text</b> only &amp; more", "plain text only & more"),
    ("<p>a<b>c", "ac"),
    ("<", "<"),
    ("<script>x = '</p>'", ""),
    (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header>Site</header><div class='cookie-notice'>We use cookies</div><article><h1>Head\n line</h1>"
        "<p>First &lt;para&gt; &eacute;<br>more<p>Second   one</p><ul><li>x<li>y</ul><!-- no --><div class='comments'><p>Reader</p></div><form><input>Send</form></article><aside>Side</aside><footer>&copy;</footer></body></html>",
        "Head line\n\nFirst <para> é more\n\nSecond one\n\nx\n\ny",
    ),
    (
        "<body><div id='top'><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div><div id='text'><p>" + "long words here " * 30 + "</p><p>" + "other words there " * 30 + "</p></div>"
        "<div class='sidebar'><p>not me</p></div></body>",
        ("long words here " * 30).strip() + "\n\n" + ("other words there " * 30).strip(),
    ),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


@pytest.mark.parametrize(
    "attributes, kept",
    [
        ('href="/hidden-gems"', True),
        ('title="the hidden truth"', True),
        ('data-hidden="false"', True),
        ("data-class=ad", True),
        ('href="https://x/y?id=ad"', True),
        ("href=/x?class=ad", True),
        ("title='a class=\"ad\" b'", True),
        ("hidden", False),
        ("lang=en HIDDEN=''", False),
        ("title='x'class=\"ad\"", False),
        ("id = ad", False),
        ('aria-hidden="true"', False),
        ('aria-hidden="false"', True),
        ('style="color: red; display : none"', False),
    ],
)
def test_page_attributes(attributes, kept):
    page = f"<body><article><p>words before</p><p {attributes}>words here</p><p>words after</p></article></body>"
    assert html_text.main_text(page) == ("words before\n\nwords here\n\nwords after" if kept else "words before\n\nwords after")


PARAGRAPHS = "<p>" + "long words here " * 30 + "</p><p>" + "other words there " * 30 + "</p>"
ARTICLE_TEXT = ("long words here " * 30).strip() + "\n\n" + ("other words there " * 30).strip()


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="content-sidebar-wrap"><div id="text">', '</div><div class="sidebar"><p>not me</p></div></div>'),
        ('<div class="has-sidebar"><div>', "</div></div>"),
        ('<div class="has-sidebar"><article>', "</article><div class='widget'>not me</div></div>"),
        ('<div class="post has-comments">', '<div id="comments"><p>not me</p></div></div>'),
        ('<form id="aspnetForm"><div>', "</div><input></form>"),
        ('<div class="sidebar"><main>', "</main></div>"),
        ('<div class="overlay"><div>', "</div></div>"),  # by name boilerplate, but most of the text
        ("<article>", '<form><p>not me</p></form><div class="site-footer-left">not me</div><div id="comments"><article class="comment">not me</article></div></article>'),
    ],
)
def test_page_wrappers(before, after):
    assert html_text.main_text(f"<body>{before}{PARAGRAPHS}{after}</body>") == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["story share-price", "search-engine-history", "has-comments-open", "about-the-menu-project"])
def test_page_containers_with_telling_words(name):
    assert html_text.main_text(f'<body><nav><a href="/">Home</a></nav><div class="{name}">{PARAGRAPHS}</div><div class="sidebar"><p>not me</p></div></body>') == ARTICLE_TEXT


READERS = "<div class='comment'><p>" + "not me but a reader " * 30 + "</p></div>"


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div id='content'>", f"<div id='comments'><h3>not me</h3>{READERS * 6}</div></div>"),  # far more of them than of the article
        ("<div class='x1'>", f"</div><section class='comments'>{READERS * 6}</section>"),
        ("<div class='x1'>", f"<div class='reader-comments'><p>{'not me ' * 900}</p></div></div>"),
        ("<main><article>", f"</article><section id='comments'>{READERS.replace('div', 'article') * 6}</section></main>"),
        ("<article>", f"<article class='comment'>{'not me ' * 900}</article></article>"),
        ("<article>", "<div class='ad-slot'>not me</div><div class='ad-wrapper'>not me</div></article>"),
        ("<div class='topbar'>not me</div><div class='story'>", "</div><div class='legal'>not me but a long line on rights</div>"),
        ("<article><div class='widget'>", "</div></article><article></article>"),
        ("<article><section id='discussion'>", "</section></article>"),
        ("<article class='promoted'>", "</article>"),  # the only one of the page
        ("<div class='comment'>", "</div>"),  # all of the page
    ],
)
def test_page_boilerplate_beside(before, after):
    assert html_text.main_text(f"<body>{before}{PARAGRAPHS}{after}</body>") == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["discussion", "legal", "announcement"])
def test_page_sections_of_an_article(name):
    page = f"<body><article>{PARAGRAPHS}<section id='{name}'><p>A short section.</p></section></article></body>"
    assert html_text.main_text(page) == ARTICLE_TEXT + "\n\nA short section."


def test_page_wrapped_in_an_article_beside_another():
    page = f"<body><article><div class='widget'>{PARAGRAPHS}</div></article><article><p>A teaser.</p></article></body>"
    assert html_text.main_text(page).startswith(ARTICLE_TEXT)


class SlowPage(HTMLParser):
    """An independent reading of well-formed pages: a tree of (tag, attributes, children), with paragraphs and list items closed by the next."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.body = ["html", {}, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attributes):
        if tag == "html":
            return
        for closed, by in (("p", html_text.BLOCK), ("li", {"li"})):
            if tag in by and any(x[0] == closed for x in self.open) and not (closed == "li" and self.open[-1][0] in ("ul", "ol")):
                while self.open.pop()[0] != closed:
                    pass
        node = [tag, dict(attributes), []]
        self.open[-1][2].append(node)
        if tag == "body":
            self.body = node
        if tag not in html_text.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in ("html", "body") and any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def slow_text(page):
    """Composite text density by its definition: every figure counted anew for every node."""
    body = SlowPage(page).body
    cut = lambda x, top: x[0] in html_text.CUT or (x[0] == "header" and top) or x[0] == "form" or (x[0] not in ("article", "main", "body") and html_text.names_boilerplate(" ".join(x[1].get(k) or "" for k in ("class", "id", "role")), html_text.HINTS))

    def pruned(x, top):
        top = top and x[0] not in ("article", "main")
        return [x[0], [c if isinstance(c, str) else pruned(c, top) for c in x[2] if isinstance(c, str) or not cut(c, top)]]

    def texts(x, link=False):
        link = link or x[0] == "a"
        for c in x[1]:
            yield from [(c, link)] if isinstance(c, str) else texts(c, link)

    def nodes(x):
        yield x
        for c in x[1]:
            if not isinstance(c, str):
                yield from nodes(c)

    size = lambda parts: sum(len(t.replace(" ", "").replace("\n", "")) for t in parts)
    root = pruned(body, True)
    share = size(t for t, link in texts(root) if link) / max(1, size(t for t, _ in texts(root)))

    def formula(c, t, lc, lt):
        if not c:
            return 0.0
        return c / t * math.log(max(1, c / max(lc, 1) * t / max(lt, 1))) / math.log(math.log(c * lc / max(c - lc, 1) + share * c + math.e) + math.e - 1)

    def measured(x):
        below = list(nodes(x))
        c, lc = size(t for t, _ in texts(x)), size(t for t, link in texts(x) if link)
        return formula(c, max(1, len(below) - 1), lc, sum(n[0] == "a" for n in below))

    def total(x):
        own = size(c for c in x[1] if isinstance(c, str))
        return formula(own, 1, own if x[0] == "a" else 0, 1) + sum(measured(c) for c in x[1] if not isinstance(c, str))

    def path(x, to):
        if x is to:
            return [x]
        for c in x[1]:
            if not isinstance(c, str) and (p := path(c, to)):
                return [x, *p]
        return []

    every = list(nodes(root))
    seed = max(every, key=total)
    threshold = min(map(measured, path(root, seed)))
    taken = []
    for x in every:
        if x is seed or (x is not root and measured(x) >= threshold and size(t for t, _ in texts(x))):
            pick = max(nodes(x), key=total)
            up = [y for y in path(root, pick) if y[0] in ("article", "main")]
            taken.append(id(up[-1] if up else pick))
    out = [""]

    def show(x, inside):
        inside = inside or id(x) in taken
        block = x[0] in html_text.BLOCK
        if block:
            out.append("")
        for c in x[1]:
            if not isinstance(c, str):
                show(c, inside)
            elif inside:
                out[-1] += c
        if x[0] == "br":
            out[-1] += " "
        if block:
            out.append("")

    show(root, False)
    return "\n\n".join(t for t in (" ".join(x.split()) for x in out) if t)


def test_pages_against_a_slow_reading(spark):
    rows = [r for sf in ("sf0.001", "sf0.01") for r in queries.table(spark, f"/root/testdata/{sf}", "pages").collect()]
    assert len(rows) > 250
    for r in rows:
        assert html_text.main_text(r["html"]) == slow_text(r["html"])


def test_very_long_and_deep_pages(spark):
    long = "<body><nav>menu</nav><article>" + "".join(f"<p>paragraph {i} of very many words" + " word" * 200 for i in range(20_000)) + "</article></body>"
    text = html_text.main_text(long)
    assert len(long) > 20_000_000 and text.count("\n\n") == 19_999 and "menu" not in text
    deep = "<article>" + "<div><b><i>" * 60_000 + "deep" + "</i></b></div>" * 60_000 + "<p>after</article>"
    assert html_text.main_text(deep) == "deep\n\nafter"
    assert html_text.main_text("<b>" * 200_000 + "<p>x</p>" * 20 + "</u>" * 200_000) == "\n\n".join("x" * 20)


def test_page_names():
    yes = ["sidebar", "site-footer", "post-comments", "sidebar-left", "col-4 adBanner", "ad-728x90", "navMenu2", "widget clearfix", "ad-slot", "footer-wrapper"]
    no = ["content-sidebar-wrap", "has-sidebar", "post has-comments", "comments-open", "post ad", "page-with-menu", "adapt", ""]
    assert [x for x in yes + no if html_text.names_boilerplate(x, html_text.HINTS)] == yes


def test_pages(spark):
    rows = [(i, f"http://x/{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == (want, len(want))
    assert got[None] == ("t", 1)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_bytes, box_bytes", [(1 << 20, 1 << 20), (2000, 1 << 20), (2000, 0)])
def test_topk_against_brute_force(spark, monkeypatch, shard_bytes, box_bytes):
    monkeypatch.setattr(topk, "MOST_BOX_BYTES", box_bytes)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in rng.normal(size=6).astype(np.float32)], i % 3) for i in range(300)]
    rows += [(300 + i, [0.5] * 6, 0) for i in range(40)]  # ties
    bad = [(900, None, 0), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (951, [float("nan")] * 6, 0), (952, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (1000, [1.0, 2.0], 0)]
    df = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_bytes=shard_bytes).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.floor(np.asarray(v, np.float32).astype(float) * 256).astype(int) for i, v, _ in rows}
    want = {}
    for q in (i for i in x if i % 50 == 0):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1000])
def test_topk_repeated_winners(spark, shard_bytes):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(size=4).astype(np.float32)]) for i in range(120)]
    rows += [(7, [float(a), float(b), float(a), float(b)]) for a in (4, -4) for b in (4, -4) for _ in range(3)]  # wins for every query, more than k times
    rows += [(8, [float(v) for v in rng.normal(size=4).astype(np.float32)]) for _ in range(9)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0, 5, shard_bytes=shard_bytes).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = [(i, np.floor(np.asarray(v, np.float32).astype(float) * 256).astype(int)) for i, v in rows]
    want = {}
    for q, v in x:
        if q % 50 == 0:
            score = {}
            for i, w in x:
                if i != q:
                    score[i] = max(score.get(i, -(2**63)), int(v @ w))
            best = sorted((-s, i) for i, s in score.items())[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_topk_skips_shards_by_their_boxes(spark):
    """Clusters far apart: queries go to few of the shards, and the result is that of brute force."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(16, 8)) * 40
    rows = [(i, [float(v) for v in centers[i % 16] + rng.normal(size=8)]) for i in range(800)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a third of all rows are one vector
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x, shards = topk._sharded(df, F.col("vec_id") % 50 == 0, 256.0, 4000)
    sizes = [r["count"] for r in x.groupBy(*topk.SHARD).count().collect()]
    assert len(sizes) == shards > 16 and max(sizes) <= 120
    v = np.floor(np.array([w for _, w in rows]) * 256).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_bytes=4000).collect())
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want += [(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert got == sorted(want)


def test_topk_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pipeline_against_stages(spark):
    import corpus_pipeline
    from chunkyard.llm import exact_dedup, mixing, near_dedup, toxicity

    sf = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    clean = [r for r in docs.collect() if model.score(r["text"]) < 0.7]
    first: dict = {}
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        first.setdefault((r["text"] or "").encode().lower(), r)
    sets = {}
    for r in first.values():
        s = near_dedup.shingles((r["text"] or "").encode())
        sets[r["doc_id"]] = set(s.tolist())
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    kept = spark.createDataFrame([r for r in first.values() if find(r["doc_id"]) == r["doc_id"]], docs.schema)
    want = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in queries.packed(mixing.mixed_documents(kept)).collect())
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()) == want
    assert exact_dedup.drop_copies(kept).count() == kept.count()


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Repeated ids, nulls, very long texts, repeated rows, clashing extra columns, no rows at all: every stage keeps what it should."""
    import corpus_pipeline

    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, b, long = say(70), say(70), say(30_000)
    data = [(1, b, "s0"), (5, b, "s0"), (5, a, "s1"), (9, long, "s1"), (9, long, "s1"), (None, say(50), None), (3, None, "s0"), (4, "", None), (6, a + " tail", "s1")]
    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["kept", "component", "node", "copy", "key", "_cy_id", "sketch", "features"]
    docs.select("*", *(F.lit("x").alias(n) for n in names)).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0), (5, None), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = queries.table(spark, sf, "documents")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == now.columns
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        held[name] = sorted((r["doc_id"] or -1, (r["text"] or "")[:20]) for r in now.collect())
    every = sorted((i or -1, (t or "")[:20]) for i, t, _ in data)
    assert held["toxicity"] == every
    assert held["exact_dedup"] == sorted([(1, b[:20]), (5, a[:20]), (9, long[:20]), (3, ""), (6, a[:20]), next(x for x in every if x[0] == -1)])
    assert held["near_dedup"] == sorted(x for x in held["exact_dedup"] if x[0] != 6)
    assert set(held["mixing"]) <= set(held["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in packed}) == len(packed) >= len(held["mixing"])
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
