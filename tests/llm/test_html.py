import math
import random
import time

from lodestone.llm import html

PAGE = """<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{{margin:0}}</style>
<script>var t="</p>";track(0);</script></head><body><header>Site</header><nav><ul><li><a href="/a">menu</a><li>two</ul></nav><!-- ad <p>x</p> -->
<div class="ad">buy</div><article><h1>{0} &amp;</h1><p><b>one&nbsp; <i>tw</i>o<br><p>three
  four &lt;b&gt; &#233; &am</p><form><p>mail</p></form><aside>side</aside><section id="comments"><p>first!</p></section>
<table><tr><td>c1<td>c2</table></article><div class="sidebarBox">s</div><footer>&copy; host</footer></body></html>"""


def test_template_and_broken_markup():
    got = [b.text for b in html.candidates(PAGE.format("Head"))]
    assert got == ["Head &", "one two", "three four <b> é &am", "c1", "c2"]
    for broken in ["", "<", "<p", "a<b", "</p></div>x", "<p>a<p>b</span>", "<!-- x", "<script>x", "<div class='a>b'>t</div>", "<p title=\"a", "x" * 200000 + "<p>" * 3000]:
        html.candidates(broken)
    assert [b.text for b in html.candidates("<p>a<p>b</span> c")] == ["a", "b c"]


def test_pages_of_a_site_without_an_article_element(spark):
    rng = random.Random(1)
    say = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20))
    pages, want = [], {}
    for i in range(12):
        body = [say() for _ in range(1 + i % 3)]
        want[i] = "\n\n".join(body)
        page = "<html><body><div class='x1'><div>Welcome to the site</div><div>All rights</div></div><div class='x2'>" + "".join(f"<p>{b}</p>" for b in body) + "</div></body></html>"
        pages.append((i, f"http://h.example/{i}", page, i))
    pages += [(100, "http://alone.example/", "<p>Only page</p>", 0), (101, None, None, 0), (102, "not a url", "", 0), (100, "http://alone.example/", "<p>Only page</p>", 0), (None, "http://h.example/z", "<p>z</p>", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(df).collect()]
    assert len(got) == len(pages) and all(n == len(t) for _, t, n in got)
    found = {i: t for i, t, _ in got}
    assert {i: found[i] for i in want} == want
    assert found[100] == "Only page" and found[101] == "" and found[102] == "" and found[None] == "z"
    assert html.extract(df.limit(0)).count() == 0


def site_style_tree(pages):
    """The extraction of (row, host, html) by plain loops over whole trees: dicts of pages, no sums reduced ahead."""
    parsed = {row: html.parse(h) for row, _, h in pages}
    hosts = {}
    for row, host, _ in pages:
        hosts.setdefault(host, []).append(row)
    out = {}
    for host, rows in hosts.items():
        one = {}
        for row in rows:
            blocks, nodes = parsed[row]
            said = tuple(b.text for b, _, _ in html.judged(blocks))
            shape = (sorted((n, tuple(c)) for n, (c, _) in nodes.items()), sorted({(b.node, b.text) for b in blocks}))
            if said not in one or repr(shape) < one[said][0]:
                one[said] = (repr(shape), row)
        kept = [row for _, row in one.values()]
        pages_of, layouts, texts, above = {}, {}, {}, {}
        for row in kept:
            blocks, nodes = parsed[row]
            for n, (children, up) in nodes.items():
                pages_of.setdefault(n, set()).add(row)
                layouts.setdefault(n, {}).setdefault(tuple(children), set()).add(row)
                above[n] = up
            for b in blocks:
                texts.setdefault(b.node, {}).setdefault(b.text, set()).add(row)
        importance = {}
        for n, who in pages_of.items():
            m = len(who)
            looks = -sum(len(x) / m * math.log(len(x) / m, m) for x in layouts[n].values()) if m > 1 else 1.0
            leaves = [(1 - math.log(len(x), len(pages_of[d])) if len(pages_of[d]) > 1 else 1.0) for d, own in texts.items() if n in above[d] for x in own.values()]
            if leaves and m >= html.LEAST:
                importance[n] = (1 - html.GAMMA) * looks + html.GAMMA * sum(leaves) / len(leaves)
        for row in rows:
            left, follows = [], False
            for b, prior, marked in reversed(html.judged(parsed[row][0])):
                given = prior
                if b.node in importance:
                    prior = importance[b.node] + html.RAISE * marked >= html.CUT
                    prior = prior and len(texts.get(b.node, {}).get(b.text, ())) < html.ALL * len(pages_of[b.node])
                if not b.lead:
                    follows = prior
                if prior or (b.lead and given and follows):
                    left.insert(0, b.text)
            out[row] = "\n\n".join(left)
    return out


def test_whole_sites_against_plain_loops(spark):
    rng = random.Random(5)
    say = lambda n=9: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    low, pages = [say() for _ in range(4)], []
    for i in range(90):
        host = ["a.example", "b.example", "c.example", None][rng.choice([0, 0, 0, 1, 1, 2, 3])]
        parts = [f"<div class='k{rng.randint(0, 3)}'>{rng.choice(['', '<h2>Part</h2>', '<h3>Other</h3>'])}<p>{rng.choice([say(), rng.choice(low)])}</p>{'<b>x</b>' * rng.randint(0, 1)}</div>" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), f"<article><p>{say()}</p><div>{rng.choice(low)}</div></article>")
        pages.append((i if i % 9 else None, host and f"https://{host}/{i}", "<html><body>" + "".join(parts) + "</body></html>"))
    pages += pages[:12] + [(7, None, None), (7, "https://a.example/z", ""), (2**60 + 1, "https://a.example/y", "<p>y</p>")]
    want = site_style_tree([(k, (u or "").split("/")[2] if u else "", h or "") for k, (_, u, h) in enumerate(pages)])
    got = [(r.page_id or -1, r.url or "", r.text) for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()]
    assert sorted(got) == sorted((i or -1, u or "", want[k]) for k, (i, u, _) in enumerate(pages))
    plain = ["\n\n".join(b.text for b in html.candidates(h or "")) for _, _, h in pages]
    assert sum(want[k] != plain[k] for k in range(len(pages))) > 20  # the tree decides on these pages


def test_what_markup_declares():
    of = lambda x: [b.text for b in html.candidates(x)]
    assert of("<article><p title=don't>Hello</p><p>World</p><p>It isn't all</p></article>") == ["Hello", "World", "It isn't all"]
    assert of("<article><p>a<button>Subscribe now</button> b<span class='ad'>BUY <span>x</span> now</span> c</p><p>d</p></article>") == ["a b c", "d"]
    assert of("<article><p>a<span class=ad>open<p>b</article>") == ["a", "b"]
    assert of("<article><div class='related-work'><p>Real</p></div><div class='related-posts'>x</div><div class='cookieBanner ad-300x250'>y</div></article>") == ["Real"]
    assert of("<main><p>one</p></main><div id='content'><p>two</p></div><div>rest</div>") == ["one", "two"]
    assert of("<div id='content'><article><p>one</p></article><div>rest</div></div>") == ["one"]
    assert of("<article><p>E = <math><mi>m</mi><mi>c</mi></math> and <svg><title>t</title><text>s</text></svg></p></article>") == ["E = mc and s"]
    assert of("<p class=x id='a\"b' title = \"x>y\" data-k='>'>t</p>") == ["t"]


def test_deep_and_very_long_pages_take_linear_time():
    for page in ("<div>" * 20000 + "x", "".join(f"<div>t{i}" for i in range(20000)), "<p>" * 20000 + "x", "<ul><li>" * 10000 + "x", "<td>" * 20000, "<b class=ad>" * 20000 + "x", "</div>" * 20000, "<div><p>" * 10000 + "</p>" * 10000, "<a href='" * 20000):
        began = time.process_time()
        blocks, nodes = html.parse(page)
        assert time.process_time() - began < 2 and len(nodes) <= 2 * html.DEEP + 2
    assert [b.text for b in html.parse("".join(f"<div>t{i}" for i in range(2000)))[0]] == [f"t{i}" for i in range(2000)]


def test_importance_follows_the_formula(spark):
    rows = [(i, "h", 7, 0, i % 2, [7]) for i in range(4)] + [(i, "h", 7, 1, 9, None) for i in range(4)] + [(0, "h", 7, 1, 10, None)]
    got = html.importances(html.counted(spark.createDataFrame(rows, "page_id long, host string, node long, kind int, value long, above array<long>"))).collect()[0]
    looks = -2 * 0.5 * math.log(0.5, 4)
    assert abs(got.importance - (0.2 * looks + 0.8 * (0 + 1) / 2)) < 1e-9 and got.pages == 4


def test_the_tree_decides_inside_and_outside_marked_parts(spark):
    rng = random.Random(2)
    say = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20))
    pages, want = [], {}
    for i in range(8):
        a, b = say(), say()
        want[i] = f"{a}\n\n{b}"
        pages.append((i, "http://posts.example/", f"<html><body><article><p>{a}</p><div class='end'><p>Read more of this site</p></div><p>{b}</p><p>More next week</p></article><div class='low'>All rights</div></body></html>"))
        want[100 + i] = a
        cards = "<article><p>Our best offer</p></article><article><p>Our second offer</p></article>"
        pages.append((100 + i, "http://cards.example/", f"<html><body><div class='text'><p>{a}</p></div>{cards}</body></html>"))
        want[200 + i] = a  # hosts of fewer pages than the tree needs
        pages.append((200 + i, f"http://few{i // 3}.example/", f"<html><body><article><p>{a}</p></article><div>All rights</div></body></html>"))
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_headings_that_lead_kept_text_stay(spark):
    rng = random.Random(6)
    say = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(12))
    pages, want = [], {}
    for i in range(8):
        a, b, c = say(), say(), say()
        want[i] = "\n\n".join([a, "Ingredients", b, "Method", c])
        promo = "<div class='box'><h3>From our kitchen</h3><p>Buy the book of all our recipes</p></div>"
        pages.append((i, "http://recipes.example/", f"<html><body><article><h1>{a}</h1><h2>Ingredients</h2><p>{b}</p><h2>Method</h2><p>{c}</p>{promo}</article></body></html>"))
        want[100 + i] = "\n\n".join(["Serves", a, "Time", b])
        pages.append((100 + i, "http://tables.example/", f"<main><dl><dt>Serves</dt><dd>{a}</dd><dt>Time</dt><dd>{b}</dd></dl></main><div class='end'><h2>Sister sites</h2><p>One and two</p></div>"))
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def generated_site(rng, host, pages):
    """(html, blocks to keep, blocks to drop) of the pages of one site whose markup names nothing: random class names, own boilerplate."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    name = {k: "z" + word() for k in ("top", "text", "low", "box", "end", "row")}
    links, legal, offers = [say(2) for _ in range(8)], [say(9) for _ in range(2)], [say(6) for _ in range(3)]
    heads = [say(1).title() for _ in range(3)]
    for _ in range(pages):
        keep, drop, body = [], [*links[:5], *legal], []
        for k in range(rng.randint(2, 7)):
            if rng.random() < 0.5:
                keep.append(heads[k % 3])
                body.append(f"<h2>{keep[-1]}</h2>")
            for _ in range(rng.randint(1, 3)):
                keep.append(say(rng.randint(8, 60)))
                body.append(f"<p>{keep[-1]}</p>")
        promo = rng.choice(offers)
        drop.append(promo)
        body.insert(rng.choice([k + 1 for k, x in enumerate(body) if x.startswith("<p")]), f"<div class='{name['box']}'><span>{promo}</span></div>")
        top = "".join(f"<div class='{name['row']}'>{x}</div>" for x in links[:5])
        page = f"<html><body><div class='{name['top']}'>{top}</div><div class='{name['text']}'>{''.join(body)}</div><div class='{name['low']}'>{''.join(f'<p>{x}</p>' for x in legal)}</div></body></html>"
        yield f"http://{host}/", page, keep, drop


def test_recall_and_precision_on_generated_sites(spark):
    """Hundreds of pages of sites that declare nothing, so all is up to the tree: what it keeps and drops, block by block."""
    rng = random.Random(9)
    made = [x for k, n in enumerate((150, 120, 60, 40, 30, 20)) for x in generated_site(rng, f"s{k}.example", n)]
    df = spark.createDataFrame([(i, url, page) for i, (url, page, _, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html.extract(df).collect()}
    kept = sum(b in got[i] for i, (_, _, keep, _) in enumerate(made) for b in keep)
    left = sum(b in got[i] for i, (_, _, _, drop) in enumerate(made) for b in drop)
    right = sum(b in keep for i, (_, _, keep, _) in enumerate(made) for b in got[i])
    recall, precision = kept / sum(len(x[2]) for x in made), right / sum(map(len, got.values()))
    print(f"recall {recall:.4f} precision {precision:.4f} boilerplate left {left} of {sum(len(x[3]) for x in made)}")
    assert recall > 0.99 and precision > 0.97


def test_copies_of_a_page_are_no_evidence(spark):
    same = "<html><body><div id='post-123'><p>The only article</p><p>Its end</p></div></body></html>"
    pages = [(i, "http://copies.example/", same) for i in range(5)]
    pages += [(10 + i, "http://mixed.example/", same.replace("</body>", f"<div class='ad'>buy {i}</div></body>")) for i in range(5)]
    pages += [(20 + i, "http://mixed.example/", f"<html><body><div class='t'><p>Text {i}</p></div><div class='low'>All rights</div></body></html>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "The only article\n\nIts end" for i in [*range(5), *range(10, 15)]} | {20 + i: f"Text {i}" for i in range(6)}
