import html
import re

from stratalog.llm import html_text as h
from stratalog.llm.common import table

from .util import SF


def plain(page):
    """For the one template of the test tables: the article between its tags, tags to breaks."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    body = re.sub(r"<[a-z/!][^>]*\Z", "", m[1]) if m else ""
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_template_pages(spark):
    pages = table(spark, SF.replace("0.001", "0.01"), "pages")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in h.extract_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


MIXED = """<html><head><title>T</title><style>a{}</style></head><body class="has-sidebar"><header>Top</header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>A &amp; B</h1></header><p>One&nbsp;two   three<br>four <b>bold</b><p>Second &lt;p&gt; &copy &#233;
<div class=ad-slot>Buy</div><aside>Aside</aside><form><label>Name</label><input name=x></form><script>var a = "</p>";</script><ul><li>i<li>j</ul><p hidden>gone</p>
<section id="comments"><article>reader</article></section></article></main><div id="sidebar">S</div><footer>F</footer></body></html>"""


def text_of(page):
    return [b[0] for b in h.blocks_of(page)]


def test_noise_branches():
    assert text_of(MIXED) == ["A & B", "One two three four bold", "Second <p> © é", "i", "j"]


def test_broken_markup():
    assert text_of("<p>a <b>b<p>c</b> 1 < 2 <i") == ["a b", "c 1 < 2"]
    assert text_of("<article><p>x<!-- never closed <p>y") == ["x"]
    assert text_of("plain") == ["plain"] and text_of("") == [] and text_of("<script>x") == []
    assert text_of('<p title="a > b">t</p><p class=\'x">q</p>')[0] == "t"
    assert text_of("<nav>menu<p>more</nav><p>body</p>") == ["body"]
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == ["deep"]
    assert len(text_of("<p>w</p>" * 20000)) == 20000


def test_names_that_hold_the_article():
    assert text_of('<div class="layout no-sidebar"><p>kept</p><div class="sidebar">S</div></div>') == ["kept"]
    assert text_of('<div class="sidebar-layout"><article><p>kept</p></article></div>') == ["kept"]
    assert text_of('<section id="comments"><article>reader</article></section><article>own</article>') == ["own"]


def test_site_style_tree(spark):
    """Without telling tags, what stands on every page of a host goes, and what differs stays."""
    page = lambda i, host: (i, f"https://{host}/p{i}", f'<body><div class="x1"><p>Home News</p></div><div class="x2"><p>Story {i} of {host}</p><p>More {i * i}</p></div><div class="x3"><span>Same end</span></div></body>')
    rows = [page(i, "a.example") for i in range(8)] + [page(i, "b.example") for i in range(20, 22)]
    rows += [(50, None, None), (51, "", ""), (51, "", ""), (None, "https://a.example/z", "<p>alone</p>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, low int")
    got = sorted(((str(r.page_id), r.text) for r in h.extract_text(df).collect()))
    want = [(str(i), f"Story {i} of a.example\nMore {i * i}") for i in range(8)]
    want += [(str(i), f"Home News\nStory {i} of b.example\nMore {i * i}\nSame end") for i in (20, 21)]
    want += [("50", ""), ("51", ""), ("51", ""), ("None", "alone")]
    assert got == sorted(want)
    assert h.extract_text(df.limit(0)).count() == 0


def test_copies_of_an_article_on_one_host_stay(spark):
    rows = [(i, "http://h/x?r=%d" % i, "<nav>n</nav><article><p>the same text</p></article>") for i in range(10)]
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"the same text"} and len(got) == 10


def extracted(spark, *pages):
    """Texts of pages (url, html), in order."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in h.extract_text(df).orderBy("page_id").collect()]


def test_site_style_tree_judges_articles(spark):
    notice = "Readers of this site get the printed edition for half of the price, every week of the year."
    page = lambda i: (f"http://h/{i}", f"<article><p>{notice}</p><p>Story {i}</p><p>{'old' if i % 2 else 'new'}</p></article>")
    assert extracted(spark, *[page(i) for i in range(8)]) == [f"Story {i}\n{'old' if i % 2 else 'new'}" for i in range(8)]
    assert extracted(spark, *[page(i) for i in range(3)])[0].startswith(notice)  # too few pages to tell


def test_teaser_article_beside_the_real_text(spark):
    real = "The real text of this page, which is far longer than the teaser."
    assert extracted(spark, ("http://h/1", f"<article>Read more</article><div>{real}</div>")) == ["Read more\n" + real]
    assert extracted(spark, ("http://h/1", f"<div>Read more</div><article>{real}</article>")) == [real]


def test_copies_outside_articles_stay(spark):
    same = "<div><p>One text</p><p>in two paragraphs</p></div>"
    assert extracted(spark, *[("http://h/1", same)] * 4) == ["One text\nin two paragraphs"] * 4
    assert extracted(spark, *[(None, same)] * 4) == ["One text\nin two paragraphs"] * 4
    two = [(f"http://h/{i}", f"<div><p>Article {i % 2}</p><p>has text {i % 2}</p></div>") for i in range(10)]
    assert extracted(spark, *two) == [f"Article {i % 2}\nhas text {i % 2}" for i in range(10)]


def test_no_page_is_emptied(spark):
    page = lambda i: (f"http://h/{i}", f"<div><p>Same head</p></div><span>{i}</span>" if i < 9 else "<div><p>Same head</p></div>")
    assert extracted(spark, *[page(i) for i in range(10)]) == [str(i) for i in range(9)] + ["Same head"]


def test_names_that_hold_most_of_the_page():
    assert text_of('<div class="layout sidebar-right"><article><p>kept</p></article></div><p>(c) 2024</p>') == ["kept", "(c) 2024"]
    assert text_of('<div class="layout sidebar-right"><main><p>kept</p></main></div><p>(c) 2024</p>')[0] == "kept"
    assert text_of('<div class="layout sidebar-right"><p>kept, as it is most of the page</p><div class="share">S</div></div><p>(c) 2024</p>') == ["kept, as it is most of the page", "(c) 2024"]
    assert text_of('<article>own</article><div class="comments"><p>readers wrote more than the author</p></div>') == ["own"]
    assert text_of('<article>own</article><div class="ad">far more text than that</div>') == ["own"]
    assert text_of('<article>teaser</article><div class="layout sidebar-right">far more text than that</div>') == ["teaser", "far more text than that"]
    assert text_of('<p>own text <span class="share">share it</span> goes on</p>') == ["own text goes on"]


def test_svg_without_an_end_tag():
    assert text_of('<p>one <svg class="i" /> two</p><p>three</p>') == ["one two", "three"]
    assert text_of('<p>one <svg/> two</p><svg><text>label</text></svg><p>three</p>') == ["one two", "three"]
    assert text_of("<p>one</p><svg><p>two</p>") == ["one", "two"]


def test_names_of_another_subject_within_the_text():
    page = "<article><p>one</p><div class='share-price'>core text</div><div class='notice-of-motion'>moved</div><p class='related work'>cited</p><div class='share-buttons'>S</div><div class='comments-of-readers'>R</div></article>"
    assert text_of(page) == ["one", "core text", "moved", "cited"]


def test_time_grows_with_the_page():
    import time

    def took(page, n):
        began = time.process_time()
        assert len(h._judged(h.blocks_of(page), {})) == n
        return time.process_time() - began

    n = 50_000
    assert took("".join(f"<p class='c{i}'>w{i}</p>" for i in range(n)), n) < 8
    assert took("<div class='ad x'>" * n + "deep" + "</div>" * n, 1) < 8
    assert took("".join(f"<div class='c{i}'>{i}" for i in range(n)), n) < 8
    assert took("<b>" * n + "x" + "</i>" * n, 1) < 8
    assert took("<p>a</p>" + "<svg>" * n, 1) < 8


def plain_tree(pages, min_pages=4, threshold=0.4, weight=0.7):
    """The site style tree in plain Python, over (host, blocks): texts of each page."""
    import math
    from collections import Counter, defaultdict

    hosts = defaultdict(dict)
    for host, blocks in pages:
        hosts[host][tuple((b[1] > 0, b[2], b[0]) for b in blocks)] = blocks
    low = defaultdict(set)
    for host, distinct in hosts.items():
        texts, looks, inside, on = defaultdict(Counter), defaultdict(Counter), set(), Counter()
        for blocks in distinct.values():
            seen = {}
            for text, kind, path, look in blocks:
                node = (kind > 0, path)
                seen[node] = min(look, seen.get(node, look))
            for node, look in seen.items():
                looks[node][look] += 1
                on[node] += 1
                if node[0]:
                    inside.add(node)
            for node, text in {((b[1] > 0, b[2]), b[0]) for b in blocks}:
                texts[node][text] += 1
        for node, m in on.items():
            if m < min_pages:
                continue
            entropy = 1.0 if node in inside else -sum(n / m * math.log(n / m, m) for n in looks[node].values())
            mean = sum(math.log(k) for k in texts[node].values()) / len(texts[node])
            if weight * (1 - mean / math.log(m)) + (1 - weight) * entropy < threshold - 1e-12:
                low[host].add(node)
            low[host] |= {(node, t) for t, k in texts[node].items() if k >= min_pages and 2 * k > m and weight * (1 - math.log(k, m)) + (1 - weight) < threshold - 1e-12}
    out = []
    for host, blocks in pages:
        fine = lambda b: (b[1] > 0, b[2]) not in low[host] and ((b[1] > 0, b[2]), b[0]) not in low[host]
        rescue = any(b[1] for b in blocks) and not any(b[1] and fine(b) for b in blocks)
        left = [b for b in blocks if fine(b) or rescue and b[1]] or blocks
        size = lambda k: sum(len(b[0]) for b in left if b[1] >= k)
        level = 2 if 2 * size(2) >= size(0) else 1 if 2 * size(1) >= size(0) else 0
        out.append("\n".join(b[0] for b in left if b[1] >= level))
    return out, sum(map(len, low.values()))


def test_style_tree_against_plain_python(spark):
    """On sites where tags tell nothing, some or all: the tree decides, and a plain one agrees."""
    import random

    rng = random.Random(6)
    menus = [[f"Menu {h} {k}" for k in range(rng.randint(2, 5))] for h in range(6)]
    pages = []
    for i in range(240):
        host = rng.randrange(6)
        menu = menus[host] if rng.random() < 0.9 else rng.sample(menus[host], 2)
        body = "".join(f"<p>{rng.choice(['Story', 'Note'])} {rng.randrange(400)}</p>" for _ in range(rng.randint(1, 4)))
        body += f"<p>Printed by {host}</p>" * (rng.random() < 0.8) + f"<p class=end>Part {rng.randrange(3)} of host {host}</p>"
        body = [body, f"<main>{body}</main>", f"<article>{body}</article>", f"<div class=a>{body}</div>"][host % 4 if rng.random() < 0.8 else 0]
        pages.append((f"http://h{host}/{i}", "<div class=m>" + "".join(f"<span><div>{t}</div></span>" for t in menu) + f"</div>{body}<div class=z>(c) h{host}</div>"))
    pages += pages[:20]
    want, n_low = plain_tree([(h.host_of(u), h.blocks_of(p)) for u, p in pages])
    assert n_low > 20 and extracted(spark, *pages) == want
    assert any(len(w) < len("\n".join(text_of(p))) for w, (_, p) in zip(want, pages))
