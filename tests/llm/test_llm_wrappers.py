"""Wrapper inference and extraction on pages whose main text is known."""

import random

import pytest

from logsift.llm import markup, wrappers

SITES = {
    # body of a page around {title} and {text}; the text is in p elements.
    "article": """<header><h1>Site</h1></header><nav><a href=/a>A</a></nav><main><aside>Latest: {noise}</aside>
        <article class="post has-sidebar"><header><h1>{title}</h1></header>{text}<div class="share-buttons">Share {noise}</div>
        <footer>Tags {noise}</footer><section id="comments"><h2>2 Comments</h2><article class="comment"><p>{noise}</p></article></section>
        </article></main><footer>&copy; {noise}</footer>""",
    "main": """<div id=top class=navbar><ul><li><a>Home</a><li><a>{noise}</a></ul></div>
        <div role=main><h1>{title}</h1>{text}<form><label>Mail</label><input value=x><button>Subscribe {noise}</button></form></div>
        <div class="cookie-notice">We use cookies, {noise}</div>""",
    "content": """<div class="wrap no-sidebar"><div class="site-header">Site {noise}</div>
        <div id="content"><h1>{title}</h1>{text}</div><div class="sideBar">Popular {noise}</div>
        <div class="adBox2">Buy {noise}</div><div id="disqus_thread">{noise} said</div></div>""",
    "classless": """<table><tr><td><ul><li><a href=/1>{noise}</a></li><li><a href=/2>Two</a></li></ul><p>Our motto never changes</p></td>
        <td><h1>{title}</h1><div>{text}</div></td></tr></table><p>All rights reserved for ever and ever</p>
        <style>p{{}}</style><script>document.write("<p>{noise}</p>")</script>""",
    "one form": """<form id=page><div class=menu>{noise}</div><h1>{title}</h1><div class=x>{text}</div>
        <input type=hidden name=state value="{noise}"><div hidden>{noise}</div><div style="display: none">{noise}</div></form>""",
    "comments by heading": """<h1>{title}</h1><div class=x1>{text}</div><div class=x2><h3>Kommentare (3)</h3><ul><li>{noise}<li>{noise}</ul></div>""",
    "around": """<div class="modal-open promo"><article><h1>{title}</h1>{text}</article></div>""",
}


def pages_of(layout, n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    sentence = lambda k: " ".join(word() for _ in range(k))
    out = []
    for _ in range(n):
        title, blocks = sentence(4), [sentence(rng.randint(20, 60)) for _ in range(rng.randint(2, 7))]
        shown = [b.replace(" a", " <b>a</b>", 1).replace(" ", "\n  ", 1) for b in blocks]
        text = "".join(rng.choice(["<p>{}", "<p>{}</p>", "<p class=c>{}</p>"]).format(b) for b in shown)
        body = layout.format(title=title, text=text, noise=sentence(3))
        out.append((f"<!doctype html><html><head><title>{title}</title></head><body class=nav-open>{body}", "\n".join([title, *blocks])))
    return out


@pytest.mark.parametrize("name", SITES)
@pytest.mark.parametrize("count", [30, 5])
def test_sites(name, count):
    pages = pages_of(SITES[name], count)
    read = wrappers.extractor([p for p, _ in pages])
    for page, text in pages:
        assert read(page) == text


@pytest.mark.parametrize("name", ["article", "main", "content", "around"])
def test_one_page(name):
    [(page, text)] = pages_of(SITES[name], 1)
    assert wrappers.extractor([page])(page) == text


def of(body):
    return wrappers.extractor([body])(body)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<article>a<br>b<p>c&nbsp;&amp;&lt;d&gt; &eacute;&#233;&#xe9;&unknown; &amp</article>", "a b\nc &<d> ééé&unknown; &"),
        ("<article><p>one<p>two <b>bold<p>three</article><p>after", "one\ntwo bold\nthree"),
        ("<article>a <!-- x > y --> b<!-->c<!--->d<!-- no end", "a bcd"),
        ("<article>x < y and a<3 & b</article>", "x < y and a<3 & b"),
        ("<article><p title='a>b' data-x=\"</article>\">in</p></article>out", "in"),
        ("<article><script>var a = '</p></article>';</script>s<SCRIPT>x</script >t</article>", "st"),
        ("<article><ul><li>1<li>2<ul><li>3</ul><li>4</ul><dl><dt>t<dd>d</dl></article>", "1\n2\n3\n4\nt\nd"),
        ("<article><table><tr><td>a<td>b<tr><th>c</table></article>", "a\nb\nc"),
        ("<article><h1>T</h1>text <span>in</span>line<hr>next</article", "T\ntext inline\nnext"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>it's <a title=it's>fine</a></p></article>", "it's fine"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article></article><div class=ad>buy</div>", ""),
        ("<nav>a</nav><footer>b</footer>", ""),
        ("<article>a</b></i></div>b</article>", "ab"),
        ("<article><template>t</template><noscript>n</noscript><svg><title>x</title></svg><select><option>o</select>v</article>", "v"),
        ("<article><pre>  a\n\tb </pre><x-y>c</x-y>d<![CDATA[no]]></article>", "a b\ncd"),
        ("<main><h1>T</h1><p>a</p></main><article class=comment>no</article>", "T\na"),
    ],
)
def test_details(page, text):
    assert of(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<article>" + "<i>" * 2000 + "in" + "<p>out"
    assert of(deep) == "in\nout"
    long = "<article>" + "<p>word</p>" * 30000 + "</article>"
    assert of(long) == "\n".join(["word"] * 30000)
    classes = "<article>" + "".join(f"<p class={a}{b}x>t{a}{b}</p>" for a in "abcdefghij" for b in "abcdefghijklmnopqrstuvwxyz" * 20) + "</article>"
    assert of(classes).count("\n") == 10 * 26 * 20 - 1
    assert of('<a ="' * 3000) is not None


def test_expression():
    pages = ["<h1>a</h1><p>x<p>y", "<h1>a</h1><h2>s</h2><p>z<ul><li>1<li>2</ul>", "<h1>a</h1><p>x<h2>t</h2><p>v"]
    held = wrappers._Held()
    for page in pages:
        held.take(wrappers.wrapper_of(markup.parse(page), 2), 2)
    assert wrappers.expression(held.wrapper) == "<h1>=</> (<p>#</>? <h2>#</>?)+ <ul><li>#</>+</>?"


def _shape(w):
    return (w.tag, w.role, w.pages, w.chars, w.links, w.same, sorted((k, _shape(v)) for k, v in w.kids.items()))


def test_alignment_does_not_depend_on_order():
    rng = random.Random(5)
    pages = [p for name in SITES for p, _ in pages_of(SITES[name], 4, seed=1)]
    made = lambda some: [wrappers.wrapper_of(markup.parse(p), 2) for p in some]

    def joined(ws):
        while len(ws) > 1:
            at = rng.randrange(len(ws) - 1)
            ws[at : at + 2] = [wrappers.align(ws[at], ws[at + 1])]
        return ws[0]

    shapes = set()
    for _ in range(4):
        rng.shuffle(pages)
        whole = joined(made(pages))
        shapes.add(repr(_shape(whole)))
        again = wrappers.unpacked(wrappers.packed(whole))
        assert _shape(again) == _shape(whole) and again.model == whole.model
        rules = wrappers.rule_of(whole, 2)
    assert len(shapes) == 1 and rules


def _accepts(w, node, detail=2, level=0):
    """Whether an expression matches an element's content, by its segments."""
    keys, last = [], None
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                keys.append("#")
        else:
            key = wrappers._key(kid, detail)
            keys.append(key)
            if level + 1 < wrappers.DEPTH and not _accepts(w.kids[key], kid, detail, level + 1):
                return False
    at = 0
    for segment, repeated in w.model:
        taken = 0
        while at < len(keys) and keys[at] in segment and (repeated or not taken):
            at, taken, last = at + 1, taken + 1, keys[at]
    return at == len(keys)


def test_every_page_matches_its_wrapper():
    pages = [markup.parse(p) for name in SITES for p, _ in pages_of(SITES[name], 4, seed=2)]
    whole = wrappers.wrapper_of(pages[0], 2)
    for page in pages[1:]:
        whole = wrappers.align(whole, wrappers.wrapper_of(page, 2))
    assert all(_accepts(whole, page) for page in pages)


def test_job(spark, monkeypatch):
    rows, want = [], []
    for i, name in enumerate(SITES):
        for j, (page, text) in enumerate(pages_of(SITES[name], 12 if i else 80, seed=i)):
            row = (i * 1000 + j, f"https://User@WWW.{name.replace(' ', '')}.example:80/{j}?q#f", page)
            rows.append(row)
            want.append((row[0], row[1], text))
    rows += [rows[0], (None, None, "<article>x"), (7, None, None), (8, "no url", ""), (9, "", "<p>ä😀</p>")]
    want += [want[0], (None, None, "x"), (7, None, ""), (8, "no url", ""), (9, "", "ä😀")]
    key = lambda r: tuple((v is not None, v) if v is not None else (False,) for v in r)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, text int, host string")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(wrappers, "BROADCAST_BYTES", limit)
        got = wrappers.extract(table.repartition(5)).collect()
        assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    rules = {r["host"]: r for r in wrappers.infer(table.repartition(3)).collect()}
    assert rules["www.article.example"]["n_pages"] == 81
    assert len(rules) == len(SITES) + 1


def test_less_detail(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "NODES", 12)
    pages = pages_of(SITES["article"], 20)
    read = wrappers.extractor([p for p, _ in pages])
    assert all(read(p) == t for p, t in pages)


def test_empty(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
