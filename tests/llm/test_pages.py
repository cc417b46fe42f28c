"""Main text of small pages of many layouts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import pages

WORDS = "Some running text, with commas, that is long enough to be an article's paragraph."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One<p>Two &amp; three&nbsp; &#x41;<br>x</p>", "One\nTwo & three A x"),
        ("<body><nav><a>Menu</a></nav><article><h1>T</h1><p>A <b>bold<br><p>B</article><footer>F</footer>", "T\nA bold\nB"),
        (f"<div class='main'><p>{WORDS}</p><div id=comments><p>{WORDS} No.</p></div></div>", WORDS),
        (f"<article><header><h1>T</h1><span>by me</span></header><p>{WORDS}</p><form>f<input></form><aside>s</aside><script>var t='</p>'</script><style>p{{}}</style><!-- c --><div class='ad-box'>buy</div></article>", f"T\n{WORDS}"),
        (f"<div class=sidebar><p>{WORDS}</p></div><div class=content><ul><li>a<li>b</ul><table><tr><td>{WORDS}</table></div>", f"a\nb\n{WORDS}"),
        ("<p>cut off <b", "cut off <b"),
        ("a < b & c > d", "a < b & c > d"),
        ("", ""),
        (None, ""),
        ("<script>x", ""),
        ("<div hidden>no</div><p style='display:none'>no</p><p>yes", "yes"),
        ("<div/>text<p/>more", "text\nmore"),
    ],
)
def test_main_text(html, want):
    assert pages.main_text(html, None)[0] == want


@pytest.mark.parametrize("name", ["id='page' class='has-sidebar'", "class='content-with-banner'", "class='post category-popular'", "class='entry tag-search'", "class='two-column sidebar-right'", "class='overflow-hidden'", "class='post comments-open'"])
def test_wrappers_with_hints(name):
    side = "<div class='sidebar'><p>Short, other text.</p></div>"
    html = f"<body><div class='top'>Site</div><div {name}><div class='story'><p>{WORDS}</p><p>{WORDS} More.</p></div>{side}</div></body>"
    for path in (None, pages.candidates(pages.parse(html), 1) and pages.path_of(pages.candidates(pages.parse(html), 1)[0][1])):
        assert pages.main_text(html, path)[0] == f"{WORDS}\n{WORDS} More."


def test_long_comments_and_many_widgets():
    html = f"<div class='story'><p>{WORDS}</p></div><div class='comments'>{f'<p>{WORDS} No.</p>' * 9}</div>"
    assert pages.main_text(html, None)[0] == WORDS
    html = f"<div class='page'>{''.join(f'<div class=widget><p>{WORDS} {k}</p></div>' for k in range(4))}</div>"
    assert pages.main_text(html, 'div.page')[0].count(WORDS) == 4


def test_paths_tell_all_classes_apart():
    html = f"<div class='row'><div class='col col-md-8 col-sm-12 story'><p>{WORDS}</p></div><div class='col col-md-4 col-sm-12 teaser'><p>{WORDS[:40]}</p></div></div>"
    best = pages.candidates(pages.parse(html), 1)[0][1]
    assert pages.path_of(best) == "div.row/div.col.col-md-#.col-sm-#.story"
    assert pages.main_text(html, pages.path_of(best))[0] == WORDS


def test_deep_and_broken():
    deep = "<div>" * 20000 + "x" + "</p></span>" * 10
    assert pages.main_text(deep, None)[0] == "x"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab =\"'&!-p;\n", max_size=60))
def test_never_crashes(html):
    text, _ = pages.main_text(html, "body/article")
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n"))


def test_consensus(spark):
    def page(k):
        return f"<body><div class='story s{k}'><p>{WORDS} {k}</p></div><div class='box'><p>{'Longer, talk, of, readers. ' * (40 if k == 3 else 0)}</p></div></body>"

    rows = [(k, f"http://Host.example:80/{k}", page(k)) for k in range(8)] + [(100, None, "<p>alone"), (101, "http://empty/", None), (102, "http://host.example/x", "<p>Another layout</p>"), (0, "http://host.example/0", page(0))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = pages.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(8):
        assert by[k].text == f"{WORDS} {k}" and by[k].path == "body/div.s#.story" and by[k].n_chars == len(by[k].text)
    assert by[100].text == "alone" and by[101].text == "" and by[101].n_chars == 0 and by[102].text == "Another layout"
    assert pages.extract(df.where("false")).count() == 0


LINKS = "<ul><li><a href=/a>First link</a></li><li><a href=/b>Second link</a></li></ul>"
LEGAL = "All rights are reserved by the publisher, its partners, and others, in every country. " * 12
#: Layouts of hosts: {t} is the title, {p} and {q} are the paragraphs of a page's article.
LAYOUTS = {
    "semantic": "<body><header><a href=/>Site</a></header><nav>{links}</nav><main><article><h1>{t}</h1><p>{p}</p><p>{q}</p></article></main><footer>(c) us</footer></body>",
    "has-sidebar": "<body><div class='layout has-sidebar'><div class='col'><h1>{t}</h1><p>{p}</p><p>{q}</p></div><div class='sidebar'>{links}<p>Latest news here.</p></div></div></body>",
    "no-sidebar": "<body><div id='page' class='site no-sidebar'><div id='masthead'>Site name</div><div class='entry-content'><h1>{t}</h1><p>{p}</p><p>{q}</p></div></div></body>",
    "related-wrapper": "<body><div class='topnav'>{links}</div><section class='related-case-study'><h1>{t}</h1><p>{p}</p><p>{q}</p></section><div class='bottom'><a href=/x>Terms of use</a></div></body>",
    "tables": "<body><table><tr><td class='menu'>{links}</td><td class='text'><h1>{t}</h1><p>{p}</p><p>{q}</p></td></tr></table></body>",
    "notices": "<body><div class='cookie-banner'><p>We use cookies, and more of them. Accept?</p></div><main><h1>{t}</h1><p>{p}</p><form class='newsletter'><label>Join</label><input></form><p>{q}</p></main></body>",
    "comments": "<body><div class='post'><h1>{t}</h1><p>{p}</p><p>{q}</p><ul class='share-links'><li>Share it</li></ul></div><section id='comments'><h3>2 comments</h3><div class='comment'><p>I disagree, with all of this, as a reader.</p></div></section></body>",
    "advert": "<body><div id='content'><h1>{t}</h1><p>{p}</p><div class='ad-slot'><p>Buy this, now, it is cheap.</p></div><script>track('<p>')</script><p>{q}</p></div></body>",
    "legal": "<body><div class='lead'><h1>{t}</h1><p>{p}</p><p>{q}</p></div><div class='rest'><p>{legal}</p></div></body>",
    "numbered": "<body class='p{k}'><div class='wrap'><div class='node-{k} story'><h1>{t}</h1><p>{p}</p><p>{q}</p></div><div class='node-list'>{links}</div></div></body>",
    "plain": "<body><h1>{t}</h1><p>{p}<p>{q}</body>",
    "header-inside": "<body><article class='entry'><header><h1>{t}</h1><span class='byline'>By someone, today</span></header><p>{p}</p><p>{q}</p><footer>Filed under: things</footer></article><aside>{links}</aside></body>",
}


def paragraph(k, n):
    return " ".join(f"Sentence {k} of {n}, which has its own words, number {i * 7 + k} and so on." for i in range(3 + k % 3))


def test_layouts(spark):
    rows, want = [], {}
    for host, layout in LAYOUTS.items():
        for k in range(6):
            t, p, q = f"Title {k}", paragraph(k, 1), paragraph(k, 2)
            html = layout
            for name, value in {"t": t, "p": p, "q": q, "k": str(k), "links": LINKS, "legal": LEGAL}.items():
                html = html.replace("{" + name + "}", value)
            rows.append((len(rows), f"http://{host}.example/{k}", html))
            want[len(rows) - 1] = (host, f"{t}\n{p}\n{q}")
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    wrong = {want[k][0]: got[k] for k in got if got[k] != want[k][1]}
    assert not wrong


def test_figures_stay():
    html = f"<body><article><h1>T</h1><p>{WORDS}</p><figure class='widget'><img><figcaption class='share-caption'>The caption.</figcaption></figure><p>{WORDS} More.</p></article></body>"
    assert pages.main_text(html, None)[0] == f"T\n{WORDS}\nThe caption.\n{WORDS} More."


def test_pages_that_are_copies(spark):
    html = f"<body><div class='a'><p>{WORDS}</p></div><div class='b'>{LINKS}</div></body>"
    got = pages.extract(spark.createDataFrame([(k, "http://same.example/", html) for k in range(5)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {WORDS}
