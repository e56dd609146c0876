import re

from netloom.llm.html_text import Weights, best_region, extracted, main_text, trained

PAGES = "page_id long, url string, html string, text string"


def test_region_is_the_best_of_all():
    scores = [1.0, -3.0, 2.0, 2.0, -1.0, 3.0, -9.0, 4.0]
    best = max(((i, j) for i in range(8) for j in range(i, 9)), key=lambda p: (sum(scores[p[0] : p[1]]), -p[0]))
    assert best_region(scores) == best == (2, 6)
    assert best_region([-1.0]) == best_region([]) == (0, 0)


def test_everything_but_the_article_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site name</h2></header>
      <nav><ul><li><a href=x>Home page</a></ul></nav><div class="cookie-notice">We use cookies on this site</div>
      <article><h1>Head &amp; line</h1><p>First  paragraph,\n with <b>bold</b> words<br>and more &eacute;&#233;.
      <aside class=sidebar>Other stories to read</aside><div class="ad">Buy now</div><p>Second one<script>x="</p>"</script> ends.
      <form>Your mail <input> <button>Send</button></form></article>
      <section id="comments"><p>First reader says hello</p></section><footer>&copy; all</footer></body></html>"""
    assert extracted(page, Weights()) == "Head & line\nFirst paragraph, with bold words and more éé.\nSecond one ends."


def test_pages_without_marked_content():
    page = "<body><div class=menu><a>A</a><a>B</a></div><div id=x><p>" + "good words here " * 20 + "</p></div><div class=footer>End of it</div>"
    assert extracted(page, Weights()) == ("good words here " * 20).strip()


def test_edge_cases(spark):
    rows = [
        (1, "u", None, "x"), (2, None, "", None), (None, None, "<p>", None), (3, "u", "<<<>>> <p a='>'>t &bogus; &amp", ""),
        (4, "u", "<article>" + "<div>" * 3000 + "deep words " * 50_000, None), (4, "u", "<p>tie</p>", None), (4, "u", "<p>tie</p>", None),
        (5, "u", "<script>var x = '<p>never closed", None), (6, "u", "plain text\n alone", None), (7, "u", "<!-- <p>no</p> --><p>yes", None),
    ]
    got = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[5] == "" and by_id[6] == "plain text alone" and by_id[7] == "yes" and by_id[3].endswith("t &bogus; &")
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_given_pages_against_their_own_marks(spark):
    """The article of every page, cut out by its tags."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    expected = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL)[1]
        blocks = (html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))) for b in re.split(r"</?(?:p|h1)>", inside))
        expected[r.page_id] = "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
    got = {r.page_id: r.text for r in main_text(pages, trained(pages)).collect()}
    assert got == expected


def test_script_text_is_no_markup():
    article = "<article><p>Words of the article.</p></article>"
    for script in ("for(i=0;i<n;i++){}", "a<b&&c>d", "x='<!--'", "if(a<b){s=\"'\"}"):
        assert extracted(f"<head><script>{script}</SCRIPT ></head><body>{article}<script>f()</script>", Weights()) == "Words of the article."


def test_nested_and_inline_elements():
    page = "<article><p>One <svg><g><svg><text>no</text></svg><text>nor this</text></g></svg>two <math><mi>x</mi></math> <object><p>three</object> <canvas>four</canvas></article>"
    assert extracted(page, Weights()).split() == ["One", "two", "x", "three", "four"]


def _learned(pages):
    from collections import Counter

    from netloom.llm.html_text import counted, learned

    total = Counter()
    for page in pages:
        total += counted(page)
    return learned([(k, n, float(c if i else 0), float(0 if i else c)) for (k, n, i), c in total.items()])


def test_adverts_within_sampled_articles_stay_adverts():
    body = "<p>" + "good words here " * 10 + "</p>"
    page = f"<body><nav>Menu</nav><article>{body}<div class=ad>{'buy it now ' * 20}</div><aside>{'other stories ' * 20}</aside>{body}</article></body>"
    good = ("good words here " * 10).strip()
    assert extracted(page, _learned([page] * 50)) == f"{good}\n{good}"


def test_what_stands_around_the_marked_content_has_no_veto():
    menu = "<ul class=x>" + "<li>menu entry of many words" * 60 + "</ul>"
    article = "<article><p>" + "good words here " * 10 + "</p></article>"
    page = f"<html><body><div class='layout with-sidebar'>{menu}{article}<section class=comments>{'reader says ' * 200}</section></div></body></html>"
    good = ("good words here " * 10).strip()
    assert extracted(page, _learned([page] * 50)) == good
    for wrapper in ("layout with-sidebar", "sidebar"):
        assert extracted(f"<body><div class='{wrapper}'>{article}</div></body>", Weights()) == good
