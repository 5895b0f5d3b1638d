import re
import time

import pytest

from spanveil.llm.extract import _regions, extract_text, main_text
import numpy as np

BODY = " ".join(f"word{i}" for i in range(60))
MORE = " ".join(f"other{i}" for i in range(50))
TWO = f"<p>{BODY}.</p><p>{MORE}.</p>"
WANT = f"{BODY}. {MORE}."


def page(inside, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{inside}</body></html>"


MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
AROUND = [
    "<header><h2>Site of the day</h2><p>A slogan that is quite long, so that it alone would make a surge of text here.</p></header>",
    "<footer>&copy; 2020 Some company that likes to say a lot about itself, its rights and all of its terms of use.</footer>",
    "<aside><p>A sidebar with a long text of more than eighty-six characters, that is about something else.</p></aside>",
    "<div class='sidebar-right'><p>A sidebar with a long text of more than eighty-six characters, of something else.</p></div>",
    "<div id='cookie-notice'><p>We use cookies and many more than eighty-six characters to say that we use cookies.</p></div>",
    "<div class=\"ad\">Buy this now, it is a very good thing to buy and costs little. Buy this now, it is good to buy!</div>",
    "<form action='/s'><label>Search all of the site for words</label><input name=q><textarea>given text</textarea></form>",
    "<script>var t = '</p><p>not text, though it is long enough to make a surge of its own, were it read as such';</script>",
    "<style>p { margin: 0 } /* not text, though it is long enough to make a surge of its own, were it read as such */</style>",
    "<section class='comments'><h3>Comments</h3><div class='comment'><p>I have read all of this and I do not agree with "
    "any of it, as I have said many times before in this place, and will say it again.</p></div></section>",
    "<div id='disqus_thread'><p>I have read all of this and I do not agree with any of it, as I have said before.</p></div>",
    "<div hidden><p>Not shown, though it is long enough to make a surge of its own, were it read as text of the page.</p></div>",
    "<!-- <p>Not shown, though it is long enough to make a surge of its own, were it read as text of the page.</p> -->",
    "<div role='complementary'><p>Something else with more than eighty-six characters, that a reader does not want.</p></div>",
    "<noscript>Please turn on your scripts, without them nothing works here. Please turn on your scripts, we beg you.</noscript>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "{}", "<div><div>{}</div></div>"])
def test_article_without_its_surroundings(around, wrap):
    text = "<h1>A title</h1>" + TWO
    assert main_text(page(MENU + around + wrap.format(text))) == "A title " + WANT
    assert main_text(page(MENU + wrap.format(text) + around)) == "A title " + WANT
    inside = wrap.format(f"<h1>A title</h1><p>{BODY}.</p>{around if '<header' not in around else ''}<p>{MORE}.</p><p>So.</p>")
    assert main_text(page(MENU + inside)) == "A title " + WANT + " So."


def test_short_articles_and_short_paragraphs():
    assert main_text(page(MENU + "<article><h1>Hi</h1><p>Of.</p></article>" + AROUND[1])) == "Hi Of."
    assert main_text(page(MENU + "<article><p><a href='/'>Only a link</a></p></article>")) == "Only a link"
    assert main_text(page(MENU + f"<article><p>In.</p>{TWO}<p>Out.</p></article>" + AROUND[2])) == f"In. {WANT} Out."
    assert main_text(page(MENU + "<div><p>A few words alone.</p></div>")) == "A few words alone."


def test_blocks_and_references():
    source = "<article><p> a<b>b</b>c\n\t d&nbsp;e &amp;&lt;b&gt; &quot;x&quot; &#233;&#x1F600; &copy &am &unknown;</p><p>x<br>y</p><ul><li>1</li><li>2</li></ul></article>"
    assert main_text(source) == 'abc d e &<b> "x" é😀 © &am &unknown; x y 1 2'
    assert main_text("<table><tr><td>a</td><td>b</td></tr></table>") == "a b"
    assert main_text('<article><p title="a > b" data-x=\'<p>\'>one</p><p>1 < 2 and 3 > 2</p></article>') == "one 1 < 2 and 3 > 2"


def test_broken_markup():
    assert main_text(page(f"<article><p><b>{BODY}.<br><p>{MORE}.</article>")) == WANT
    assert main_text(f"<article>{TWO}</article><footer>&copy; some") == WANT
    assert main_text(f"<nav><a href=/>Home</a><article>{TWO}</article>") == WANT
    assert main_text(f"<nav><ul><li>Home<div>{TWO}</div>").endswith(WANT)
    assert main_text(f"<article>{TWO}<script>var x = '") == WANT
    assert main_text(f"<ARTICLE>{TWO}</ARTICLE><DIV CLASS=Ad>x</DIV>") == WANT
    assert main_text(f"</div></p></b><article>{TWO}</b></i></article></html></html>") == WANT
    assert main_text(f"<article>{TWO}<!-- never ends <p>x</p>") == WANT
    assert main_text(f"{TWO}<div class=\"never") == WANT
    assert main_text("just text") == "just text" and main_text("") == "" and main_text(None) == ""
    assert main_text("<html><body></body></html>") == "" and main_text("<") == "<" and main_text("<a") == ""


def test_names_that_only_mention():
    assert main_text(page(f"<div class='no-sidebar has-comments'>{TWO}</div>")) == WANT
    assert main_text(page(f"<div class='shadow header-content'>{TWO}</div>")) == WANT
    assert main_text(page(f"<div class='layout-sidebar'><article>{TWO}</article><div class=ads>x y z</div></div>")) == WANT
    assert main_text(page(f"<article><header><h1>Title</h1><p>by someone</p></header>{TWO}</article>")) == f"Title {WANT}"
    assert main_text(page(f"<article>{TWO}<article class='comment'><p>{MORE}</p></article></article>")) == WANT
    assert main_text(page(f"<main><h1>Title</h1><article>{TWO}</article><div><p>rest</p></div></main>")) == f"Title {WANT}"


def test_heaviest_region_wins():
    side = "<div><p>Short text on the side, with a bit over eighty-six characters so that it makes a surge.</p></div>"
    assert main_text(page(f"<div>{side}</div><div><hr></div><div></div><div><div>{TWO}</div></div>")) == WANT


def test_regions_by_sums():
    """Surge and dive as found by walking over the lines."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        w = np.concatenate([rng.integers(0, 120, 40) * (rng.random(40) < 0.4), np.zeros(3, int)])
        sums = [int(w[i : i + 3].sum()) for i in range(len(w))]
        least, found, begin = min(86, max(sums) / 2), [], None
        for i, s in enumerate(sums):
            if begin is None and s > least and w[i] > 0:
                begin = i
            if begin is not None and s == 0:
                found.append((begin, i))
                begin = None
        assert _regions(w) == found


@pytest.mark.parametrize("bad", ["<a <", "<b>", "<p", "</i>", "<i><div><b></i>", '<a "', "<!-", "&amp", "<div class='ad'>", "<li><div>", "x<y ", "<a '\">"])
def test_long_bad_markup_takes_linear_time(bad):
    started = time.time()
    main_text(f"<article>{TWO}" + bad * 40_000)
    assert time.time() - started < 20


def test_long_page():
    text = " ".join(f"w{i}" for i in range(300_000))
    assert main_text(page(f"<article><p>{text}</p></article>")) == text


def test_table_of_pages(spark):
    rows = [
        (1, "u", page(f"<article>{TWO}</article>"), "clash", 5), (1, "u", page(f"<article>{TWO}</article>"), "clash", 5),
        (2, None, None, None, None), (None, "v", "", "x", 1), (3, "w", "<p>é😀</p>", "x", 1),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "é😀", 2)], key=str)
    assert extract_text(df.where("false")).collect() == []


def test_given_pages(spark, sf):
    """Plain version for the markup of the given pages."""
    import html as h

    table = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in table.collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [h.unescape(re.sub(r"</?b>", "", b)) for b in re.split(r"</?(?:h1|p|br)>", inside)]
        want[r.page_id] = " ".join(" ".join(blocks).split())
    assert {r.page_id: r.text for r in extract_text(table).collect()} == want
