import html
import re

from millrace.llm import htmlmain, queries
from tests.llm.conftest import bag


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body>{body}</body></html>"


def text(body):
    return htmlmain.main_text(htmlmain.blocks(page(body)))


def test_article_without_its_surroundings():
    assert text("<nav><a>Home</a></nav><div class=ad>Buy</div><article><h1>A &amp; B</h1><p>One\n two<br>three<p><b>Four</article><footer>x</footer>") == "A & B\n\nOne two three\n\nFour"
    assert text("<article><p>In</p><aside>Out</aside><div class='cookie-notice'>No</div><form>No<input></form><script>var t='<p>';</script><p>Too</p></article>") == "In\n\nToo"
    assert text("<main><p>a</p><section id=comments><p>reader</p></section><p>b<!-- c --> d</main>") == "a\n\nb d"
    assert text("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>") == "x\n\ny\n\n1\n\n2"
    assert text("<div class='page content'><p>in</p><div class=sidebar>s</div></div><p>out") == "in"
    assert text("<main><p>list</p><article><header class=post-header><h1>T</h1></header><p>a</article><article class=comment>c</article></main>") == "T\n\na"
    assert text("<article><p>cut off &am") == "cut off &am"
    assert text("<article><p>cut <b") == "cut"
    assert text("<article>a &lt;b&gt; &#233; &eacute;&nbsp;c</article>") == "a <b> é é c"


def test_whole_table(spark, sf_dir):
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op9_host_suffix_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        h = pages[r.page_id].html
        inner = h[h.index("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_suffix_array_decides_where_markup_does_not(spark):
    shared = "Read our daily letter and join the club today"
    rows = [(i, f"http://h.org/{i}", page(f"<div>{shared}</div><div>unique{i} words of page{i} stand here{i} alone{i} now{i}</div><div>All rights kept by the h house</div>")) for i in range(6)]
    rows += [(9, "http://other.org/", page(f"<div>{shared}</div>")), (10, "http://h.org/a", page("<article><p>All rights kept by the h house</p></article>"))]
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"unique{i} words of page{i} stand here{i} alone{i} now{i}" for i in range(6))
    assert got[9] == shared  # alone on its host
    assert got[10] == "All rights kept by the h house"  # an article keeps what others repeat


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://x/", ""), (2, "u", "<p>open text"), (2, "u", "<p>open text"), (3, "u", "<article>" + "<p>long</p>" * 20_000), (4, "u", "<<>>&;<!-- never closed")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    got = htmlmain.extract(df).collect()
    assert len(got) == 6 and {r.page_id: r.text for r in got}[2] == "open text"
    assert {r.page_id: r.n_chars for r in got}[3] == 20_000 * 6 - 2
    assert bag(htmlmain.extract(df.limit(0))) == []


def test_prose_that_shares_phrases_stays_whole(spark):
    one = "In the spring the river rose as a matter of fact and nobody could cross it for a week"
    two = "The council met on Monday and as a matter of fact and law it could not decide anything"
    line = "All rights kept by the h house"
    rows = [(k, f"http://h.org/{k}", page(f"<p>{t}</p><div>{line}</div>")) for k, t in enumerate((one, two))]
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: one, 1: two}


def test_runs_cover_what_a_sorted_suffix_array_does(spark):
    import random

    r = random.Random(2)
    phrases = [[r.choice("abcdefgh") for _ in range(r.randint(2, 12))] for _ in range(12)]
    texts = [[w for _ in range(8) for w in r.choice([*phrases, [f"u{i}x{r.random()}"]])] for i in range(6)]
    suffixes = sorted((t[k:], i, k) for i, t in enumerate(texts) for k in range(len(t)))
    want = {i: set() for i in range(6)}
    for n, (s, i, k) in enumerate(suffixes):
        for step in (-1, 1):  # the nearest suffix of another page on each side shares most
            m = n + step
            while 0 <= m < len(suffixes) and suffixes[m][1] == i:
                m += step
            if 0 <= m < len(suffixes):
                common = next((j for j, (x, y) in enumerate(zip(s, suffixes[m][0], strict=False)) if x != y), min(len(s), len(suffixes[m][0])))
                want[i] |= set(range(k, k + common)) if common >= htmlmain.RUN else set()
    df = spark.createDataFrame([(i, "http://h/", page(f"<p>{' '.join(t)}")) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {bytes(x.stream): {k + j for k in x.covered for j in range(htmlmain.RUN)} for x in htmlmain.repeated_runs(df).collect()}
    assert any(want.values()) and {i: got.get(htmlmain.stream_key("http://h/", [" ".join(t)]), set()) for i, t in enumerate(texts)} == want


def test_main_text_beside_articles_stays_unless_the_host_repeats_it(spark):
    line = "Subscribe to the letter of the h house"
    body = lambda k: f"<main><p>Main words of page {k} itself</p><article><p>Teaser {k}</p><p>more</p></article><p>{line}</p><p>Closing words of page {k} itself</p></main>"
    rows = [(k, f"http://h.org/{k}", page(body(k))) for k in range(3)] + [(3, "http://other.org/", page(body(3)))]
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda k, *between: "\n\n".join([f"Main words of page {k} itself", f"Teaser {k}", "more", *between, f"Closing words of page {k} itself"])
    assert got == {0: own(0), 1: own(1), 2: own(2), 3: own(3, line)}


def open_pages(n=40):
    """Pages without articles: a menu and a closing line of the host in plain divs, prose of their own between."""
    menu = "<div>Home</div><div>News</div><div>About</div><div>Jobs</div><div>Press</div><div>Contact us</div>"
    line = "<div>All rights kept by the h house</div>"
    own = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(n)]
    return own, [(k, f"http://h.org/{k}", page(f"{menu}<p>{t}</p>{line}")) for k, t in enumerate(own)]


def test_the_array_decides_pages_without_marked_parts(spark, monkeypatch):
    own, rows = open_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_repeated) for r in htmlmain.extract(df).collect()}
    assert got == {k: (t, 14) for k, t in enumerate(own)}
    joined = {r.page_id: (r.text, r.n_repeated) for r in htmlmain.extract(df, most=0).collect()}
    assert joined == got  # more runs than may be broadcast
    monkeypatch.setattr(htmlmain, "repeated_runs", lambda pages: pages.sparkSession.createDataFrame([], "stream binary, covered array<int>"))
    assert all("All rights" in r.text and "Home" in r.text for r in htmlmain.extract(df).collect())  # without the array the boilerplate stays


def test_the_array_finds_repeats_of_a_table(spark):
    rows = htmlmain.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert sum(r.n_repeated > 0 for r in rows) > 0.2 * len(rows)


def test_intervals_have_two_pages_and_their_longest_common_prefix(spark):
    ids = lambda s: htmlmain.token_ids(s).tobytes()[: 4 * htmlmain.PREFIX]
    rows = [(1, ids("a b c d e f g"), b"1", b"1"), (1, ids("a b c d e f h"), b"2", b"2"), (1, ids("a b c d e x y"), b"3", b"3"),
            (1, ids("p q r s t u v w"), b"4", b"5"), (2, ids("a b c d e f g"), b"6", b"6"), (2, ids("a b c d e f g h"), b"6", b"6")]
    got = htmlmain.intervals(spark.createDataFrame(rows, "host long, prefix binary, low binary, high binary")).collect()
    assert {(r.host, bytes(r.run), r.longest) for r in got} == {(1, ids("a b c d e f"), 6), (1, ids("p q r s t u"), 8)}


def test_a_long_open_page_and_deep_nesting(spark):
    words = " ".join(f"w{k}" for k in range(200_000))
    deep = "<div>" * 100_000 + "deep" + "</div>" * 100_000
    mixed = "<b>" * 50_000 + "<p>x</p>" * 50_000 + "</i>" * 50_000
    rows = [(1, "http://h/1", f"<p>{words}</p>"), (2, "http://h/2", deep), (3, "http://h/3", mixed), (4, "http://h/4", f"<p>{words} more</p>")]
    got = {r.page_id: r for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == words and got[1].n_repeated == 200_000  # page 4 has all of it, and nothing else is left: a mirror
    assert got[4].text == f"{words} more" and got[2].text == "deep" and got[3].n_chars == 3 * 50_000 - 2


def test_mirrored_pages_keep_their_text_once_each(spark):
    text = "The council met on Monday and could not decide whether the bridge would open in spring"
    menu = "<div>Home</div><div>News</div><div>Our jobs</div><div>Contact us</div>"
    rows = [(1, "http://h.org/a", page(f"{menu}<p>{text}</p>")), (2, "http://h.org/a?print", page(f"<p>{text}</p>")), (3, "http://h.org/b", page(menu)), (4, "http://h.org/c", page(menu))]
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: text, 2: text, 3: "", 4: ""}


def test_names_within_longer_names_ask_the_array(spark):
    own = lambda k: f"<section class='copyright-law'><p>Of copyright law {k} itself</p></section><div class=search-results><p>What a search {k} brought</p></div><div id='comments'>Nice {k}</div>"
    shared = "<div class='newsletter-box'><p>Get all the news of the h house by post</p></div>"
    rows = [(k, "http://h.org/", page(f"<article><p>Words {k}</p>{own(k)}{shared}</article>")) for k in range(3)]
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Words {k}\n\nOf copyright law {k} itself\n\nWhat a search {k} brought" for k in range(3)}
