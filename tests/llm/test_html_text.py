from dataclasses import replace

from hypothesis import given, settings, strategies as st

from meshframes.llm import html_text as ht

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li>Menu</li></ul></nav><!-- x -->'
    '<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One\n two<br>three<p>Fou&#114; &lt;b&gt; &nbsp;x</p>'
    '<div id="comments"><p>First!</p></div><form><input>Send</form><p></p></article><aside>Side</aside><footer>&copy; me</footer></body></html>'
)


def text(html, near=()):
    return ht.main_text(ht.page_lines(html), [ht.page_lines(x) for x in near])


def test_marked_article():
    assert text(PAGE) == "Head & line\nOne two three\nFour <b> x"
    assert text(PAGE.replace("</body></html>", "")) == text(PAGE)
    assert text(PAGE, [PAGE.replace("Top", "Other")]) == text(PAGE)
    assert text("") == "" and text("plain &am text") == "plain &am text" and text("<p>a<p>b") == "a\nb"
    assert text("<main>x</main>y") == "x" and text("<div role=main>x</div>y") == "x"
    assert text("<head><title>t<body><p>x") in ("", "x")


def test_names_are_whole_words_and_drop_no_article():
    for mark in ("content-sidebar-wrap", "has-sidebar", "post social-science", "share-price", "related-work", "search", "page sidebar"):
        assert text(f'<div class="{mark}"><main>Story</main></div>') == "Story"
        assert text(f'<nav>Menu</nav><div id="{mark}"><article>Story</article></div>') == "Story"
    assert text('<div id="search-results"><p>One</p></div>') == "One"
    assert text('<p>Menu</p><form><div aria-hidden="true"><article>Story</article></div></form>') == "Story"
    assert text("<article>a <math><mi>x</mi></math> <label>b</label><dialog>c</dialog><form>Send<label>d</label></form></article>") == "a x b\nc"
    assert text('<p>Body</p><article class="comment">First!</article><article class="ad">Buy</article>') == "Body"
    assert text('<article>Story<div id="comments"><article>First!</article></div></article><div class="related"><article>More</article></div>') == "Story"
    assert text('<p>Body</p><div id="comments"><article>First!</article></div>') == "Body\nFirst!"
    assert text('<p>Body</p><template><article>No</article></template><div hidden><main>No</main></div>') == "Body"
    assert text('<p>a <span class="ad">Buy</span>b</p>') == "a b"


def test_hyphenated_names_of_boilerplate():
    inside = "comment-list comments-area cookie-banner ad-slot share-buttons related-posts site-footer newsletter-signup comments__list post-comments main-navigation login-form social-links wp-comment-form page_sidebar popup-overlay"
    for mark in inside.split():
        assert text(f'<article>Story<div class="x {mark}">No</div><section id="{mark}">No</section></article>') == "Story", mark
        assert text(f'<div class="{mark}"><main>Story</main></div>') == "Story", mark
        assert text(f'<div class="{mark}"><article>Story</article></div>') == "Story", mark
    for mark in "social-science share-price related-work search-results has-sidebar with-comments content-sidebar-wrap news-letter bad-slot commentary ad-hoc notice-of-change no-footer".split():
        assert text(f'<article>Story<div class="{mark}">Yes</div></article>') == "Story\nYes", mark


def test_shared_lines_of_unmarked_pages_go():
    a = "<div>Our site</div><div>Home | About</div><p>Story one.</p><p>Same words.</p><div>Terms</div>"
    b = "<div>Our site</div><div>Home | About</div><p>Story two.</p><div>Terms</div><p>Same words.</p>"
    assert text(a, [b]) in ("Story one.\nSame words.", "Story one.\nTerms")
    assert text(a, [a]) == "Our site\nHome | About\nStory one.\nSame words.\nTerms"
    assert text(a, [a, b]) == text(a, [b])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    got = sorted(ht.common_lines(a, b))
    assert len(got) == best[-1][-1]
    it = iter(b)
    assert all(any(a[i] == y for y in it) for i in got)


def test_nearest_pages_of_the_host_are_compared(spark):
    page = lambda i: f"<div>Menu {i // 10}</div><p>Text {i}</p>"
    rows = [(i, f"http://h{i % 2}.test/{i // 10}/{i:03d}", page(i)) for i in range(60)]
    rows += [(None, None, None), (61, "http://h0.test/x", ""), (62, "http://alone.test/", page(7)), (63, "nothing", page(8)), (63, "nothing", page(8)), (64, "http://h1.test/z", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as text", "1 as n_chars", "'own' as host", "'own' as path", "'x' as h")
    out = ht.extract(df, partitions=1)
    assert out.columns == ["page_id", "url", "host", "path", "h", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 66 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"Text {i}" for i in range(60))
    assert by[None] == "" and by[61] == "" and by[62] == "Menu 0\nText 7" and by[63] == "Menu 0\nText 8" and len(by[64]) == 999_999
    assert ht.extract(df.limit(0), partitions=2).count() == 0
    assert sorted(x.page_id for x in ht.extract(df.where("page_id < 60")).collect()) == list(range(60))


def test_copies_and_partition_borders_hide_no_neighbour(spark):
    menu = lambda i: f"<div>Menu</div><p>Text {i}</p>"
    rows = [(i, f"http://many.test/a/{i:03d}", menu(0)) for i in range(50)]  # a run of copies, its only neighbour far away
    rows += [(50, "http://many.test/a/x", "<!-- none -->"), (51, "http://many.test/b", menu(1))]
    rows += [(100 + i, f"http://two{i // 2:02d}.test/{i % 2}", menu(i)) for i in range(40)]
    rows += [(200 + i, f"http://only.test/{i:02d}", menu(2)) for i in range(20)]  # nothing differs
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for n in (1, 4, 37, 111):
        got = {r.page_id: r.text for r in ht.extract(df, partitions=n).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == "Text 0" for i in range(50)) and got[50] == "" and got[51] == "Text 1"
        assert all(got[100 + i] == f"Text {i}" for i in range(40))
        assert all(got[200 + i] == "Menu\nText 2" for i in range(20))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("gh"), st.sampled_from(["", "<p>m<p>a", "<p>m<p>b", "<p>m<p>c<p>a"])), max_size=14), st.lists(st.integers(0, 14), max_size=5))
def test_any_cut_gives_the_texts_of_a_plain_search(some, cuts):
    pages = [(h, f"/{i:02d}", x) for i, (h, x) in enumerate(sorted(some, key=lambda p: p[0]))]
    lines = [ht.page_lines(x) for *_, x in pages]
    want = []
    for i, (h, path, _) in enumerate(pages):
        sides = (range(i - 1, -1, -1), range(i + 1, len(pages)))
        near = [next((j for j in side if pages[j][0] == h and lines[j] and lines[j] != lines[i]), None) for side in sides]
        near = sorted((j for j in near if j is not None), key=lambda j: -ht._prefix(path, pages[j][1]))
        want.append(ht.main_text(lines[i], [lines[j] for j in near]))
    at = [0, *sorted(min(c, len(pages)) for c in cuts), len(pages)]
    parts = [pages[a:b] for a, b in zip(at, at[1:])]
    keys = {(h, path, 0): ht._keys(x) for (h, path, _), x in zip(pages, lines)}
    around = ht.runs_around([ht.border_runs((h, path, 0, ht.digest(keys[h, path, 0])) for h, path, _ in p) for p in parts])
    around = [[[replace(r, keys=keys[r.page]) for r in runs] for runs in sides] for sides in around]
    assert [t for p, (before, after) in zip(parts, around) for t in ht._differenced(p, before, after)] == want
