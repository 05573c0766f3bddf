"""The selector stage without Spark: element rules, text rules, and both tokenisers."""

from hypothesis import given, settings, strategies as st

from shelfwatch.operators import selectors as S
from shelfwatch.operators.selectors import Selector, read_page


def texts(html, tag="p", take="all", **more):
    return read_page(html, {"x": Selector(tag, take=take, **more)})["x"]


def test_text_is_stripped_per_string_and_joined_without_separator():
    assert texts("<h1> a <b> b </b>\n c</h1>", "h1", "first") == "abc"


def test_missing_element_is_null_and_empty_element_is_empty():
    assert texts("<div></div>", "h1", "first") is None
    assert texts("<h1></h1>", "h1", "first") == ""
    assert texts("<div></div>", "p") is None


def test_script_style_comment_text_is_not_page_text():
    html = "<div>a<script>b</script><style>c</style><!-- d -->e<template>f</template></div>"
    assert texts(html, "div", "first") == "ae"


def test_comment_splits_a_string():
    assert texts("<h1>a <!-- x --> b</h1>", "h1", "first") == "ab"


def test_character_references():
    assert texts("<h1>a &amp; b&nbsp;</h1>", "h1", "first") == "a & b"


def test_end_tag_inside_script_is_text():
    assert texts("<p>a<script>var t='</p>';</script>b</p><p>c</p>") == ["ab", "c"]


def test_open_paragraph_holds_what_follows_up_to_its_parent_end():
    html = "<article><p><b>a<br><p>b</p><p>c</p></article><p>d</p>"
    assert texts(html) == ["abc", "b", "c", "d"]


def test_stray_end_tag_is_ignored():
    assert texts("<p>a</i>b</div>c</p>") == ["abc"]


def test_class_matches_exactly_but_not_by_spacing():
    html = '<div class=" a  b ">x</div>'
    assert texts(html, "div", "first", attr="class", value="a b") == "x"
    assert texts(html, "div", "first", attr="class", value="a") is None


def test_attribute_value_matches_exactly():
    html = '<a data-view-id="x ">no</a><a data-view-id="x">yes</a>'
    assert texts(html, "a", "first", attr="data-view-id", value="x") == "yes"


def test_pairs_use_the_next_sibling_of_the_same_tag():
    html = "<div><span>k</span><b>-</b><span>v<span>in</span></span></div><span>last</span>"
    assert texts(html, "span", "pairs") == [
        {"k": "k", "v": "vin"}, {"k": "vin", "v": None}, {"k": "in", "v": None}, {"k": "last", "v": None}]


def test_inside_reads_the_first_container_only():
    html = '<p>0</p><div class="d"><p>1</p><i><p>2</p></i></div><div class="d"><p>3</p></div>'
    assert texts(html, "p", inside=Selector("div", "class", "d")) == ["1", "2"]


def test_attribute_values():
    html = '<a class="product-item big" href="/a?x=1&amp;y=2">1</a><a href="/b">2</a><a class="product-item">3</a>'
    assert texts(html, "a", "attribute", name="href") == ["/a?x=1&y=2", "/b", None]
    assert texts(html, "a", "attribute", name="href", attr="class", token="product-item") == ["/a?x=1&y=2", None]


def test_unreadable_page_gives_nulls():
    assert texts(None) is None
    assert texts("") is None
    assert texts("<p>open <b>never closed") == ["opennever closed"]


SELECTORS = {
    "h": Selector("h1"), "p": Selector("p", take="all"), "s": Selector("span", take="pairs"),
    "a": Selector("a", take="attribute", name="href"), "b": Selector("div", "class", "x"),
    "in": Selector("p", take="all", inside=Selector("div", "class", "x")),
}

PIECES = st.sampled_from([
    "<p>", "</p>", "<b>", "</b>", "<br>", "<br/>", "<span>", "</span>", '<div class="x">', "</div>", "<div class=x>",
    "<h1 id='a'>", "</h1>", '<a href="/q?a=1&amp;b=2">', "<a href=/x>", "</a>", "text", " ", "a < b", "&amp;", "&bogus;",
    "&#65;", "<!-- c -->", "<!-- a -- b -->", "<!-->", "<!doctype html>", "<script>if (a<b) '</p>'</script>",
    "<style>p{}</style>", "<title>t &lt; u</title>", "<title><b>x</b></title>", "<textarea><p>x</textarea>", "<p", "<",
    ">", "</", "<p class='a' class=\"b\">", "<P>", "</P >", "<img src=x>", "<![CDATA[z]]>", "<?pi?>", "</1>", "\xa0",
    "<template>", "</template>", "<script>", "</script>", "<!--", "-->", "<noscript>n</noscript>", "<noscript><p>", "</noscript>", "<iframe>", "</iframe>", "<iframe></iframe>",
])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_quick_tokeniser_agrees_with_the_standard_one(html):
    def result(regular):
        try:
            reader = S._read(html, SELECTORS, regular)
        except Exception as error:
            return type(error)
        return reader.texts, {
            name: [reader.text(f) if isinstance(f, S._Span) else f for f in found]
            for name, found in reader.found.items()}

    assert result(True) == result(False)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_no_page_fails(html):
    assert set(read_page(html, SELECTORS)) == set(SELECTORS)
