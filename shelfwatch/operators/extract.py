"""Pages to typed product rows: selector stage, then Column expressions.

The same functions serve a table and a stream.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.functions import text as T
from shelfwatch.functions.time import partition_date
from shelfwatch.operators.selectors import PLAIN_PATH, SITE, Selector, select_texts
from shelfwatch.schemas import CRAWL_ROW, conform

# Where the product page of the crawled shop keeps each field.
PRODUCT_SELECTORS = {
    "title": Selector("h1", "class", "sc-c0f8c612-0 dEurho"),
    "brand": Selector("a", "data-view-id", "pdp_details_view_brand"),
    "price": Selector("del"),
    "discount": Selector("div", "class", "product-price__discount-rate"),
    "sellPrice": Selector("div", "class", "product-price__current-price"),
    "sold": Selector("div", "class", "sc-1a46a934-3 geGARt"),
    "rating": Selector("div", "class", "sc-1a46a934-1 dCjKzJ"),
    "breadcrumbs": Selector("a", "class", "breadcrumb-item", take="all"),
    "details": Selector("span", take="pairs"),
    "paragraphs": Selector("p", take="all", inside=Selector("div", "class", "sc-f5219d7f-0 haxTPb")),
    "seller": Selector("span", "class", "seller-name"),
    "sellerRating": Selector("div", "class", "item review"),
}


@dataclass(frozen=True)
class DetailLabels:
    """Texts that mark a detail pair, in order of priority."""

    # The shop's labels.
    origin: str = "Xuất xứ thương hiệu"
    made_in: str = "Made in"
    warranty: str = "Sản phẩm có được bảo hành không?"


def category_of(tree: Column) -> Column:
    return F.try_element_at(tree, F.lit(-1))


def _last_value(pairs: Column, wanted) -> Column:
    return F.coalesce(F.try_element_at(F.filter(pairs, wanted), F.lit(-1))["v"], F.lit(""))


def classify_details(pairs: Column, labels: DetailLabels = DetailLabels()) -> dict[str, Column]:
    """Origin, made-in and warranty values plus the remaining pairs as labelled text.

    A pair belongs to the first label its key contains; the last pair of a label wins.
    """
    def is_origin(p):
        return T.contains(p["k"], labels.origin)

    def is_made_in(p):
        return ~is_origin(p) & T.contains(p["k"], labels.made_in)

    def is_warranty(p):
        return ~is_origin(p) & ~T.contains(p["k"], labels.made_in) & T.contains(p["k"], labels.warranty)

    def is_other(p):
        return ~(is_origin(p) | is_made_in(p) | is_warranty(p))

    other = F.transform(F.filter(pairs, is_other), lambda p: T.label(p["k"], p["v"]))
    return {
        "brandOrigin": _last_value(pairs, is_origin),
        "madeIn": _last_value(pairs, is_made_in),
        "warranty": _last_value(pairs, is_warranty),
        "additionalInfo": F.when(F.size(other) > 0, other),
    }


def description_of(paragraphs: Column) -> Column:
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")


def normalize(raw: DataFrame, labels: DetailLabels = DetailLabels()) -> DataFrame:
    """Raw selector texts of ``urlId`` to the crawl-row contract; absent selectors are missing text."""
    def c(name, dtype="string"):
        return F.col(name) if name in raw.columns else F.lit(None).cast(dtype)

    details = classify_details(c("details", "array<struct<k:string,v:string>>"), labels)
    tree = c("breadcrumbs", "array<string>")
    rows = raw.select(
        F.col("urlId"),
        c("title").alias("title"),
        c("brand").alias("brand"),
        T.money(c("price")).alias("price"),
        T.discount(c("discount")).alias("discount"),
        T.money(c("sellPrice")).alias("sellPrice"),
        T.last_token_int(c("sold")).alias("sold"),
        T.rating_value(c("rating")).alias("productRate"),
        T.rating_count(c("rating")).alias("productRateCount"),
        tree.alias("categoryTree"),
        category_of(tree).alias("category"),
        *[column.alias(name) for name, column in details.items()],
        description_of(c("paragraphs", "array<string>")).alias("description"),
        c("seller").alias("seller"),
        T.rating_value(c("sellerRating")).alias("sellerRate"),
        T.rating_count_text(c("sellerRating")).alias("sellerRateCount"),
        F.col("timestamp"),
    )
    return conform(rows, CRAWL_ROW)


def extract_products(
    messages: DataFrame,
    selectors: Mapping[str, Selector] = PRODUCT_SELECTORS,
    labels: DetailLabels = DetailLabels(),
) -> DataFrame:
    """``(urlId text, html, timestamp)`` to crawl rows.

    Rows without an integer id are dropped before the page is parsed; ``rejected_messages`` has them.
    """
    valid = messages.withColumn("urlId", T.safe_long(F.col("urlId"))).where(F.col("urlId").isNotNull())
    raw = select_texts(valid, selectors, html="html", keep=("urlId", "timestamp"))
    return normalize(raw, labels)


def rejected_messages(messages: DataFrame) -> DataFrame:
    """The messages that ``extract_products`` leaves out, as they came."""
    return messages.where(T.safe_long(F.col("urlId")).isNull())


def reject_reason(url_id: Column) -> Column:
    """Why a message has no place in the lake: ``no id``, or ``id is no whole number``; NULL for one that has."""
    return (F.when(F.coalesce(T.strip(url_id), F.lit("")) == "", "no id")
            .when(T.safe_long(url_id).isNull(), "id is no whole number"))


def to_lake_rows(rows: DataFrame, zone: str | None = None) -> DataFrame:
    """Add the partition date. ``zone`` must be the one the daily load counts its days in."""
    return rows.withColumn("date", partition_date(F.col("timestamp"), zone))


# A piece of the simplest markup: lower-case names, values in double quotes, no references, nothing whose content is not markup.
# A value that ends in "=" is left out, so that =" stands in front of values only.
_SIMPLE_MARKUP = (
    r"""<(?:!(?i:doctype)[^<>"'\[\]]*+|title>[^<]*+</title|/[a-z][a-z0-9]*+"""
    r"|(?!(?:script|style|plaintext|title|textarea|xmp|iframe|noembed|noframes)[ />])[a-z][a-z0-9]*+"
    r"""(?: [a-z-]++="[^"<>&]*+(?<!=)"){0,30}+ ?/?)>""")


def simple_hrefs(html: Column, class_token: str | None = None) -> Column:
    """The hrefs of a page that is simple markup throughout, empty ones left out; NULL for any other page."""
    if class_token is not None and '"' in class_token:
        return F.lit(None).cast("array<string>")
    # Of equal names the last counts, hence the atomic groups.
    wanted = "" if class_token is None else rf'(?=(?>[^>]* class=")[^"]*{re.escape(class_token)})'
    hrefs = F.regexp_extract_all(html, F.lit(rf'<a(?= ){wanted}(?>[^>]* href=")([^"]+)"'), F.lit(1))
    return F.when(F.instr(F.regexp_replace(html, _SIMPLE_MARKUP, ""), "<") == 0, hrefs)


def simple_links(pages: DataFrame, page: str, html: str, class_token: str | None, resolve: bool) -> DataFrame:
    """JVM path of ``extract_links``: the pages with ``_ready``, the links of a page that is simple markup throughout; NULL for
    any other page. With ``resolve``, links are made absolute, and one that is no plain address makes the page not simple."""
    read = pages.select(page, html, simple_hrefs(F.col(html), class_token).alias("_ready"))
    if not resolve:
        return read
    site = F.regexp_extract(F.col(page), rf"^({SITE})(?:/|\z)", 1)
    plain = F.forall("_ready", lambda h: h.rlike(rf"^(?:{SITE})?{PLAIN_PATH}\z"))
    absolute = F.transform("_ready", lambda h: F.when(h.startswith("/"), F.concat("_site", h)).otherwise(h))
    read = read.select(page, html, "_ready", site.alias("_site"))
    return read.select(page, html, F.when(plain & (F.col("_site") != ""), absolute).alias("_ready"))


def extract_links(
    pages: DataFrame,
    page: str = "url",
    html: str = "html",
    class_token: str | None = "product-item",
    resolve: bool = True,
) -> DataFrame:
    """Link targets ``(page, href)`` of anchors whose class contains a token; empty ones skipped.

    ``class_token=None`` takes every anchor. ``resolve`` makes relative links absolute. Pages of the simplest markup are read
    by Column expressions; their text does not travel to Python.
    """
    anchor = (Selector("a", take="attribute", name="href") if class_token is None
              else Selector("a", "class", token=class_token, take="attribute", name="href"))
    read = simple_links(pages, page, html, class_token, resolve)
    left = read.select(page, F.when(F.col("_ready").isNull(), F.col(html)).alias("_html"), "_ready")
    raw = select_texts(left, {"hrefs": anchor}, html="_html", keep=(page,), base=page if resolve else None, ready="_ready")
    links = raw.select(F.col(page).alias("page"), F.explode("hrefs").alias("href"))
    return links.where(F.col("href") != "")


def _visible(html: Column) -> Column:
    """``html`` without what a reader skips: comments, scripts, styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")


def _flat_text(text: Column) -> Column:
    return T.strip(T.unescape_basic(text))


def flat_tag_text(html: Column, tag: str) -> Column:
    """JVM fast path: text of the first ``<tag>`` that holds no other markup; NULL when absent.

    Comments, scripts and styles are passed over. Of the character references, only the basic ones
    are resolved.
    """
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}\s*>"
    html = _visible(html)
    return F.when(html.rlike(pattern), _flat_text(F.regexp_extract(html, pattern, 1)))


def flat_tag_texts(html: Column, tag: str) -> Column:
    """JVM fast path: text of every ``<tag>`` that holds no other markup."""
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}\s*>"
    return F.transform(F.regexp_extract_all(_visible(html), F.lit(pattern), F.lit(1)), _flat_text)


def flat_links(html: Column, class_token: str | None = None) -> Column:
    """JVM fast path: the href values of anchor tags, in page order, as written.

    With a token, anchors count whose class attribute contains it.
    """
    tags = F.regexp_extract_all(_visible(html), F.lit(r"(?i)(<a\s[^>]*>)"), F.lit(1))
    if class_token is not None:
        classes = r'\sclass="([^"]*)"'
        tags = F.filter(tags, lambda t: F.contains(F.regexp_extract(t, classes, 1), F.lit(class_token)))
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r'\shref="([^"]*)"', 1))
    return F.filter(hrefs, lambda h: h != "")
