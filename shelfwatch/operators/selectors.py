"""Raw text of page elements, one column per selector.

This is the only Python that touches rows: it tokenises a page and returns text. All typing
and cleaning happens later, in Column expressions. Pages of regular markup take a quick
tokeniser; the first irregularity hands the page to the standard library's.

Element tree rules are those of a lenient tree builder without implied end tags: an end tag
closes the nearest open element of its name and everything inside it, an end tag without an
open element is ignored, and elements left open run to the end of their parent.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

# Ship this module inside the task closure, so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN_TEXT_TAGS = frozenset("rp rt script style template".split())

PAIR_TYPE = StructType([StructField("k", StringType()), StructField("v", StringType())])


@dataclass(frozen=True)
class Selector:
    """Which elements to read and what to take from them.

    ``take`` is one of ``first`` (text of the first match), ``all`` (text of every match),
    ``pairs`` (text of every match with the text of its next sibling of the same tag) or
    ``attribute`` (the value of attribute ``name`` on every match).
    ``token`` matches any attribute value containing it, ``value`` only an equal one.
    ``inside`` limits the matches to descendants of the first element another selector finds.
    """

    tag: str
    attr: str | None = None
    value: str | None = None
    token: str | None = None
    take: str = "first"
    name: str | None = None
    inside: "Selector | None" = None

    def matches(self, attrs: Mapping[str, str]) -> bool:
        if self.attr is None:
            return True
        found = attrs.get(self.attr)
        if found is None:
            return False
        if self.token is not None:
            return self.token in found
        if self.value is None:
            return True
        # A class attribute is a list of words: spacing between them does not matter.
        return (" ".join(found.split()) if self.attr == "class" else found) == self.value

    def spark_type(self) -> DataType:
        if self.take == "first":
            return StringType()
        return ArrayType(PAIR_TYPE if self.take == "pairs" else StringType())


class _Span:
    """Text range of one element; ``following`` is its next sibling of the same tag."""

    __slots__ = ("start", "end", "following")

    def __init__(self, start):
        self.start = start
        self.end = None
        self.following = None


class _Reader:
    """Follows the open elements of a page and notes the text range of each wanted one."""

    def __init__(self, selectors):
        self.by_tag = {}
        self.containers = {}
        for name, selector in selectors.items():
            self.by_tag.setdefault(selector.tag, []).append((name, selector))
            if selector.inside is not None:
                self.containers.setdefault(selector.inside.tag, set()).add(selector.inside)
        self.container_spans = {}
        self.found = {name: [] for name in selectors}
        self.texts = []        # stripped, non-empty strings in document order
        self.pending = []      # pieces of the string being read
        self.stack = [("", (), {})]  # open elements: tag, spans to close, last pair span by name
        self.open_count = {}
        self.hidden = 0

    def data(self, text):
        self.pending.append(text)

    def flush(self):
        """Any markup ends the string being read."""
        if self.pending:
            text = "".join(self.pending).strip()
            self.pending.clear()
            if text and not self.hidden:
                self.texts.append(text)

    def start(self, tag, attrs, closed=False):
        """``attrs`` is a function: most elements need none."""
        if self.pending:
            self.flush()
        closing = ()
        if tag in self.by_tag or tag in self.containers:
            closing = self._match(tag, attrs())
        if tag in VOID_TAGS:
            for span in closing:
                span.end = len(self.texts)
            return
        self.stack.append((tag, closing, {}))
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in HIDDEN_TEXT_TAGS:
            self.hidden += 1
        if closed:
            self.end(tag)

    def _match(self, tag, attrs):
        here = len(self.texts)
        closing = []
        for name, selector in self.by_tag.get(tag, ()):
            if selector.take == "first" and self.found[name]:
                continue
            if selector.inside is not None:
                box = self.container_spans.get(selector.inside)
                if box is None or box.end is not None:
                    continue
            if not selector.matches(attrs):
                continue
            if selector.take == "attribute":
                self.found[name].append(attrs.get(selector.name))
                continue
            span = _Span(here)
            closing.append(span)
            self.found[name].append(span)
            if selector.take == "pairs":
                siblings = self.stack[-1][2]
                if name in siblings:
                    siblings[name].following = span
                siblings[name] = span
        for container in self.containers.get(tag, ()):
            if container not in self.container_spans and container.matches(attrs):
                span = _Span(here)
                closing.append(span)
                self.container_spans[container] = span
        return closing

    def end(self, tag):
        if self.pending:
            self.flush()
        if self.open_count.get(tag):
            while self._close_last() != tag:
                pass

    def _close_last(self):
        name, closing, _ = self.stack.pop()
        for span in closing:
            span.end = len(self.texts)
        self.open_count[name] -= 1
        if name in HIDDEN_TEXT_TAGS:
            self.hidden -= 1
        return name

    def finish(self):
        self.flush()
        while len(self.stack) > 1:
            self._close_last()

    def text(self, span):
        return None if span is None else "".join(self.texts[span.start:span.end])


class _Tolerant(HTMLParser):
    """The standard tokeniser, for pages with irregular markup."""

    def __init__(self, reader):
        super().__init__(convert_charrefs=True)
        self.reader = reader
        self.handle_data = reader.data
        self.handle_endtag = reader.end

    def updatepos(self, i, j):
        return j  # line numbers are not needed, and counting them costs time

    def handle_starttag(self, tag, attrs):
        self.reader.start(tag, lambda: {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.reader.start(tag, lambda: {k: v or "" for k, v in attrs}, closed=True)

    def handle_comment(self, data):
        self.reader.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.reader.flush()
        if data.upper().startswith("CDATA["):
            self.reader.data(data[6:])
            self.reader.flush()


# Regular markup: everything the quick tokeniser accepts, and nothing that needs recovery.
_GAP = r"[\t\n\r\f ]"
_NAME = r"[a-zA-Z][a-zA-Z0-9:_-]*"
_ATTRIBUTE_NAME = r"""[^\s"'<>/=]+"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]+)"""
_MARKUP = re.compile(
    rf"<(?:({_NAME})((?:{_GAP}+{_ATTRIBUTE_NAME}(?:{_GAP}*={_GAP}*{_VALUE})?)*){_GAP}*(/?)>"
    rf"|/({_NAME}){_GAP}*>"
    r"|!--(?!-?>)(?:[^-]|-(?!-))*-->"
    r"""|![dD][oO][cC][tT][yY][pP][eE][^<>"'\[\]]*>)""")
_ATTRIBUTES = re.compile(rf"{_GAP}+({_ATTRIBUTE_NAME})(?:{_GAP}*={_GAP}*({_VALUE}))?")
_RAW_TEXT = {tag: re.compile(f"<!--|</{tag}{_GAP}*>", re.IGNORECASE) for tag in ("script", "style")}
# Elements whose content tokenisers may treat as text: regular only when no markup is inside.
_TEXT_ONLY = frozenset("title textarea xmp iframe noembed noframes".split())


def _attributes(raw):
    values = {}
    for name, value in _ATTRIBUTES.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        values[name.lower()] = unescape(value) if "&" in value else value
    return values


def _read_regular(html, reader) -> bool:
    """Tokenise a page of regular markup; False as soon as something else turns up."""
    position = 0
    while True:
        opening = html.find("<", position)
        text = html[position:] if opening < 0 else html[position:opening]
        if text:
            reader.data(unescape(text) if "&" in text else text)
        if opening < 0:
            return True
        token = _MARKUP.match(html, opening)
        if token is None:
            return False
        position = token.end()
        tag, raw, slash, ending = token.groups()
        if tag is not None:
            tag = tag.lower()
            reader.start(tag, lambda: _attributes(raw), closed=bool(slash))
            if tag in _RAW_TEXT:
                stop = None if slash else _RAW_TEXT[tag].search(html, position)
                if stop is None or stop.group() == "<!--":
                    return False
                reader.data(html[position:stop.start()])
                position = stop.start()
            elif tag in _TEXT_ONLY:
                following = html.find("<", position)
                if slash or not html[following:following + 2 + len(tag)].lower() == f"</{tag}":
                    return False
            elif tag == "plaintext":
                return False
        elif ending is not None:
            reader.end(ending.lower())
        else:
            reader.flush()


def _read(html, selectors, regular=True):
    reader = _Reader(selectors)
    if not (regular and _read_regular(html, reader)):
        reader = _Reader(selectors)
        tokens = _Tolerant(reader)
        tokens.feed(html)
        tokens.close()
    reader.finish()
    return reader


def _attributes_only(selectors) -> bool:
    return all(s.take == "attribute" and s.inside is None for s in selectors.values())


def _read_attributes(html, selectors) -> dict[str, list] | None:
    """What ``_read_regular`` finds for selectors of attributes alone: they need no texts and no open elements, so the
    page is cut at its markup in one call. None as soon as it is not regular."""
    found = {name: [] for name in selectors}
    wanted = {selector.tag for selector in selectors.values()}
    parts = _MARKUP.split(html)  # a text, then tag, attributes, slash and ending of the markup behind it, and so on
    if any("<" in text for text in parts[::5]):
        return None
    for k in range(1, len(parts), 5):
        tag = parts[k]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in wanted:
            attrs = _attributes(parts[k + 1])
            for name, selector in selectors.items():
                if selector.tag == tag and selector.matches(attrs):
                    found[name].append(attrs.get(selector.name))
        if tag in _TEXT_ONLY:
            ending = parts[k + 8] if k + 8 < len(parts) else None
            if parts[k + 2] or not (ending or "").lower().startswith(tag):
                return None
        elif tag in _RAW_TEXT or tag == "plaintext":
            return None
    return found


def read_page(html: str | None, selectors: Mapping[str, Selector]) -> dict:
    """Raw texts of one page. A page that cannot be read gives NULL for every selector."""
    if html is not None and _attributes_only(selectors):
        links = _read_attributes(html, selectors)
        if links is not None:
            return {name: values or None for name, values in links.items()}
    try:
        reader = _read(html, selectors)
    except Exception:
        return {name: None for name in selectors}
    row = {}
    for name, selector in selectors.items():
        found = reader.found[name]
        if selector.take == "first":
            row[name] = reader.text(found[0]) if found else None
        elif selector.take == "all":
            row[name] = [reader.text(s) for s in found] or None
        elif selector.take == "pairs":
            row[name] = [
                {"k": reader.text(s), "v": reader.text(s.following)} for s in found
            ] or None
        else:
            row[name] = found or None
    return row


def _read_batches(selectors, html, keep, base, ready=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = {"first": pa.string(), "all": pa.list_(pa.string()), "attribute": pa.list_(pa.string()),
             "pairs": pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))}

    def read(batches):
        for batch in batches:
            at = None
            if ready is not None:
                at = np.flatnonzero(np.asarray(batch.column(html).is_valid()))
            some = batch if at is None else batch.take(pa.array(at))
            rows = [read_page(page, selectors) for page in some.column(html).to_pylist()]
            pages = None if base is None else some.column(base).to_pylist()
            out = {name: batch.column(name) for name in keep}
            for name, selector in selectors.items():
                values = [row[name] for row in rows]
                if pages is not None and selector.take == "attribute":
                    values = [_resolve(page, links) for page, links in zip(pages, values)]
                values = pa.array(values, types[selector.take])
                if at is not None:  # put in place among those that came ready
                    place = np.arange(batch.num_rows)
                    place[at] = np.arange(len(at)) + batch.num_rows
                    values = pa.concat_arrays([batch.column(ready).cast(values.type), values]).take(pa.array(place))
                out[name] = values
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return read


# Addresses that are joined by putting one behind the other, or whole already: nothing in them that urljoin would take
# out or rewrite. Counts are bounded, as the JVM's regular expressions, which take the same patterns, go deeper with each round.
SITE = r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,20}+(?::[0-9]+)?"
PLAIN_PATH = r"(?:/[A-Za-z0-9_~%-][A-Za-z0-9_.~%-]*+){1,30}+(?:\?[A-Za-z0-9_.~=&%-]+)?"
_SITE = re.compile(rf"({SITE})(?:/|\Z)")
_PLAIN_PATH, _PLAIN_URL = re.compile(PLAIN_PATH), re.compile(SITE + PLAIN_PATH)


def _resolve(page, links):
    if links is None or page is None:
        return links
    resolved = []
    site = _SITE.match(page)
    for link in links:
        if site and link and _PLAIN_PATH.fullmatch(link):
            resolved.append(site.group(1) + link)
            continue
        if site and link and _PLAIN_URL.fullmatch(link):
            resolved.append(link)
            continue
        try:
            resolved.append(urljoin(page, link) if link else link)
        except ValueError:  # a malformed address stays as written
            resolved.append(link)
    return resolved


def select_texts(
    df: DataFrame,
    selectors: Mapping[str, Selector],
    html: str = "html",
    keep: tuple[str, ...] = (),
    base: str | None = None,
    ready: str | None = None,
) -> DataFrame:
    """One raw column per selector, next to the ``keep`` columns.

    Only the page and the kept columns travel to Python. With ``base``, attribute values are
    resolved as links against that column. ``ready`` names a column with what the one selector finds in rows
    without a page, which is passed on.
    """
    sent = list(dict.fromkeys([*keep, html, *([base] if base else []), *([ready] if ready else [])]))
    fields = [df.schema[name] for name in keep]
    fields += [StructField(name, s.spark_type()) for name, s in selectors.items()]
    reader = _read_batches(dict(selectors), html, tuple(keep), base, ready)
    return df.select(*sent).mapInArrow(reader, StructType(fields))
