"""Text and titles of HTML documents: an exact reader (html.parser in Arrow batches) and regular-expression forms that stay in the JVM."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verso.functions.text import strip

#: Elements whose text is a paragraph, and those whose start ends an open p.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "blockquote"}
ENDS_P = BLOCKS | {"ul", "ol", "dl", "table", "pre", "form", "hr", "article", "section", "nav", "header", "footer", "main", "aside", "fieldset", "address"}
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
HIDDEN = {"script", "style"}


class _Reader(HTMLParser):
    """Stripped text nodes in order, and for each element of interest the stretch of them that it holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.found: list[list] = []  # tag, first text, end text
        self.open: list[tuple[str, int]] = []  # tag, place in found or -1

    def _shut(self, upto: int) -> None:
        while len(self.open) > upto:
            _, at = self.open.pop()
            if at >= 0:
                self.found[at][2] = len(self.texts)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ENDS_P:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self._shut(k)
                    break
                if self.open[k][0] in BLOCKS:
                    break
        if tag in VOID:
            return
        at = -1
        if tag in BLOCKS:
            at = len(self.found)
            self.found.append([tag, len(self.texts), None])
        self.open.append((tag, at))

    def handle_endtag(self, tag) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._shut(k)
                break

    def handle_data(self, data) -> None:
        text = data.strip()
        if text and not any(t in HIDDEN for t, _ in self.open):
            self.texts.append(text)

    def finish(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._shut(0)


def read_document(html: str) -> tuple[str, str | None]:
    """read_blocks() and read_title() of a document."""
    r = _Reader()
    r.finish(html)
    return _blocks(r), _title(r)


def read_blocks(html: str) -> str:
    """Paragraphs in the order of their starts; a block inside a block gives its text again, as part of both."""
    return read_document(html)[0]


def read_title(html: str) -> str | None:
    """Text of the first h1, else h2, else h3 that isn't empty and has under 200 characters."""
    return read_document(html)[1]


def _blocks(r: _Reader) -> str:
    return "\n\n".join(t for t in (" ".join(r.texts[a:b]) for _, a, b in r.found) if t)


def _title(r: _Reader) -> str | None:
    for tag in ("h1", "h2", "h3"):
        for found, a, b in r.found:
            if found == tag:
                text = "".join(r.texts[a:b])
                if text and len(text) < 200:
                    return text
                break
    return None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title")]))
def read_page(x: pd.Series) -> pd.DataFrame:
    """Text and title of a page, which is parsed once."""
    return pd.DataFrame([(None, None) if s is None else read_document(s) for s in x], columns=["text", "title"])


def _visible(html: Column) -> Column:
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, "")
    return html


def _plain(x: Column) -> Column:
    """Without tags and with the common entities read; white space as single blanks."""
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(x, r"\s+", " "))


def html_blocks(html: Column) -> Column:
    """Array of paragraphs, cut at block tags by regular expressions; nested blocks don't repeat text."""
    return _blocks_of(_visible(html))


def _blocks_of(visible: Column) -> Column:
    cut = F.regexp_replace(visible, r"(?i)</?(?:p|h[1-6]|div|blockquote)\b[^>]*>", "\x1e")
    return F.filter(F.transform(F.split(cut, "\x1e"), _plain), lambda s: s != "")


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _heading(visible: Column, level: int) -> Column:
    """Text of the first heading of a level, null if it is empty or has 200 characters or more."""
    found = _plain(F.regexp_extract(visible, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", 1))
    return _once(found, lambda f: F.when((f != "") & (F.length(f) < 200), f))


def _title_of(visible: Column) -> Column:
    return F.coalesce(*(_heading(visible, n) for n in (1, 2, 3)))


def heading_title(html: Column) -> Column:
    return _once(_visible(html), _title_of)


def page_parts(html: Column) -> Column:
    """Struct of text (paragraphs joined by an empty line) and title; a page is cleaned once."""
    return _once(_visible(html), lambda v: F.struct(F.array_join(_blocks_of(v), "\n\n").alias("text"), _title_of(v).alias("title")))
