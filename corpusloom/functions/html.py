"""HTML in one pass, a hundred pages at a time: title, h1, links, Markdown. The parser is the standard library's.

Tags that are never closed nest until their parent ends; script and style are raw text. Three extractors: raw (the main
container as Markdown), readability (the densest block as Markdown: least link text, most plain text) and trafilatura (the
densest block's paragraphs as plain text). auto takes the first that isn't empty."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "noscript", "head"}
BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "header", "footer", "nav", "aside", "ul", "ol", "li", "table", "tr", "pre", "blockquote", "figure", "form", "dl", "dt", "dd", *[f"h{i}" for i in range(1, 7)]}

RESULT = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("h1", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("markdown", T.StringType()), T.StructField("extractor", T.StringType())]
)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def all(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack += reversed(node.children)

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.all() if n.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


#: Ampersands that begin no character reference with a semicolon at its end.
UNENDED = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def parse(html: str, unended: bool = True) -> Node:
    """unended: whether references without their semicolon are decoded too, as HTML has it; else they stay as they stand."""
    builder = _Builder()
    builder.feed(html if unended else UNENDED.sub("&amp;", html))
    builder.close()
    return builder.root


def title_of(root: Node) -> str | None:
    """Text of the first title if it holds just that; else null."""
    node = root.first("title")
    return node.children[0].strip() if node and len(node.children) == 1 and isinstance(node.children[0], str) else None


def h1_of(root: Node) -> str | None:
    """Text nodes of the first h1, each trimmed, joined with nothing between."""
    node = root.first("h1")
    return ("".join(s.strip() for s in node.strings()) or None) if node else None


def links_of(root: Node) -> list[str]:
    """href of each a, in order, but for empty ones, fragments, mailto: and javascript:."""
    hrefs = (n.attrs.get("href", "").strip() for n in root.all() if n.tag == "a")
    return [h for h in hrefs if h and not h.lower().startswith(("#", "mailto:", "javascript:"))]


def container_of(root: Node) -> Node:
    return root.first("main") or root.first("article") or root.first("body") or root


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in SILENT:
        return ""
    inner = "".join(map(_inline, node.children))
    text = inner.strip()
    match node.tag:
        case "br":
            return "  \n"
        case "strong" | "b":
            return f"**{text}**" if text else ""
        case "em" | "i":
            return f"*{text}*" if text else ""
        case "code":
            return f"`{text}`" if text else ""
        case "a":
            return f"[{text}]({node.attrs['href']})" if text and node.attrs.get("href") else inner
        case "img":
            return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    return inner


def _rows(table: Node) -> list[str]:
    rows = [[re.sub(r"\s+", " ", "".join(map(_inline, c.children))).strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in table.all() if r.tag == "tr"]
    rows = [r for r in rows if r]
    lines = [f"| {' | '.join(r)} |" for r in rows]
    return [*lines[:1], "|" + " --- |" * len(rows[0]), *lines[1:]] if rows else []


def _blocks(node: Node, depth: int = 0) -> Iterator[str]:
    """Markdown blocks of a node's children."""
    run: list[str] = []

    def flush() -> Iterator[str]:
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"  \n", "\x00", "".join(run))).replace("\x00", "  \n").strip()
        run.clear()
        if text:
            yield text

    for child in node.children:
        if isinstance(child, str) or (child.tag not in BLOCKS and child.tag not in ("hr",) and not any(n.tag in BLOCKS for n in child.all())):
            run.append(_inline(child))
            continue
        yield from flush()
        if child.tag in SILENT:
            continue
        if re.fullmatch(r"h[1-6]", child.tag):
            if text := re.sub(r"\s+", " ", "".join(map(_inline, child.children))).strip():
                yield "#" * int(child.tag[1]) + " " + text
        elif child.tag == "hr":
            yield "---"
        elif child.tag == "pre":
            yield "```\n" + "".join(child.strings()).strip("\n") + "\n```"
        elif child.tag == "blockquote":
            inner = "\n\n".join(_blocks(child, depth))
            if inner:
                yield "\n".join(f"> {line}".rstrip() for line in inner.split("\n"))
        elif child.tag in ("ul", "ol"):
            items = [i for i in child.children if isinstance(i, Node) and i.tag == "li"]
            lines = []
            for k, item in enumerate(items, 1):
                mark = f"{k}. " if child.tag == "ol" else "- "
                inner = "\n".join(_blocks(item, depth + 1))
                lines.append(mark + inner.replace("\n", "\n" + " " * len(mark)))
            if lines:
                yield "\n".join(lines)
        elif child.tag == "table":
            if rows := _rows(child):
                yield "\n".join(rows)
        else:
            yield from _blocks(child, depth)
    yield from flush()


def to_markdown(node: Node) -> str:
    return "\n\n".join(_blocks(node))


def densest(root: Node) -> Node | None:
    """The block with the most text outside links and silent tags, by square-root damped length of its own paragraphs."""
    best, score = None, 0.0
    for node in root.all():
        if node.tag in ("article", "main", "section", "div", "td", "body"):
            own = [c for c in node.children if isinstance(c, str) or c.tag in ("p", "pre", "blockquote", "ul", "ol", "b", "i", "span")]
            text = sum(len(s.strip()) for c in own for s in ([c] if isinstance(c, str) else c.strings()))
            linked = sum(len(s.strip()) for c in own if isinstance(c, Node) for a in c.all() if a.tag == "a" for s in a.strings())
            if (value := (text - 2 * linked) ** 0.5 if text > 2 * linked else 0.0) > score:
                best, score = node, value
    return best


def convert(root: Node, extractor: str) -> tuple[str | None, str]:
    """(Markdown or None, the extractor that made it)."""

    def by(kind: str) -> str | None:
        try:
            if kind == "readability":
                node = densest(root)
                return to_markdown(node) if node else None
            if kind == "trafilatura":
                node = densest(root)
                return "\n".join(re.sub(r"\s+", " ", b) for b in _blocks(node)) if node else None
            return to_markdown(container_of(root))
        except RecursionError:  # deeper nesting than the interpreter can walk
            return None

    if extractor in ("readability", "trafilatura", "raw", "markdown"):
        return by(extractor), extractor
    for kind in ("readability", "trafilatura", "raw"):
        if text := by(kind):
            return text, kind
    return None, "raw"


def _of_pages(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """f as a UDF over pages, in Spark's small batches of pickled rows: an Arrow batch holds 10,000 pages and their Markdown at once, however long they are, and the parser
    outweighs what Arrow saves."""
    return F.udf(f, kind, useArrow=False)


def page_parts(html: Column, extractor: str = "auto", markdown: bool = True, unended: bool = True) -> Column:
    """struct of title, h1, links, markdown and extractor for each page, parsed once. unended: as in parse."""

    def of(page: str | None) -> tuple:
        root = parse(page or "", unended)
        text, kind = convert(root, extractor) if markdown else (None, extractor)
        return title_of(root), h1_of(root), links_of(root), text, kind

    # Not deterministic by name only: else a filter on what was made of a page is pushed below it, and each page is parsed twice.
    return _of_pages(of, RESULT).asNondeterministic()(html)


def register(spark: SparkSession) -> None:
    """Names for SQL: html_to_md(html), Markdown of the main container, and extract_links(html), hrefs in order."""
    spark.udf.register("html_to_md", _of_pages(lambda page: convert(parse(page or ""), "raw")[0], T.StringType()))
    spark.udf.register("extract_links", _of_pages(lambda page: links_of(parse(page or "")), T.ArrayType(T.StringType())))
