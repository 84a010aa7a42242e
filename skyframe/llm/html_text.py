"""Visible text of HTML pages, laid out as a browser would: blocks, lists and aligned table cells.

A small tree builder closes elements whose end tags are implied, visibility rules drop what is not shown, and a renderer
walks the tree without recursion over plain elements, so deep nesting by unclosed tags is no danger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import blocks, bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title datalist iframe noembed noframes object audio video canvas svg math".split())
BLOCK = frozenset(("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul legend optgroup option").split())
#: Blocks with an empty line before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
#: A start tag ends these open elements, up to the nearest of the fences.
_PARAGRAPH_ENDS = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "option", "optgroup", "legend", "summary"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An end tag does not reach beyond these.
FENCES = frozenset("table td th caption".split())
#: Tables inside tables are laid out to this depth and are plain blocks below it.
TABLE_DEPTH = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_GAPS = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _close(stack: list[Node], tags: set[str] | frozenset[str], fences: set[str] | frozenset[str]) -> None:
    """End the outermost open element of ``tags`` that no fence hides, and all inside it."""
    at = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            at = i
        elif stack[i].tag in fences:
            break
    if at is not None:
        del stack[at:]


def parse(html: str) -> Node:
    root = Node("html")
    stack, pos = [root], 0
    while pos < len(html):
        m = _TOKEN.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag != "html" and any(n.tag == tag for n in stack[1:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in FENCES and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        if tag == "html":
            root.attrs |= attrs
            continue
        if tag in _PARAGRAPH_ENDS:
            _close(stack, {"p"}, FENCES | {"button", "object"})
        if tag in IMPLIED:
            _close(stack, *IMPLIED[tag])
        if tag not in ("meta", "link", "title", "style", "script", "base", "template", "noscript", "head") and stack[-1].tag == "head":
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            raw = html[pos : end.start() if end else len(html)]
            node.children.append(unescape(raw) if tag == "textarea" else raw)
            pos = end.end() if end else len(html)
            continue
        stack.append(node)
    return root


def shown(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs or _UNSEEN.search(node.attrs.get("style", "")):
        return False
    return node.tag != "dialog" or "open" in node.attrs


class Page:
    """Lines of text; runs of white space are one space, and empty lines between blocks are not doubled."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.marker: str | None = None

    def put(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *more = text.split("\n")
            self._word(first, True)
            for part in more:
                self.newline(force=True)
                self._word(part, True)
            return
        self._word(_GAPS.sub(" ", text), False)

    def _word(self, text: str, pre: bool) -> None:
        if not pre and (not self.line or self.line[-1][-1:] == " "):
            text = text.lstrip(" ")
        if text:
            if not self.line and self.gap:
                if self.lines:
                    self.lines += [""] * (self.gap - 1)
                self.gap = 0
            self.line.append(text)

    def newline(self, force: bool = False) -> None:
        if not self.line and not force:
            return
        prefix = "".join(self.indent)
        if self.marker is not None:
            prefix = prefix[: -len(self.marker)] + self.marker if self.marker else prefix
            self.marker = None
        self.lines.append((prefix + "".join(self.line)).rstrip())
        self.line = []

    def block(self, gap: int) -> None:
        self.newline()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def _rows(table: Node) -> tuple[list[Node], list[Node | str], list[list[Node]]]:
    """Captions, what is shown outside the cells, and the shown cells of each shown row."""
    captions, stray, rows, wrappers = [], [], [], _wrappers(table)
    todo: list[tuple[Iterator[Node | str], list[Node] | None]] = [(iter(table.children), None)]
    while todo:
        children, row = todo[-1]
        for child in children:
            if isinstance(child, str):
                stray.append(child)
            elif not shown(child):
                continue
            elif child.tag == "caption":
                captions.append(child)
            elif child.tag in ("td", "th"):
                if row is None:
                    rows.append([child])
                else:
                    row.append(child)
            elif child.tag == "tr":
                rows.append([])
                stray.append(" ")
                todo.append((iter(child.children), rows[-1]))
                break
            elif id(child) in wrappers:
                stray.append(" ")
                todo.append((iter(child.children), row))
                break
            else:
                stray.append(child)
        else:
            todo.pop()
    return captions, stray, rows


def _wrappers(table: Node) -> set[int]:
    """The elements between the table and its rows, cells and captions; each node is looked at once."""
    found: set[int] = set()
    path, todo = [table], [iter(table.children)]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str) or child.tag in ("table", "details"):
                continue
            if child.tag in ("tr", "td", "th", "caption"):
                for node in reversed(path):
                    if id(node) in found:
                        break
                    found.add(id(node))
            if child.tag not in ("td", "th", "caption"):
                path.append(child)
                todo.append(iter(child.children))
                break
        else:
            todo.pop()
            path.pop()
    return found


def _table(node: Node, depth: int) -> list[str]:
    captions, stray, rows = _rows(node)
    grid = [[render(cell, depth + 1).split("\n") for cell in row] for row in rows]
    width: list[int] = []
    for row in grid:
        for i, cell in enumerate(row):
            width += [0] * (i + 1 - len(width))
            width[i] = max(width[i], *map(len, cell))
    # what is no cell goes before the table, as browsers move it there
    before = render(Node("div", children=stray), depth + 1)
    lines = before.split("\n") if before.strip() else []
    lines += [line for c in captions for line in render(c, depth + 1).split("\n")]
    for row in grid:
        for k in range(max(map(len, row), default=0)):
            lines.append("  ".join((cell[k] if k < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row)).rstrip())
    return lines


def render(root: Node, depth: int = 0) -> str:
    """Text of a shown node's content."""
    page, pre = Page(), 0
    lists: list[int | None] = []
    todo: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(root.children)]
    while todo:
        node, done = todo.pop()
        if isinstance(node, str):
            page.put(node, pre > 0)
            continue
        tag = node.tag
        if done and tag in ("ul", "ol", "menu"):
            lists.pop()
        gap = 2 if tag in SPACED and not lists else 1
        if done:
            if tag == "pre":
                pre -= 1
            page.block(gap)
            if tag in ("li", "dd", "blockquote") and page.indent:
                page.indent.pop()
                page.marker = None
            continue
        if not shown(node):
            continue
        if tag == "br":
            page.newline(force=True)
            continue
        if tag in ("td", "th"):
            page.put(" ")
        if tag == "input":
            if node.attrs.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "image", "file", "password"):
                page.put(node.attrs.get("value", ""))
            continue
        if tag not in BLOCK:
            todo += [(c, False) for c in reversed(node.children)]
            continue
        page.block(gap)
        if tag == "table" and depth < TABLE_DEPTH:
            for line in _table(node, depth):
                page._word(line, True)
                page.newline(force=True)
            page.block(gap)
            continue
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "1")
            lists.append(int(start) if tag == "ol" and start.isdigit() else 1 if tag == "ol" else None)
        elif tag == "pre":
            pre += 1
        elif tag == "li":
            marker = "- "
            if lists and lists[-1] is not None:
                marker, lists[-1] = f"{lists[-1]}. ", lists[-1] + 1
            page.indent.append(" " * len(marker))
            page.marker = marker
        elif tag in ("dd", "blockquote"):
            page.indent.append("  ")
        todo.append((node, True))
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        todo += [(c, False) for c in reversed(children)]
    return page.text()


def visible_text(html: str) -> str:
    return render(parse(html))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "html"):
        texts = [visible_text(h) for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                                         names=["page_id", "text", "n_lines"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text and n_lines, one row per page.

    A null or empty page has the empty text.  Broken markup is read as far as it goes: an unclosed comment or script
    hides the rest of the page.  Repeated rows and null ids give a row each; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, text string, n_lines bigint")
