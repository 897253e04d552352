"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned tables.

A scanner cuts the page into tags, comments and text; a tree builder opens and closes elements with the
implied tags of HTML (``p`` ended by blocks, ``li``, ``dt``/``dd``, ``option``, table parts, cells without a row,
end tags of outer elements); invisible elements are dropped; what remains is rendered:

* white space runs become one blank, but inside ``pre``; ``br`` ends a line; blocks start lines, and paragraphs,
  headings, lists, quotes, ``pre`` and tables also have one blank line around them;
* items have ``- `` or their number, two blanks further in per level of nesting, and hanging continuation lines;
* the cells of a column are padded to one width, two blanks apart; ``colspan`` skips columns, ``rowspan`` keeps its
  columns free in the next rows of the row group; a cell with several lines takes several lines of the row.

Invisible: ``head`` and other elements without display, the ``hidden`` attribute, ``display: none`` and
``visibility: hidden`` in the ``style`` attribute (the last declaration counts), closed ``dialog``, comments. The
values of form controls (``textarea``, ``select``) are left out, too. Whatever else is written is kept, navigation included.

Cases: null and empty pages give an empty text; broken markup (open comments, quotes, tags) never fails: an
unfinished tag at the end is dropped. Nesting of any depth is handled without recursion. Repeated rows are
rendered one by one; keys may be null. An empty table gives no rows. Only key and page are read.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from clickloom.llm.cells import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript noframes noembed iframe datalist object audio video canvas svg math textarea select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table menu figure".split())
LINES = frozenset("address article aside body caption dd details dialog div dt fieldset figcaption footer form header hgroup hr html legend li main nav optgroup option search section summary".split())
ENDS_P = (SPACED | LINES) - frozenset("body html caption dd dt li option optgroup legend".split()) | {"hr"}
#: Start tag: (open elements that it ends, elements beyond which it does not look).
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    **{t: (("tr", "td", "th", "caption", "thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")},
    **{f"h{i}": (tuple(f"h{j}" for j in range(1, 7)), tuple(LINES)) for i in range(1, 7)},
}
#: A quote opens a value only right after the equals sign of an attribute.
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|--!>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*"|'[^']*'|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+)?+)?+)*+)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^ \t\n\r\f/][^ \t\n\r\f/=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f]*)))?""")
_REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARED = re.compile(r"""(?:[^;"'(]|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))++""")
_NUMBER = re.compile(r"[ \t\n\r\f]*(-?\d{1,9})")
_WHITE = re.compile(r"[ \t\n\r\f]+")


def attributes(raw: str) -> dict[str, str]:
    """Names, in lower case, and values of the attributes of a start tag; of equal names the first counts."""
    found = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def unshown(style: str) -> bool:
    """Whether a style says ``display: none`` or ``visibility: hidden``; later declarations replace earlier ones."""
    said = {}
    for part in _DECLARED.findall(_REMARK.sub("", style)):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip().lower(), value.lower().partition("!")
        if mark or not said.get(name, ("", ""))[1]:
            said[name] = (value.strip(), mark)
    return said.get("display", ("",))[0] == "none" or said.get("visibility", ("",))[0] == "hidden"


class Node:
    __slots__ = ("tag", "attrs", "kids", "seen", "lines")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.lines = tag, attributes(attrs) if attrs else {}, [], None
        self.seen = tag not in UNSEEN and "hidden" not in self.attrs and not ("style" in self.attrs and unshown(self.attrs["style"])) and not (tag == "dialog" and "open" not in self.attrs)

    def number(self, name: str, default: int) -> int:
        """Value of an attribute that is a whole number."""
        found = _NUMBER.match(self.attrs.get(name, ""))
        return int(found[1]) if found else default


def build(page: str) -> tuple[Node, list[Node]]:
    """Tree of a page and its tables, outer ones first."""
    root = Node("html")
    stack, tables, at, size = [root], [], 0, len(page)
    opened = Counter()  # open elements by tag: spares most searches of the stack

    def cut(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def close(names, stops) -> None:
        """End the open elements up to the outermost of ``names`` inside of all ``stops``."""
        last = None
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    last = i
                elif stack[i].tag in stops:
                    break
        if last is not None:
            cut(last)

    def start(tag: str, attrs: str) -> Node:
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1
        return node

    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            stack[-1].kids.append(page[at:])
            break
        if found.start() > at:
            stack[-1].kids.append(page[at : found.start()])
        at = found.end()
        tag = found[3]
        if tag is None:
            continue
        tag, attrs = tag.lower(), found[4]
        if found[2]:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif opened[tag]:
                stop = ("table", "td", "th") if tag not in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption") else ("table",)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in stop:
                        break
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            close(("p",), ("table", "td", "th", "button", "caption"))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag != "tr" and opened["table"]:
            start("tr", "")
        if tag in VOID:
            stack[-1].kids.append(Node(tag, attrs))
            continue
        node = start(tag, attrs)
        if tag == "table":
            tables.append(node)
        if tag == "pre" and page.startswith("\n", at):
            at += 1  # the first line break of a pre is not part of it
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            stop = end.start() if end else size
            node.kids.append(page[at:stop])
            cut(len(stack) - 1)
            at = page.find(">", stop) + 1 if end else size
            if at == 0:
                at = size
    return root, tables


class _Writer:
    """Lines of text under construction: collapsed inline text, line breaks and blank lines where due."""

    def __init__(self):
        self.lines, self.inline, self.gap, self.prefix = [], [], False, []

    def text(self, s: str) -> None:
        self.inline.append(s)

    def flush(self) -> None:
        joined = _WHITE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline.clear()
        if joined:
            self.put(joined)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(self.lead() + line)

    def lead(self) -> str:
        """Bullet once, blanks of the same width on later lines."""
        out = "".join(self.prefix)
        self.prefix = [" " * len(p) for p in self.prefix]
        return out


def _width(s: str) -> int:
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def flow(node: Node) -> list[str]:
    """Lines of the visible content of a node; tables inside must have been laid out before."""
    w = _Writer()
    todo, counters, pre = [(node, 0)], [], 0
    while todo:
        item, phase = todo.pop()
        if isinstance(item, str):
            s = entities.unescape(item) if "&" in item else item
            s = s.replace("\xa0", " ")
            if pre:
                first, *rest = s.split("\n")
                w.inline.append(first)
                for line in rest:
                    joined = "".join(w.inline).rstrip()
                    w.inline.clear()
                    w.put(joined) if joined else w.lines.append("")
                    w.inline.append(line)
            else:
                w.text(s)
            continue
        tag = item.tag
        if phase == 0:
            if not item.seen:
                continue
            if tag == "br":
                if "".join(w.inline).strip():
                    w.flush()
                continue
            if item.lines is not None and item is not node:
                w.flush()
                w.gap = True
                for line in item.lines:
                    w.put(line)
                w.gap = True
                continue
            if tag in SPACED or tag in LINES:
                w.flush()
                nested = tag in ("ul", "ol", "menu") and len(counters) > 0
                if tag in SPACED and not nested:
                    w.gap = True
            if tag in ("ul", "ol", "menu"):
                counters.append(item.number("start", 1) if tag == "ol" else None)
            elif tag == "li":
                if counters and counters[-1] is not None:
                    w.prefix.append(f"{counters[-1]}. ")
                    counters[-1] += 1
                else:
                    w.prefix.append("- ")
            elif tag in ("dd", "blockquote"):
                w.prefix.append("  ")
            elif tag == "pre":
                pre += 1
            todo.append((item, 1))
            todo.extend((k, 0) for k in reversed(item.kids))
        else:
            if tag == "pre":
                pre -= 1
                joined = "".join(w.inline).rstrip()
                w.inline.clear()
                if joined:
                    w.put(joined)
            if tag in SPACED or tag in LINES:
                w.flush()
            if tag in ("li", "dd", "blockquote") and w.prefix:
                w.prefix.pop()
            if tag in ("ul", "ol", "menu"):
                counters.pop()
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and counters):
                w.gap = True
    w.flush()
    return w.lines


def grid(table: Node) -> list[str]:
    """Lines of a table with aligned columns; nested tables have their lines already."""
    rows, captions, groups = [], [], 0
    todo = [(k, 0) for k in reversed(table.kids)]  # with the number of their row group, 0 for the table itself
    while todo:
        item, group = todo.pop()
        if isinstance(item, str):
            if item.strip():
                captions.append(Node("div"))
                captions[-1].kids.append(item)
        elif item.seen:
            if item.tag in ("thead", "tbody", "tfoot", "form"):
                if item.tag != "form":
                    groups += 1
                    group = groups
                todo.extend((k, group) for k in reversed(item.kids))
            elif item.tag == "tr":
                rows.append((group, [k for k in item.kids if not isinstance(k, str) and k.seen and k.tag in ("td", "th")]))
                todo.extend((k, group) for k in reversed(item.kids) if isinstance(k, str) or k.tag not in ("td", "th"))
            else:
                captions.append(item)
    placed, widths = [], {}
    held, last = [], None  # first and next column and end row of the cells that reach into later rows
    for at, (group, row) in enumerate(rows):
        held = sorted(h for h in held if h[2] > at) if group == last else []
        column, cells, k, last = 0, [], 0, group
        for cell in row:
            while k < len(held) and held[k][0] <= column:
                column = max(column, held[k][1])
                k += 1
            lines = [x for x in flow(cell) if x.strip()]
            span = min(max(1, cell.number("colspan", 1)), 1000)
            down = cell.number("rowspan", 1)
            cells.append((column, lines))
            if span == 1 and lines:
                widths[column] = max(widths.get(column, 0), *map(_width, lines))
            if down == 0 or down > 1:  # 0: to the end of the group
                held.append((column, column + span, at + min(down, 65534) if down else len(rows)))
            column += span
        if any(c[1] for c in cells):
            placed.append(cells)
    out = [line for c in captions for line in flow(c)]
    offset, total = {}, 0
    for column in sorted({c for row in placed for c, _ in row} | widths.keys()):
        offset[column] = total
        total += widths[column] + 2 if column in widths else 0
    for cells in placed:
        for k in range(max(len(lines) for _, lines in cells)):
            line, used = [], 0
            for column, lines in cells:
                if k < len(lines):
                    pad = max(offset[column] - used, 2 if used else 0)
                    line.append(" " * pad + lines[k])
                    used += pad + _width(lines[k])
            out.append("".join(line).rstrip())
    return out


def render(page: str | None) -> tuple[str, int, int]:
    """Visible text of a page, the number of its non-blank lines and of its tables."""
    if not page:
        return "", 0, 0
    root, tables = build(page.replace("\r\n", "\n"))
    for table in reversed(tables):
        table.lines = grid(table)
    lines = [x.rstrip() for x in flow(root)]
    return "\n".join(lines).strip("\n"), sum(1 for x in lines if x), len(tables)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, text, n_lines, n_tables) of every page; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_page"):
                found = [render(p) for p in part.column("_page").to_pylist()]
                text, lines, tables = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(tables, pa.int64())], names=["_key", "text", "n_lines", "n_tables"])

    kind = dict(pages.select(key).dtypes)[key]
    rows = pages.select(pages[key].alias("_key"), pages[page].alias("_page"))
    return rows.mapInArrow(run, f"_key {kind}, text string, n_lines bigint, n_tables bigint").withColumnRenamed("_key", key)
