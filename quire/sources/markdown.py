"""Web pages as markdown: headings, lists, links, emphasis, code, quotes and tables, so that what reads markdown reads pages.

A page is a fold over its tags with a stack of open elements; Spark hands pages out in Arrow batches. Rules:

- Comments and script, style, title, template, noscript and svg go with all that they hold. All entities are read.
- Runs of white space are one space, but in pre; a space that does not break (&nbsp;) is a character. Blocks are parted by an empty line, list items and table rows by a line end.
- h1 to h6 become # marks, li becomes "- " or its number, two spaces further in for each list around it, a becomes [text](href),
  img ![alt](src), b and strong **, i and em *, code `, pre a fence, blockquote "> ", hr ---.
- A table is a row of pipes for each tr, a line of dashes behind the first; | in a cell is \\|, a cell of several columns is
  followed by empty ones, short rows are filled up. A table inside a cell is its text.
- An element that is never closed ends with what it is in; a tag that closes nothing is left out. A block ends emphasis and links.

Null stays null, an empty page is ''. A page is taken whole in one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WHITE = " \t\n\f\r"
_SPACE = re.compile(f"[{WHITE}]+")
#: White space that is not one space already.
_WIDE = re.compile(f"[{WHITE[1:]}]| [{WHITE}]")
#: A table's row of cells that hold no tags, and its cells.
_ROW = re.compile(f"<tr>[{WHITE}]*+(?:(?:<td>[^<]*+(?:</td>)?|<th>[^<]*+(?:</th>)?)[{WHITE}]*+)++</tr>")
_CELL = re.compile("<t[dh]>([^<]*)")
#: Elements that go with all they hold, that have no end, that stand alone as blocks, and marks of emphasis.
DROPPED = {"script", "style", "title", "template", "noscript", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "html", "main", "nav", "p", "section", "summary"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
FRAMES = {*MARKS, *HEADINGS, "a", "pre", "ul", "ol", "li", "blockquote", "table", "tr", "td", "th", "caption"}
INLINE = {*MARKS, "a"}
#: Elements that hold others and no text of their own.
HOLDERS = {"table", "tr", "ul", "ol"}
CELLS = {"td", "th"}
#: A space that no later step takes away, until the page is done, and what a list's lines stand in by.
ONE, IN = "\1", "\1\1"
#: What a tag that opens ends before it: the open elements, up to the one that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}


class _Frame:
    __slots__ = ("tag", "parts", "attributes", "items")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.parts, self.attributes, self.items = tag, [], attributes, []


def _spaced(text: str) -> str:
    return _SPACE.sub(" ", text) if _WIDE.search(text) else text


def _parsed(found: tuple[str, str, str]) -> tuple[bool, str, dict[str, str]]:
    """Whether a tag closes, its name and the attributes that matter, of what _TAG finds in it."""
    tag = found[1].lower()
    attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(found[2])} if found[2] and not found[0] and tag in ("a", "img", "td", "th") else {}
    return bool(found[0]), tag, attributes


#: Short tags come again and again; attributes are only read.
_known = lru_cache(4096)(_parsed)


def _tidy(parts: list[str]) -> str:
    """Parts as blocks: one space between words, none at line ends, one empty line between blocks; lines of a fence stay as they are."""
    text = "".join(parts)
    pieces = re.split(r"(\0[^\0]*\0)", text) if "\0" in text else [text]
    for i in range(0, len(pieces), 2):
        x = pieces[i]
        # patterns are tried only where they find something
        if "  " in x:
            x = re.sub("  +", " ", x)
        if " \n" in x or "\n " in x:
            x = re.sub(r" +\n *|\n +", "\n", x)
        if "\n\n\n" in x:
            x = re.sub(r"\n{3,}", "\n\n", x)
        pieces[i] = x
    return "".join(pieces).strip("\n ")


def _row(cells: list[str], width: int) -> str:
    return f"|{ONE}" + f"{ONE}|{ONE}".join(cells + [""] * (width - len(cells))) + f"{ONE}|"


def _rendered(f: _Frame, depth: int) -> str:
    """The markdown of an element that ends; depth: lists around it."""
    text = "".join(f.parts)
    if f.tag in MARKS:
        inner = text.strip(WHITE)
        return text if not inner else " " * text.startswith(" ") + MARKS[f.tag] + inner + MARKS[f.tag] + " " * text.endswith(" ")
    if f.tag == "a":
        inner, href = text.strip(WHITE), f.attributes.get("href")
        return text if not inner or not href else " " * text.startswith(" ") + f"[{inner}]({href})" + " " * text.endswith(" ")
    if f.tag in HEADINGS:
        inner = _SPACE.sub(" ", text).strip(WHITE)
        return f"\n\n{'#' * HEADINGS[f.tag]} {inner}\n\n" if inner else "\n\n"
    if f.tag == "pre":
        return f"\n\n\0```\n{text.strip(chr(10))}\n```\0\n\n"
    if f.tag == "li":
        return _tidy(f.parts)
    if f.tag in ("ul", "ol"):
        lines = []
        for i, item in enumerate(f.items, 1):
            mark = "- " if f.tag == "ul" else f"{i}. "
            lines += [mark + line if not n else IN + line for n, line in enumerate(re.sub(r"\n\n+", "\n", item).split("\n"))]
        return ("\n\n" if depth == 0 else "\n") + "\n".join(lines) + ("\n\n" if depth == 0 else "\n")
    if f.tag == "blockquote":
        inner = _tidy(f.parts)
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in inner.split("\n")) + "\n\n" if inner else "\n\n"
    if f.tag == "table":
        rows = [r for r in f.items if r]
        width = max(map(len, rows), default=0)
        lines = [_row(r, width) for r in rows]
        lines[1:1] = [_row(["---"] * width, width)] if rows else []
        caption = _SPACE.sub(" ", text).strip(WHITE)
        return "\n\n" + caption + "\n\n" * bool(caption) + "\n".join(lines) + "\n\n"
    return _spaced(text).strip(WHITE)  # td, th, caption


def to_markdown(page: str) -> str:
    stack = [_Frame("", {})]
    open_tags = dict.fromkeys(FRAMES, 0)
    odd = "\0" in page or "\1" in page

    def close() -> None:
        f = stack.pop()
        tag = f.tag
        open_tags[tag] -= 1
        above = stack[-1]
        if tag == "tr":
            if above.tag == "table":
                above.items.append(f.items)
            else:  # outside a table
                above.parts.append(f" {' '.join(f.items)} ")
            return
        out = _rendered(f, open_tags["ul"] + open_tags["ol"])
        if tag in CELLS and above.tag == "tr":
            above.items.append(out.replace("|", "\\|"))
            if f.attributes:
                span = f.attributes.get("colspan", "1")
                above.items += [""] * (min(int(span), 1000) - 1 if span.isdecimal() else 0)
        elif tag == "li" and above.tag in ("ul", "ol"):
            above.items.append(out)
        elif tag in ("td", "th", "li", "caption"):
            above.parts.append(f" {out} ")
        elif tag == "table" and open_tags["table"]:
            above.parts.append(" " + " ".join(c.replace("\\|", "|") for r in f.items for c in r if c) + " ")
        else:
            above.parts.append(out)

    def end_inline() -> None:
        while stack[-1].tag in INLINE:
            close()

    def text(raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        if odd:
            raw = raw.replace("\0", "\ufffd").replace("\1", "\ufffd")
        top = stack[-1]
        if open_tags["pre"]:
            top.parts.append(raw)
        elif top.tag not in HOLDERS or raw.strip(WHITE):
            top.parts.append(_spaced(raw))

    at, tags = 0, _TAG.finditer(page)
    while True:
        m = next(tags, None)
        if m is None:
            if at < len(page):
                text(page[at:])
            break
        start, end = m.span()
        if at < start:
            text(page[at:start])
        at = end
        found = m.group(1, 2, 3)
        if found[1] is None:
            continue
        closes, tag, attributes = (_known if end - start < 64 else _parsed)(found)
        if closes:
            if tag in FRAMES:
                if not open_tags[tag]:
                    continue
                if tag in INLINE:
                    names = [f.tag for f in stack]
                    where = len(names) - 1 - names[::-1].index(tag)
                    if all(n in INLINE for n in names[where:]):
                        while len(stack) > where:
                            close()
                else:
                    while True:
                        done = stack[-1].tag == tag
                        close()
                        if done:
                            break
            elif tag in BLOCKS:
                end_inline()
                stack[-1].parts.append("\n\n")
        elif tag in FRAMES:
            if tag == "code" and open_tags["pre"]:
                continue
            if tag == "tr" and stack[-1].tag == "table" and not odd and not open_tags["pre"] and (row := _ROW.match(page, start)):
                # the same as its tags one by one
                stack[-1].items.append([_spaced(html.unescape(c)).strip(WHITE).replace("|", "\\|") for c in _CELL.findall(row[0])])
                at = row.end()
                tags = _TAG.finditer(page, at)
                continue
            if tag not in INLINE:
                if stack[-1].tag in INLINE:
                    end_inline()
                if tag in ENDS:
                    ended, holder = ENDS[tag]
                    inside, ends = len(stack) - 1, False
                    while inside >= 0 and stack[inside].tag not in holder:
                        ends = ends or stack[inside].tag in ended
                        inside -= 1
                    if inside >= 0 and ends:
                        while len(stack) > inside + 1:
                            close()
            stack.append(_Frame(tag, attributes))
            open_tags[tag] += 1
        elif tag in BLOCKS:
            end_inline()
            stack[-1].parts.append("\n\n")
        elif tag in DROPPED:
            close_tag = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close_tag.end() if close_tag else len(page)
            tags = _TAG.finditer(page, at)
        elif tag == "br":
            stack[-1].parts.append("\n")
        elif tag == "hr":
            end_inline()
            stack[-1].parts.append("\n\n---\n\n")
        elif tag == "img" and attributes.get("src"):
            stack[-1].parts.append(f"![{attributes.get('alt', '')}]({attributes['src']})")
    while len(stack) > 1:
        close()
    return _tidy(stack[0].parts).replace("\0", "").replace("\1", " ")


@F.pandas_udf(StringType())
def page_markdown(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """to_markdown() of a column of pages; null stays null."""
    for part in pages:
        yield part.map(to_markdown, na_action="ignore")
