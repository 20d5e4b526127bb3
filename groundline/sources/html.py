"""HTML pages as text blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.functions.text import collapse

# The elements that become blocks. Dropped elements hold no visible text.
BLOCK_ELEMENTS = ("title", "h1", "h2", "h3", "p", "li", "div", "footer")
DROPPED_ELEMENTS = ("script", "style")
# Fixed sets of HTML: headings; elements whose opening ends a paragraph; elements that shut off what
# is open around them; elements that end one of their own kind, and what shuts that off.
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
ENDS_PARAGRAPH = HEADINGS | {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "ul",
}
SCOPES = frozenset({"button", "caption", "object", "table", "td", "template", "th"})
ENDS_LIKE = {
    "li": (frozenset({"li"}), SCOPES | {"ul", "ol", "menu", "dir"}),
    "dt": (frozenset({"dt", "dd"}), SCOPES | {"dl"}),
    "dd": (frozenset({"dt", "dd"}), SCOPES | {"dl"}),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table", "template"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"table", "template"})),
    "tr": (frozenset({"tr", "caption"}), frozenset({"table", "template"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table", "template"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table", "template"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table", "template"})),
}
# Void elements are never open; elements of running text shape no block and are passed over.
KEPT_OPEN = (ENDS_PARAGRAPH - {"hr"}) | SCOPES | ENDS_LIKE.keys() | {"title"}
# End tags that do not reach out of a table cell or the like; those of table parts end what is inside.
ENDS_IN_SCOPE = (ENDS_PARAGRAPH - {"table"}) | {"li", "dt", "dd", "button", "object"}
# What is left open at the end of a page reaches to its end; a mark before anything but a name is text.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b.*?(?:</(?P=raw)\s*>|\Z)|<(?P<slash>/?)(?P<name>[a-z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
# The named characters of HTML 4, from the standard library; a hard blank is a blank here.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def decoded_entities(text: Column) -> Column:
    """Named and numbered characters decoded, each once; what names no character stays as it is."""
    names = F.create_map(*(F.lit(part) for pair in sorted(NAMED.items()) for part in pair))

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexadecimal = F.lower(F.left(name, F.lit(2))) == "#x"
        code = F.when(hexadecimal, F.conv(F.substring(name, 3, 6), 16, 10)).when(F.left(name, F.lit(1)) == "#", F.substring(name, 2, 7))
        code = code.try_cast("bigint")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(name != "", F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    rest = F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), decoded), "")
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), rest)).otherwise(text)


def visible_text(fragment: Column) -> Column:
    return collapse(decoded_entities(F.regexp_replace(fragment, "<[^>]*>", " ")))


def _closes(name: str) -> tuple[frozenset[str], frozenset[str]]:
    """Open elements that an opening tag ends, and those behind which it does not look for them."""
    if name in ENDS_PARAGRAPH:
        heads = HEADINGS if name in HEADINGS else frozenset()
        return frozenset({"p"}) | heads, SCOPES
    return ENDS_LIKE.get(name, (frozenset(), frozenset()))


class _Tree:
    """The open elements of a page; only elements that shape blocks are kept on the stack.

    The places of each name are known, so a tag costs the same at every depth.
    """

    def __init__(self) -> None:
        self.open: list[str] = []
        self.places: dict[str, list[int]] = {}

    def _last(self, names: Iterable[str]) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def _cut(self, names: Iterable[str], walls: Iterable[str]) -> None:
        """End the innermost open element of these names with all inside it, unless a wall is nearer."""
        place = self._last(names)
        if place >= 0 and place > self._last(walls):
            while len(self.open) > place:
                self.places[self.open.pop()].pop()

    def start(self, name: str) -> None:
        names, walls = _closes(name)
        if names:
            self._cut(names, walls)
        if name in KEPT_OPEN:
            self.places.setdefault(name, []).append(len(self.open))
            self.open.append(name)

    def end(self, name: str) -> None:
        if name in KEPT_OPEN:
            # an end tag without its element ends nothing; a cell's content cannot end what is around it
            self._cut(HEADINGS if name in HEADINGS else {name}, SCOPES - {name} if name in ENDS_IN_SCOPE else frozenset())

    def block(self) -> tuple[int, str]:
        """Place and name of the innermost open block element."""
        place = self._last(BLOCK_ELEMENTS)
        return place, self.open[place] if place >= 0 else "body"


def page_blocks(html: str) -> list[tuple[int, str, str]]:
    """Index, element and text of each run between tags of block elements, or tags that end or leave one."""
    out, tree, index, pieces, at = [], _Tree(), 0, [], 0
    block = tree.block()

    def flush() -> None:
        text = "".join(pieces)
        if text and not text.isspace():
            out.append((index, block[1], text))
        pieces.clear()

    for token in _MARKUP.finditer(html):
        pieces.append(html[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name or name in DROPPED_ELEMENTS:
            pieces.append(" ")
            continue
        tree.end(name) if token["slash"] else tree.start(name)
        if name in BLOCK_ELEMENTS or (name in KEPT_OPEN and tree.block() != block):
            flush()
            index += 1
            block = tree.block()
        else:
            pieces.append(" ")
    pieces.append(html[at:])
    flush()
    return out


def html_blocks(pages: DataFrame) -> DataFrame:
    """One block per run of text between block tags (``page_id, html``), with its element.

    Pages are read as a stream of tags with a stack of open elements. A block or heading ends an open
    paragraph, an item or cell the one before it, and an end tag everything left open inside its
    element; void elements hold nothing. A block's element is the innermost open block element where
    its text begins, ``body`` outside all. Each page is one row's work: nothing is shuffled. Null pages
    have no blocks.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for row, page in enumerate(batch.column("html").to_pylist()):
                blocks = page_blocks(page or "")
                owners += [row] * len(blocks)
                found += blocks
            index, element, part = zip(*found, strict=True) if found else ((), (), ())
            ids = batch.column("page_id").take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(index, pa.int32()), pa.array(element, pa.string()), pa.array(part, pa.string())], names=out.names)

    rows = pages.select("page_id", "html")
    out = T.StructType([T.StructField("doc_id", rows.schema["page_id"].dataType), *T.StructType.fromDDL("block_ix int, element string, part string").fields])
    blocks = rows.mapInArrow(split, out).select("doc_id", "block_ix", "element", collapse(decoded_entities(F.col("part"))).alias("content"))
    return blocks.filter(F.col("content") != "")
