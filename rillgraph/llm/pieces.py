"""Problem 5: splitting oversized items at natural boundaries.

A text is parsed into a tree: sections nested by the level of their headings, marked-up
elements, blocks (paragraphs, lists, tables, code), lines, rows and list items nested
by indentation, sentences, words.  Packing merges neighbouring subtrees of one parent
into a piece as long as they fit and descends only into a node that is too large for
any piece; what is cut off within it isn't merged with its neighbours, but a heading
stays with what follows where that fits.  Only a word that is itself too large is cut
anywhere.  Every piece but the first repeats the last ``overlap`` characters of the one
before (all of a first piece that is shorter), within the limit, so that the text is the
first piece followed by the others without what they repeat.

``boundary`` tells at what a piece ends: ``section``, ``block``, ``line``, ``sentence``,
``word``; ``overlap`` within a word that would fit but for the overlap, ``none`` within
one that doesn't; ``end`` for the last.  A text of which a piece ends at ``none`` is
``hard``, any other ``natural``.

Lengths are in code points of the stored text.  Null texts give no piece; texts up
to the limit, the empty one too, give one.  Texts that fit never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 80
LEVELS = ("section", "block", "line", "sentence", "word")
SECTION, BLOCK, LINE, SENTENCE, WORD = range(5)
#: Elements and items nested deeper than this are taken as siblings.
DEEPEST = 50

_BREAKS = "\r\n\x0b\x0c\x85\u2028\u2029"
_LINES = re.compile(rf"[^{_BREAKS}]*(?:\r\n|[{_BREAKS}]|\Z)")
_HEADING = re.compile(r"(#{1,6})[ \t]|第[一二三四五六七八九十百\d]+([章篇节条])|(\d{1,2}(?:\.\d{1,2}){1,3})[ \t]")
_NAMED = {"篇": 1, "章": 1, "节": 2, "条": 3}
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_ITEM = re.compile(r"([ \t\u3000]*)(?:[-*+•·●○▪–—][ \t]|[（(]\w{1,3}[）)]|[0-9A-Za-z一二三四五六七八九十]{1,3}[)）、]|\d{1,3}\.[ \t])")
_ROW = re.compile(r"[ \t]*\|.*\||[^\t]+\t[^\t]+")
_TAG = re.compile(r"[ \t]*<(/?)([A-Za-z][\w-]*)[^<>]*(/?)>")
_SENTENCE_END = re.compile(r"(?:[。！？；!?;]|\.(?=\s))+[\"'”’」』)）】]{0,3}\s*")
_WORD_END = re.compile(r"[\s.]+")
#: What a word can't hold: white space and the signs that end sentences.
_APART = "\\s。！？；.!?;"


class Node:
    """A span of a text and, down to its lines, its children, which cover it without gaps."""

    __slots__ = ("start", "end", "level", "rank", "children", "heading")

    def __init__(self, start: int, level: int, rank: float = 0, heading: bool = False) -> None:
        self.start, self.end, self.level, self.rank, self.heading = start, start, level, rank, heading
        self.children: list[Node] = []


def _heading_level(line: str) -> int:
    """1 for the highest; 0 if a line isn't a heading."""
    found = _HEADING.match(line)
    if not found:
        return 0
    marks, name, number = found.groups()
    return len(marks) if marks else _NAMED[name] if name else number.count(".") + 1


def parse(text: str) -> Node:
    """The tree of a text down to its lines."""
    root = Node(0, SECTION, -1)
    open_: list[Node] = [root]  # sections and elements, outermost first; a section's rank is its level, an element's is 0.5
    tags: list[str] = []
    block: Node | None = None
    kind, fence = "", ""

    def begin(at: int, what: str) -> Node:
        nonlocal block, kind
        block, kind = Node(at, BLOCK), what
        open_[-1].children.append(block)
        return block

    def close_from(depth: int, at: int) -> None:
        nonlocal block
        block = None
        for node in open_[depth:]:
            node.end = at
        del open_[depth:]

    for found in _LINES.finditer(text):
        a, b = found.span()
        if a == b:
            continue
        line = found[0]
        if fence:
            block.children.append(_leaf(a, b))
            if line.strip().startswith(fence):
                fence, block = "", None
            continue
        if not line.strip():
            # blank lines go with what stands before them
            if block is None and not open_[-1].children:
                begin(a, "blank")
            last = open_[-1].children[-1] if block is None else block
            while last.children and last.children[-1].level <= LINE and last.level < LINE:
                last = last.children[-1]
            if last.level == BLOCK:
                last.children.append(_leaf(a, b))
            if kind != "list":
                block = None
            continue
        if mark := _FENCE.match(line):
            fence = mark[1]
            begin(a, "code").children.append(_leaf(a, b))
            continue
        if level := _heading_level(line):
            depth = next((i for i, n in enumerate(open_) if n.rank >= 1 and n.rank >= level), len(open_))
            # an element stays open for the sections within it
            close_from(max(depth, max((i + 1 for i, n in enumerate(open_) if n.rank == 0.5), default=0)), a)
            section = Node(a, SECTION, level)
            open_[-1].children.append(section)
            open_.append(section)
            begin(a, "heading").children.append(_leaf(a, b))
            block.heading, block = True, None
            continue
        if (tag := _TAG.match(line)) and not tag[3]:
            if not tag[1] and f"</{tag[2]}>" not in line and len(tags) < DEEPEST and text.find(f"</{tag[2]}>", b) >= 0:
                block = None
                element = Node(a, SECTION, 0.5)
                open_[-1].children.append(element)
                open_.append(element)
                tags.append(tag[2])
                begin(a, "tag").children.append(_leaf(a, b))
                block = None
                continue
            if tag[1] and tag[2] in tags:
                begin(a, "tag").children.append(_leaf(a, b))
                while tags.pop() != tag[2]:
                    close_from(max(i for i, n in enumerate(open_) if n.rank == 0.5), b)
                close_from(max(i for i, n in enumerate(open_) if n.rank == 0.5), b)
                continue
        if item := _ITEM.match(line):
            if block is None or kind != "list":
                begin(a, "list")
            _add_item(block, a, b, len(item[1].expandtabs(4)))
            continue
        if _ROW.match(line):
            if block is None or kind != "table":
                begin(a, "table")
            block.children.append(_leaf(a, b))
            continue
        if block is not None and kind == "list" and line[0] in " \t\u3000" and text[a - 1] in _BREAKS:
            _add_item(block, a, b, None)  # goes on with the item above
            continue
        if block is None or kind != "paragraph":
            begin(a, "paragraph")
        block.children.append(_leaf(a, b))
    close_from(0, len(text))
    _set_ends(root, len(text))
    return root


def _leaf(a: int, b: int) -> Node:
    leaf = Node(a, LINE)
    leaf.end = b
    return leaf


def _add_item(block: Node, a: int, b: int, indent: int | None) -> None:
    """Puts a line under the item of a list that it belongs to: the last one with a smaller indentation."""
    parent, depth = block, 0
    while depth < DEEPEST and parent.children and parent.children[-1].rank and (indent is None or parent.children[-1].rank <= indent):
        parent, depth = parent.children[-1], depth + 1
    if indent is None:
        parent.children.append(_leaf(a, b))
        return
    item = Node(a, LINE, indent + 1)
    item.children.append(_leaf(a, b))
    parent.children.append(item)


def _set_ends(node: Node, end: int) -> None:
    node.end = end
    for child, after in zip(node.children, [*node.children[1:], None]):
        _set_ends(child, after.start if after else end)


def _cut_by(pattern: re.Pattern[str], text: str, start: int, end: int, level: int) -> Iterator[Node]:
    at = start
    for found in pattern.finditer(text, start, end):
        if found.end() > at:
            node = Node(at, level)
            node.end = at = found.end()
            yield node
    if at < end:
        node = Node(at, level)
        node.end = end
        yield node


def children(text: str, node: Node) -> list[Node]:
    """The children of a node; those of lines and sentences are made when they are asked for."""
    if node.children:
        return node.children
    if node.level < SENTENCE:
        return list(_cut_by(_SENTENCE_END, text, node.start, node.end, SENTENCE))
    if node.level == SENTENCE:
        return list(_cut_by(_WORD_END, text, node.start, node.end, WORD))
    return []


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Where each piece's own text ends, and what boundary that is."""
    out: list[tuple[int, str]] = []
    begun, room = 0, limit
    large = [m.span() for m in re.finditer(rf"[^{_APART}]{{{limit + 1},}}", text)]

    def close(at: int, boundary: str) -> None:
        nonlocal begun, room
        out.append((at, boundary))
        begun, room = at, limit - overlap

    def fill(nodes: list[Node]) -> None:
        for k, node in enumerate(nodes):
            if node.end - begun <= room:
                continue  # merged with the siblings in the open piece
            fits = node.end - node.start <= limit - overlap
            if node.start > begun and (fits or not nodes[k - 1].heading):
                close(node.start, LEVELS[node.level])
            if fits and node.end - begun <= room:
                continue
            within = children(text, node)
            if within:
                fill(within)
                if k + 1 < len(nodes):
                    close(node.end, LEVELS[nodes[k + 1].level])
            else:
                while node.end - begun > room:
                    at = begun + room
                    close(at, "none" if any(a < at < b for a, b in large) else "overlap")

    fill([parse(text)])
    out.append((len(text), "end"))
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str, str]]:
    """Start, text and boundary of each piece."""
    found, begun = [], 0
    for end, boundary in cuts(text, limit, overlap):
        start = max(0, begun - overlap) if found else 0
        found.append((start, text[start:end], boundary))
        begun = end
    return found


SCHEMA = "doc_id bigint, piece int, pieces int, start int, boundary string, kind string, text string"


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each text; ``boundary`` tells at what the piece ends, ``kind`` whether its text has a part that can't be cut naturally."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    short = rows.where(F.length("text") <= limit).select("doc_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.lit("end").alias("boundary"), F.lit("natural").alias("kind"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found = pieces(text, limit, overlap)
                kind = "hard" if any(boundary == "none" for *_, boundary in found) else "natural"
                out += [(i, k, len(found), start, boundary, kind, part) for k, (start, part, boundary) in enumerate(found)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    return short.unionByName(rows.where(F.length("text") > limit).mapInArrow(run, SCHEMA))


def found(docs: DataFrame) -> DataFrame:
    """p5_found: doc_id, kind of the texts that had to be cut, from their pieces."""
    return split(docs).where("pieces > 1 and piece = 0").select("doc_id", "kind")
