"""Problem 8: text quality statistics per document.

``quality`` computes the statistics of all documents of a batch together, over one
array of their characters and of the classes that these belong to: counts within a
document or a line are differences of running sums.  Every line gets one kind by fixed
thresholds: ``prose``, ``list`` (short lines that name one thing each), ``table``
(neighbouring lines cut into as many short cells) or ``junk`` (noise, broken encoding,
dumps, navigation, one phrase over and over); patterns are tried only on the lines
whose counts leave it open.  Then ``Rules`` are applied: the published thresholds for
web text, and ours for the share of the characters in lines of each kind.  Every rule
that a document fails is recorded in ``reasons``; ``found`` is read from these.

Words are runs of letters and digits, and every single Han character; mean word length
leaves out Han characters.  Defined results: null, empty and blank texts have null
statistics, the kind ``empty`` and the reason ``empty``.  Whole texts are processed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.leaks import rolling

# Words and Han characters that carry grammar rather than content.
COMMON_WORDS = frozenset("the of and to a in is be that it for on with as by at from or an are this which not shall must may if then after before until when while under over into its has have been was were will once each per than between within about no any all".split())
COMMON_HAN = frozenset("的了是在和与及或不应须宜按由将被把对从于为以其该之后前时内外中上下可并且则若如但而当得至后再需")


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds; a document fails a rule outside of them."""

    # As published for web text (words, word length, symbols, bullets, ended lines).
    min_words: int = 50
    max_words: int = 100_000
    min_mean_length: float = 3.0
    max_mean_length: float = 10.0
    max_symbols: float = 0.1
    max_bullets: float = 0.9
    min_ended: float = 0.12
    # Adaptations: word length counts where Latin words are at least this share of all words; the least share of common
    # words, of which the published rule asks for two; most of a document in lines that aren't prose.
    latin_words: float = 0.5
    min_common: float = 0.02
    not_prose: float = 0.8


_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_DUMP = re.compile(r"(?:[0-9a-fA-F]{6,}:?)(?:\s+[0-9a-fA-F]{2,8}){3,}.*")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,80}>|&[a-zA-Z]{2,8};|»|›|>>")
_BULLET = re.compile(r"\s*(?:[-*•·●○▪◦–—+]|\(?\d{1,3}[.)、）]|（\d{1,3}）|[a-zA-Z][.)])\s*\S")
_ENDED = re.compile(r"[.!?;:。！？；：…][\"'”’)）】]*\Z")
_SENTENCE = re.compile(r"[。！？；]|[.!?;](?:\s|\Z)")
_INSIDE = re.compile(r"[。！？；]|[.!?;]\s")
_CELLS = (("tab", re.compile(r"\t"), 2), ("bar", re.compile(r"[ \t]*[|｜][ \t]*"), 2), ("space", re.compile(r" {2,}|　{2,}"), 2), ("comma", re.compile(r"[,，] ?"), 3), ("semicolon", re.compile(r"[;；] ?"), 3))
_MASHED = re.compile(r"[A-Za-z][;/,.\d]+(?=[A-Za-z])")
_ITEM_END = re.compile(r"[;；,，。.、]\Z")
_CELL_CHARS, _ITEM_HAN, _ITEM_CHARS, _PHRASE = 30, 30, 56, 8
KINDS = ("junk", "list", "table", "prose")
CHUNK = 64_000

#: Classes of characters, a bit each.
_CLASSES = {
    "space": r"\s",
    "line_break": "[\r\n\x0b\x0c\x85\u2028\u2029]",
    "word": r"[^\W_]",
    "han": "[一-鿿]",
    "any_han": "[㐀-鿿豈-﫿]",
    "common_han": f"[{''.join(sorted(COMMON_HAN))}]",
    "symbol": r"[^\w\s,.;:!?'\"()\-/%°，。；：！？、“”‘’（）《》【】　]",
    "noise": "[�■-◿#*=~^_?<>|\\\\{}@$&+]",
    "high": "[\x80-\x9f¡-ÿŒœŠšŸŽžƒˆ˜–-„†-•…‰‹›€™]",
    "end": "[.!?;:。！？；：…]",
    "closer": "[\"'”’)）】]",
    "stop": "[。！？；]",
    "dot": "[.!?;]",
    "mashing": "[;/,.]",
    "mark": "[<>&»›]",
    "cut": "[\t|｜]",
    "blank": "[ 　]",
    "comma": "[,，]",
    "semicolon": "[;；]",
    "token": "[A-Za-z0-9+/=_-]",
    "hex": "[0-9a-fA-F]",
    "digit": r"\d",
    "letter": "[A-Za-z]",
    "bullet": "[-*•·●○▪◦–—+]",
}
_BIT = {name: np.uint32(1 << k) for k, name in enumerate(_CLASSES)}


def _class_of(chars: str) -> np.ndarray:
    out = np.zeros(len(chars), np.uint32)
    for name, pattern in _CLASSES.items():
        out[np.fromiter((m.start() for m in re.finditer(pattern, chars)), np.int64)] |= _BIT[name]
    return out


@functools.cache
def _basic_classes() -> np.ndarray:
    return _class_of("".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x10000))))


def _classes(chars: np.ndarray) -> np.ndarray:
    """The classes of each character, those beyond the basic plane looked up as they come."""
    out = _basic_classes()[np.minimum(chars, 0xFFFF)]
    beyond = np.flatnonzero(chars > 0xFFFF)
    if len(beyond):
        names, at = np.unique(chars[beyond], return_inverse=True)
        out[beyond] = _class_of("".join(map(chr, names)))[at]
    return out


@functools.cache
def _common_codes() -> np.ndarray:
    return np.array([int.from_bytes(w.encode(), "little") for w in COMMON_WORDS], np.uint64)


class Lines:
    """The lines of some texts that aren't blank, and counts of characters within them."""

    def __init__(self, texts: list[str]) -> None:
        self.joined = "\n".join(texts) + "\n"
        self.chars = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.classes = _classes(self.chars)
        self._sums: dict[str, np.ndarray] = {}
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(self.lengths + 1) - 1
        self.begins = self.stops - self.lengths
        breaks = np.flatnonzero(self.has("line_break"))
        start, end = np.r_[0, breaks[:-1] + 1], breaks
        drawn = np.flatnonzero(~self.has("space"))
        before = self.sums("drawn", ~self.has("space"))
        kept = before[end] > before[start]
        #: a line as it is stored, and without the white space around it
        self.raw_start, self.raw_end = start[kept], end[kept]
        self.start, self.end = drawn[before[self.raw_start]], drawn[before[self.raw_end] - 1] + 1
        self.size = self.end - self.start
        self.text = np.searchsorted(self.stops, self.start, "right")

    def has(self, *names: str) -> np.ndarray:
        return (self.classes & sum((_BIT[n] for n in names), np.uint32(0))) > 0

    def sums(self, name: str, mask: np.ndarray | None = None) -> np.ndarray:
        """Running sums of a class, or of a mask of this name."""
        if name not in self._sums:
            self._sums[name] = np.r_[0, np.cumsum(self.has(name) if mask is None else mask, dtype=np.int32)]
        return self._sums[name]

    def count(self, name: str) -> np.ndarray:
        """In each line."""
        return self.sums(name)[self.end] - self.sums(name)[self.start]

    def within(self, name: str) -> np.ndarray:
        """In each text."""
        return (self.sums(name)[self.stops] - self.sums(name)[self.begins]).astype(np.int64)

    def line(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]

    def at(self, k: int | np.ndarray) -> np.ndarray:
        """The classes of the character ``k`` places after the start of each line, 0 beyond its end."""
        place = self.start + k
        return np.where(place < self.end, self.classes[np.minimum(place, len(self.classes) - 1)], 0).astype(np.uint32)

    def char(self, k: int | np.ndarray) -> np.ndarray:
        place = self.start + k
        return np.where(place < self.end, self.chars[np.minimum(place, len(self.chars) - 1)], 0)

    def words(self) -> None:
        """Running sums of words and of common words, counted where they begin."""
        latin = self.has("word") & ~self.has("han")
        edge = np.diff(np.r_[0, latin.view(np.int8), 0])
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.sums("latin_chars", latin)
        begins = np.zeros(len(latin), bool)
        begins[start] = True
        self.sums("latin_words", begins)
        short = np.flatnonzero(end - start <= 8)
        start, size = start[short], (end - start)[short]
        code, plain = np.zeros(len(short), np.uint64), np.ones(len(short), bool)
        for k in range(8):
            c = np.where(k < size, self.chars[np.minimum(start + k, len(self.chars) - 1)], 0)
            plain &= c < 0x80
            code |= np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64) << np.uint64(8 * k)
        common = self.has("common_han")
        common[start[plain & np.isin(code, _common_codes())]] = True
        self.sums("common", common)

    def ended(self) -> np.ndarray:
        """Lines whose last character, but for closing signs, ends a sentence."""
        other = ~self.has("closer")
        places, before = np.flatnonzero(other), self.sums("no_closer", other)
        last = places[np.maximum(before[self.end] - 1, 0)]
        return (last >= self.start) & ((self.classes[last] & _BIT["end"]) > 0)

    def bulleted(self) -> np.ndarray:
        """Lines that begin with a bullet, a number or a letter of a list, before something else."""

        def numbered(k: np.ndarray, closing: str) -> np.ndarray:
            digits, going = np.zeros(len(self.start), np.int64), np.ones(len(self.start), bool)
            for step in range(3):
                going = going & ((self.at(k + step) & _BIT["digit"]) > 0)
                digits += going
            return (digits > 0) & np.isin(self.char(k + digits), [ord(c) for c in closing]) & (self.size > k + digits + 1)

        first, none = self.char(0), np.zeros(len(self.start), np.int64)
        sign = ((self.at(0) & _BIT["bullet"]) > 0) & (self.size > 1)
        letter = ((self.at(0) & _BIT["letter"]) > 0) & np.isin(self.char(1), [ord(c) for c in ".)"]) & (self.size > 2)
        return sign | letter | numbered(none + (first == ord("(")), ".)、）") | ((first == ord("（")) & numbered(none + 1, "）"))

    def longest_part(self, name: str) -> np.ndarray:
        """The longest part of each line between characters of a class."""
        cuts = np.flatnonzero(self.has(name))
        owner = np.searchsorted(self.end, cuts, "right")  # the first line that ends after it
        cuts, owner = cuts[owner < len(self.end)], owner[owner < len(self.end)]
        cuts, owner = cuts[cuts >= self.start[owner]], owner[cuts >= self.start[owner]]
        lines = np.arange(len(self.start))
        edges, owner = np.concatenate([self.start - 1, cuts, self.end]), np.concatenate([lines, owner, lines])
        order = np.lexsort((edges, owner))
        parts = np.diff(edges[order]) - 1
        parts[np.diff(owner[order]) > 0] = 0  # from the end of a line to the next one's start
        return np.maximum.reduceat(np.r_[parts, 0], np.searchsorted(owner[order], lines))

    def token_chars(self) -> np.ndarray:
        """Characters of each line in runs of at least 50 that look like a code."""
        edge = np.diff(np.r_[0, self.has("token").view(np.int8), 0])
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= 50
        total = np.zeros(len(self.start), np.int64)
        if long.any():
            np.add.at(total, np.searchsorted(self.end, start[long], "right"), (end - start)[long])
        return total

    def repeated(self) -> np.ndarray:
        """How often each line stands in its text."""
        power, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[np.uint64(1), np.full(len(self.chars), power)])
            down = np.cumprod(np.r_[np.uint64(1), np.full(len(self.chars), inverse)])
            total = np.r_[np.uint64(0), np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * up[:-1])]
            hashed = (total[self.end] - total[self.start]) * down[self.start]
        key = np.stack([self.text.astype(np.uint64), hashed ^ self.size.astype(np.uint64)], 1)
        _, at, times = np.unique(key, axis=0, return_inverse=True, return_counts=True)
        return times[at.ravel()]

    def phrases_repeat(self) -> np.ndarray:
        """Texts in which hardly any run of characters is new."""
        found = rolling(self.chars, _PHRASE) * np.uint64(0x94D049BB133111EB)  # the last character counts in the high bits too
        n = np.maximum(self.lengths - _PHRASE + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.repeat(self.begins - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (found[at] >> np.uint64(16)))
        new = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        distinct = np.bincount((new >> np.uint64(48)).astype(np.int64), minlength=len(n))
        return (self.lengths >= 10 * _PHRASE) & (distinct < 0.2 * n)


def _cells(raw: str) -> tuple[str, int] | None:
    """How a line is cut into short cells, None if it isn't."""
    line = raw.strip(" \r\n")
    for name, cut, least in _CELLS:
        cells = cut.split(line)
        if len(cells) < least or (name in ("comma", "semicolon") and (any(len(c) > 24 or _INSIDE.search(c) for c in cells) or len(cells[-1]) > 8 and _ENDED.search(line))):
            continue
        if max(map(len, cells)) <= 2 * _CELL_CHARS and sum(map(len, cells)) <= _CELL_CHARS * len(cells):
            return name, len(cells)
    return None


def _in_table(cells: list[tuple[str, int] | None]) -> list[bool]:
    """Whether a line stands among neighbours cut in the same way into as many cells."""
    out = [False] * len(cells)
    start = 0
    for i in range(1, len(cells) + 1):
        a, b = cells[i - 1], cells[i] if i < len(cells) else None
        if not (a and b and a[0] == b[0] and abs(a[1] - b[1]) <= 2 * (a[0] == "space")):
            if a and i - start >= (4 if a[0] in ("comma", "semicolon") else 2):
                out[start:i] = [True] * (i - start)
            start = i
    return out


def _is_item(line: str) -> bool:
    """Whether a bulleted line is short and names one thing."""
    if bullet := _BULLET.match(line):
        line = _ITEM_END.sub("", line[bullet.end() - 1 :])
    if _SENTENCE.search(line) or len(line) > (_ITEM_HAN if _HAN.search(line) else _ITEM_CHARS):
        return False
    words = [w.lower() for w in _WORD.findall(line)]
    return sum(w in COMMON_WORDS for w in words) <= 0.3 * len(words)


def line_kinds(lines: Lines) -> np.ndarray:
    """The place in ``KINDS`` of the kind of each line."""
    n, size, text = len(lines.start), lines.size, lines.text
    if not n:
        return np.empty(0, np.int64)
    held = np.bincount(text, minlength=len(lines.lengths))
    bulleted = lines.bulleted()

    def patterned(where: np.ndarray, test) -> np.ndarray:  # noqa: ANN001
        """``test`` of the lines where it can be true."""
        out = np.zeros(n, bool)
        for i in np.flatnonzero(where):
            out[i] = test(lines.line(i))
        return out

    noise = (lines.count("noise") > 0.25 * size) | ((lines.count("high") > 0.3 * size) & (lines.count("any_han") == 0)) | (lines.token_chars() > 0.5 * size)
    all_hex = np.logical_and.reduce([(lines.at(k) & _BIT["hex"]) > 0 for k in range(6)])
    noise |= patterned(all_hex & ~noise, lambda x: bool(_DUMP.fullmatch(x)))
    again = lines.repeated()
    noise |= (again > 5) & (again > 0.2 * held[text])

    # a line without a bullet is an item if it is short, isn't a sentence and has few common words
    lines.sums("stop_before_space", lines.has("dot") & np.r_[lines.has("space")[1:], True])
    no_sentence = (lines.count("stop") == 0) & (lines.count("stop_before_space") == 0)
    words = lines.count("latin_words") + lines.count("han")
    few_common = lines.count("common") - lines.count("common_han") <= 0.3 * words
    items = ~bulleted & no_sentence & few_common & (size <= np.where(lines.count("any_han") > 0, _ITEM_HAN, _ITEM_CHARS))
    items |= patterned(bulleted, _is_item)

    markup = np.zeros(n, np.int64)
    for i in np.flatnonzero(lines.count("mark") > 0):
        markup[i] = len(_MARKUP.findall(lines.line(i)))
    marks = np.bincount(text, markup, len(held))
    navigation = (marks >= 3) & (marks * 60 > np.bincount(text, size, len(held)))
    bar = np.zeros(len(lines.chars), bool)
    bar[lines.chars == ord("|")] = True
    lines.sums("bar", bar)
    navigating = navigation[text] & ((markup > 0) | (lines.count("bar") > 0) | items)

    # cells: by tabs, bars or wide spaces, or by commas or semicolons that are never far from each other
    raw_tab = lines.sums("cut")[lines.raw_end] > lines.sums("cut")[lines.raw_start]
    wide = lines.has("blank") & np.r_[lines.has("blank")[1:], False]
    lines.sums("wide", wide)
    near = lambda name: (lines.count(name) >= 2) & (lines.longest_part(name) <= 25)
    may = raw_tab | (lines.sums("wide")[lines.raw_end] > lines.sums("wide")[lines.raw_start]) | near("comma") | near("semicolon")
    table = np.zeros(n, bool)
    starts = np.searchsorted(text, np.arange(len(held) + 1))
    for t in np.unique(text[may]):
        a, b = starts[t], starts[t + 1]
        table[a:b] = _in_table([_cells(lines.joined[lines.raw_start[i] : lines.raw_end[i]]) if may[i] else None for i in range(a, b)])

    mashed = patterned(~noise & ~navigating & ~table & (lines.count("mashing") > 0.08 * size), lambda x: len(_MASHED.findall(x)) > len(x) / 14)
    same = text[1:] == text[:-1]
    neighbour = np.r_[False, items[:-1] & same] | np.r_[items[1:] & same, False]
    chosen = [lines.phrases_repeat()[text] | noise | navigating, table, mashed, items & (bulleted | neighbour)]
    return np.select(chosen, [0, 2, 0, 1], 3)


COLUMNS = ("words", "mean_word_length", "symbol_ratio", "ended_lines", "bullet_lines", "common_words", "prose", "list", "table", "junk")
SCHEMA = "doc_id bigint, words bigint, mean_word_length double, symbol_ratio double, ended_lines double, bullet_lines double, common_words double, prose double, list double, table double, junk double, kind string, reasons array<string>"


def statistics(texts: list[str], rules: Rules = Rules()) -> tuple[dict[str, np.ndarray], list[str], list[list[str]]]:
    """The columns of statistics, the kind and the failed rules of each text; texts that are blank have none."""
    lines = Lines(texts)
    lines.words()
    n = len(texts)
    kinds = line_kinds(lines)
    chars = np.bincount(lines.text * 4 + kinds, lines.size, 4 * n).reshape(n, 4)
    held = np.bincount(lines.text, minlength=n)
    some = held > 0
    latin, han = lines.within("latin_words"), lines.within("han")
    words = latin + han
    share = lambda x, of: x / np.maximum(of, 1)
    s = {
        "words": words,
        "mean_word_length": share(lines.within("latin_chars"), latin),
        "symbol_ratio": share(lines.within("symbol"), lines.lengths),
        "ended_lines": share(np.bincount(lines.text, lines.ended(), n), held),
        "bullet_lines": share(np.bincount(lines.text, lines.bulleted(), n), held),
        "common_words": share(lines.within("common"), words),
    } | {k: share(chars[:, KINDS.index(k)], chars.sum(1)) for k in ("prose", "list", "table", "junk")}
    mostly = np.where(chars[:, :3].sum(1) >= rules.not_prose * chars.sum(1), chars[:, :3].argmax(1), 3)
    measured = latin > rules.latin_words * words
    failed = {
        "few words": words < rules.min_words,
        "many words": words > rules.max_words,
        "word length": measured & ((s["mean_word_length"] < rules.min_mean_length) | (s["mean_word_length"] > rules.max_mean_length)),
        "symbols": s["symbol_ratio"] > rules.max_symbols,
        "bullets": s["bullet_lines"] > rules.max_bullets,
        "lines without end": s["ended_lines"] < rules.min_ended,
        "common words": s["common_words"] < rules.min_common,
    } | {f"mostly {KINDS[k]}": mostly == k for k in range(3)}
    names, table = list(failed), np.stack(list(failed.values()), 1)
    reasons = [[names[j] for j in np.flatnonzero(row)] if is_some else ["empty"] for row, is_some in zip(table, some)]
    kind = [KINDS[k] if is_some else "empty" for k, is_some in zip(mostly, some)]
    return {k: np.ma.array(v, mask=~some) for k, v in s.items()}, kind, reasons


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row of statistics, line-kind shares, kind and failed rules per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch[0], [t or "" for t in batch[1].to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
                s, kind, reasons = statistics(texts[at:end], rules)
                columns = [pa.array(s[c].data, pa.int64() if c == "words" else pa.float64(), mask=np.ma.getmaskarray(s[c])) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([ids[at:end], *columns, pa.array(kind), pa.array(reasons, pa.list_(pa.string()))], names=["doc_id", *COLUMNS, "kind", "reasons"])
                at = end

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, SCHEMA)


def found(docs: DataFrame) -> DataFrame:
    """p8_found: doc_id, kind of the documents that fail a rule for what they mostly are."""
    reason = F.element_at(F.filter("reasons", lambda r: r.startswith("mostly ")), 1)
    failed = quality(docs).where(F.exists("reasons", lambda r: r.startswith("mostly ")))
    return failed.select("doc_id", F.substring_index(reason, " ", -1).alias("kind"))
