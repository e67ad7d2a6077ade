"""One consistent form for text that looks the same (problem 1), and the content
string that the duplicate operators compare (problems 2, 3 and 6).

The consistent form is made by a transducer that is compiled once per process from
the Unicode character data: a mapping from single characters and from grapheme
clusters (a base letter with its combining marks) to their consistent spelling.
Building it checks for conflicts: every source has one target and every target is
left alone by the transducer, so that applying it twice changes nothing.  A text is
rewritten in one pass; the compiled pattern skips the characters that need no
change and the longest source wins at each of the others.

Defined results: null stays null, an empty or blank text becomes ``''``, whole
texts are processed whatever their length.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

# Greek and Cyrillic letters that are drawn like Latin ones.
LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ο" "АВЕКМНОРСТУХЅІЈҮӀԚԜ" "аеорсухѕіјһԁԛԝү",
        "ABEZHIKMNOPTYX" "o" "ABEKMHOPCTYXSIJYIQW" "aeopcyxsijhdqwy",
    )
)
# Unit signs that stand for two plain characters.
UNIT_SIGNS = {"℃": "°C", "℉": "°F"}
# Signs that belong to a content string besides letters and digits.
CONTENT_SIGNS = "≤≥<>=±+×÷%‰"
#: A field label has at most this many characters, a field record at least this many fields.
LABEL_CHARS, RECORD_FIELDS = 14, 4

# Format characters that draw something, and so aren't invisible.
_DRAWN_FORMAT = frozenset("؀؁؂؃؄؅۝܏࣢\U000110bd\U000110cd")
_LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def _single(ch: str) -> str | None:
    """The consistent spelling of one character, None if it is its own."""
    if ch in UNIT_SIGNS:
        return UNIT_SIGNS[ch]
    parts = unicodedata.decomposition(ch)
    out = ch
    if parts:
        kind, *codes = parts.split() if parts.startswith("<") else ("", *parts.split())
        plain = "".join(chr(int(c, 16)) for c in codes)
        if kind in ("<wide>", "<narrow>", "<square>") or kind in ("<compat>", "<font>", "<noBreak>") and len(plain) == 1:
            # a unit sign keeps its raised digits: only this level is taken apart
            out = "".join(_single(c) or c for c in plain)
        elif not kind:
            out = plain
    out = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", out))
    out = unicodedata.normalize("NFC", out)
    return None if out == ch else out


class Transducer:
    """Longest-match rewriting by a compiled, conflict-checked table.

    ``singles`` maps characters, ``clusters`` a base with combining marks;
    clusters outside the table (several marks) are composed once and remembered.
    """

    REMEMBERED = 100_000

    def __init__(self) -> None:
        space, invisible, marks = [], [], []
        self.singles: dict[str, str] = {}
        self.clusters: dict[str, str] = {}
        for code in range(sys.maxunicode + 1):
            if 0xD800 <= code < 0xE000:
                continue
            ch = chr(code)
            kind = unicodedata.category(ch)
            if kind == "Cn":
                continue
            if ch.isspace():
                space.append(ch)
            elif (kind == "Cf" and ch not in _DRAWN_FORMAT) or ch == "͏" or 0xFE00 <= code <= 0xFE0F:
                invisible.append(ch)
            else:
                if kind[0] == "M" or ch in "ﾞﾟ":
                    marks.append(ch)
                if (to := _single(ch)) is not None:
                    self.singles[ch] = to
                if len(nfd := unicodedata.normalize("NFD", ch)) == 2 and unicodedata.combining(nfd[1]):
                    self._add(nfd, self.compose(nfd))
        for like, latin in LOOKALIKES.items():
            for mark in marks:
                if len(made := unicodedata.normalize("NFC", latin + mark)) == 1:
                    self._add(like + mark, made)
        self._check()
        #: the most letters, digits and signs that one character becomes
        self.longest = max(len(to.lower()) for to in self.singles.values())
        s, i, m, x = ("".join(map(re.escape, chars)) for chars in (space, invisible, marks, self.singles))
        self._spaced = re.compile(f"[{i}]*[{s}][{s}{i}]*")
        self._invisible = re.compile(f"[{i}]+")
        self._cluster = re.compile(f"[^{s}{m}][{m}]+")
        self._beyond = re.compile("[\U00010000-\U0010ffff]")
        self._memo: dict[str, str] = {}
        # classes within the basic plane are looked up in a table, larger ones searched: keep both
        self._basic, self._full = (
            self._patterns(*("".join(re.escape(c) for c in chars if ord(c) <= most) for chars in (space, invisible, marks, self.singles)))
            for most in (0xFFFF, sys.maxunicode)
        )

    @staticmethod
    def _patterns(s: str, i: str, m: str, x: str) -> tuple[re.Pattern[str], ...]:
        """Marks; runs of characters that need attention; the same with the base of a cluster."""
        return re.compile(f"[{m}]"), re.compile(f"[{s}{i}{x}]+"), re.compile(f"[^{s}{i}{x}{m}]?[{s}{i}{x}{m}]+")

    def _add(self, cluster: str, to: str) -> None:
        if self.clusters.setdefault(cluster, to) != to:
            raise ValueError(f"{cluster!r} becomes {self.clusters[cluster]!r} and {to!r}")

    def compose(self, cluster: str) -> str:
        """The spelling of one cluster by its parts."""
        parts = "".join(self.singles.get(c, c) if not unicodedata.combining(c) else c for c in unicodedata.normalize("NFD", cluster))
        parts = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", parts))
        return unicodedata.normalize("NFC", parts)

    def _check(self) -> None:
        for source, to in (*self.singles.items(), *self.clusters.items()):
            for c in to:
                if c in self.singles and not unicodedata.combining(c):
                    raise ValueError(f"{source!r} becomes {to!r}, which isn't final")

    def _run(self, run: str) -> str:
        out: list[str] = []
        at = 0
        for space in self._spaced.finditer(run):
            out += self._word(run[at : space.start()]), "\n" if any(c in _LINE_BREAKS for c in space[0]) else " "
            at = space.end()
        return "".join(out) + self._word(run[at:])

    def _word(self, part: str) -> str:
        part = self._invisible.sub("", part)
        out: list[str] = []
        at = 0
        for found in self._cluster.finditer(part):
            out += "".join(self.singles.get(c, c) for c in part[at : found.start()]), self.clusters.get(found[0]) or self.compose(found[0])
            at = found.end()
        return "".join(out) + "".join(self.singles.get(c, c) for c in part[at:])

    def _emit(self, found: re.Match[str]) -> str:
        run = found[0]
        to = self._memo.get(run)
        if to is None:
            to = self._run(run)
            if len(self._memo) < self.REMEMBERED and len(run) < 50:
                self._memo[run] = to
        return to

    def lines(self, text: str) -> str:
        """The consistent form, but a run of white space that holds a line break is a line feed."""
        if text.isascii() and "\n" not in text and "\r" not in text and "  " not in text and text.isprintable():
            return text.strip()
        marked, plain, clustered = self._full if self._beyond.search(text) else self._basic
        return (clustered if marked.search(text) else plain).sub(self._emit, text).strip()


@functools.cache
def transducer() -> Transducer:
    return Transducer()


def consistent(text: str | None) -> str | None:
    """The consistent form of a text: equal for texts that look the same."""
    return None if text is None else transducer().lines(text).replace("\n", " ")


_DROPPED = re.compile(rf"[^\w.{CONTENT_SIGNS}]+|_+|\.(?!\d)|(?<!\d)\.")
_PARTS = re.compile(r"[;|\n]")
_FIELD = re.compile(rf"\s*([^:]{{1,{LABEL_CHARS}}}):(.*)", re.DOTALL)


def strip_format(form: str) -> str:
    """The content string of a text in consistent form, without a look at fields."""
    return _DROPPED.sub("", form.lower())


def _json_fields(text: str) -> list[tuple[str, str]] | None:
    try:
        pairs = json.loads(text, object_pairs_hook=lambda x: x, parse_float=str, parse_int=str, strict=False)
    except (ValueError, RecursionError):
        return None
    if not isinstance(pairs, list) or not pairs or not all(isinstance(p, tuple) for p in pairs):
        return None
    if any(isinstance(v, list) for _, v in pairs):
        return None
    return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in pairs]


def fields(text: str, lines: str) -> list[tuple[str, str]] | None:
    """Label and value of each field of a field record, None if the text isn't one."""
    if lines[:1] == "{" and lines[-1:] == "}":
        found = _json_fields(lines)
        return found if found is not None else _json_fields(text)
    if lines.find(":", 0, LABEL_CHARS + 3) < 0:
        return None
    found = [_FIELD.fullmatch(p) for p in _PARTS.split(lines) if p.strip()]
    if len(found) < RECORD_FIELDS or not all(found):
        return None
    return [(m[1], m[2]) for m in found]


def content(text: str, lines: str | None = None, records: bool = True) -> str:
    """The content string: what is left of a text without its formatting.

    A field record gives the sorted content strings of its fields, so that neither
    the order of the fields nor the way they are set apart counts.
    """
    lines = transducer().lines(text) if lines is None else lines
    if records and (found := fields(text, lines)):
        t = transducer()
        return "".join(sorted(strip_format(t.lines(k)) + strip_format(t.lines(v)) for k, v in found))
    return strip_format(lines)
