"""The kinds of lines of one text, line by line: what the array version must give."""

import re
from collections import Counter

from rillgraph.llm.quality import COMMON_HAN, COMMON_WORDS

_LINE = re.compile(r"[\r\n\x0b\x0c\x85  ]+")
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_SYMBOL = re.compile(r"[^\w\s,.;:!?'\"()\-/%°，。；：！？、“”‘’（）《》【】　]")
_NOISE = re.compile(r"[�■-◿#*=~^_?<>|\\{}@$&+]")
_HIGH = re.compile(r"[\x80-\x9f¡-ÿŒœŠšŸŽžƒˆ˜–-„†-•…‰‹›€™]")
_DUMP = re.compile(r"(?:[0-9a-fA-F]{6,}:?)(?:\s+[0-9a-fA-F]{2,8}){3,}.*")
_TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{50,}")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,80}>|&[a-zA-Z]{2,8};|»|›|>>")
_BULLET = re.compile(r"\s*(?:[-*•·●○▪◦–—+]|\(?\d{1,3}[.)、）]|（\d{1,3}）|[a-zA-Z][.)])\s*\S")
_ENDED = re.compile(r"[.!?;:。！？；：…][\"'”’)）】]*\Z")
_SENTENCE = re.compile(r"[。！？；]|[.!?;](?:\s|\Z)")
_INSIDE = re.compile(r"[。！？；]|[.!?;]\s")
_CELLS = (("tab", re.compile(r"\t"), 2), ("bar", re.compile(r"[ \t]*[|｜][ \t]*"), 2), ("space", re.compile(r" {2,}|　{2,}"), 2), ("comma", re.compile(r"[,，] ?"), 3), ("semicolon", re.compile(r"[;；] ?"), 3))
_MASHED = re.compile(r"[A-Za-z][;/,.\d]+(?=[A-Za-z])")
_ITEM_END = re.compile(r"[;；,，。.、]\Z")
_CELL_CHARS, _ITEM_HAN, _ITEM_CHARS = 30, 30, 56


def _repeats(text: str, size: int = 8) -> bool:
    """Whether a few phrases fill the text: hardly any of its runs of characters are new."""
    if len(text) < 10 * size:
        return False
    return len({text[i : i + size] for i in range(len(text) - size + 1)}) < 0.2 * (len(text) - size + 1)


def _is_noise(line: str) -> bool:
    n = len(line)
    return len(_NOISE.findall(line)) > 0.25 * n or (len(_HIGH.findall(line)) > 0.3 * n and not _HAN.search(line)) or bool(_DUMP.fullmatch(line)) or sum(map(len, _TOKEN.findall(line))) > 0.5 * n

def _is_mashed(line: str) -> bool:
    """Whether letters, digits and signs follow each other as no word or number has them."""
    return sum(map(line.count, ";/,.")) > 0.08 * len(line) and len(_MASHED.findall(line)) > len(line) / 14



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
    """Whether a line is short and names one thing."""
    bare = line.strip()
    if bullet := _BULLET.match(bare):
        bare = _ITEM_END.sub("", bare[bullet.end() - 1 :])
    if _SENTENCE.search(bare):
        return False
    if len(bare) > (_ITEM_HAN if _HAN.search(bare) else _ITEM_CHARS):
        return False
    words = [w.lower() for w in _WORD.findall(bare)]
    return sum(w in COMMON_WORDS for w in words) <= 0.3 * len(words)


def kinds(text: str) -> list[tuple[str, int]]:
    """Kind and length of each line that isn't blank."""
    raw = [x for x in _LINE.split(text) if x.strip()]
    lines = [x.strip() for x in raw]
    if _repeats(text):
        return [("junk", len(x)) for x in lines]
    seen = Counter(lines)
    markup = sum(len(_MARKUP.findall(x)) for x in lines)
    navigation = markup >= 3 and markup * 60 > sum(map(len, lines))
    cells = [_cells(x) for x in raw]
    items = [_is_item(x) for x in lines]
    in_table = _in_table(cells)
    out = []
    for i, line in enumerate(lines):
        if _is_noise(line) or (seen[line] > 5 and seen[line] > 0.2 * len(lines)):
            kind = "junk"
        elif navigation and (_MARKUP.search(line) or "|" in line or items[i]):
            kind = "junk"
        elif in_table[i]:
            kind = "table"
        elif _is_mashed(line):
            kind = "junk"
        elif items[i] and (_BULLET.match(line) or any(items[max(0, i - 1) : i] + items[i + 1 : i + 2])):
            kind = "list"
        else:
            kind = "prose"
        out.append((kind, len(line)))
    return out


def stats(text):
    """Words, word characters without Han, symbols, ended and bulleted lines, common words, and the shares of the kinds."""
    found = kinds(text)
    if not found:
        return None
    lines = [x.strip() for x in _LINE.split(text) if x.strip()]
    words = _WORD.findall(text)
    latin = [w for w in words if not "一" <= w[0] <= "鿿"]
    common = sum(w in COMMON_HAN if "一" <= w <= "鿿" else w.lower() in COMMON_WORDS for w in words)
    shares = Counter()
    for kind, n in found:
        shares[kind] += n
    total = sum(shares.values())
    return {
        "words": len(words),
        "mean_word_length": sum(map(len, latin)) / max(1, len(latin)),
        "symbol_ratio": len(_SYMBOL.findall(text)) / len(text),
        "ended_lines": sum(bool(_ENDED.search(x)) for x in lines) / len(lines),
        "bullet_lines": sum(bool(_BULLET.match(x)) for x in lines) / len(lines),
        "common_words": common / max(1, len(words)),
    } | {k: shares[k] / total for k in ("prose", "list", "table", "junk")}
