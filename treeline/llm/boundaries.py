"""Structure, candidate gaps and features for sentence segmentation (plain Python over one text).

A text is cut into *units* by rules that hold in every language (empty lines, heading and list lines, chat turns,
``$$`` formulas). Inside a unit the *gaps* are open: places after an end mark (with its closing quotes, brackets and emoji)
and spaces between Thai words, outside quotations, brackets, code and formulas; in a unit without any punctuation every
place between words (characters, where words are not spaced). Whether a gap is a boundary is decided by the hidden-event
model in ``sentences``.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

#: Marks and character classes.
ASCII_MARKS = ".!?;"
WIDE_MARKS = "。！？．｡؟۔।॥…‥;။។።։།"
EMOJI = "\U0001f000-\U0001f594\U0001f596-\U0001faff☀-➿←-⇿⬀-⯿\ufe0f\u200d\U000e0020-\U000e007f"  # without U+1F595, which stands for a word
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "[": "]", "《": "》", "‘": "’", '"': '"', "〈": "〉", "［": "］"}
CONTINUES = set(",;:、，；：،؛·)]}）】」』”»%=&/|" + ASCII_MARKS + WIDE_MARKS)

_FORMULA = re.compile(r"\$\$.*?\$\$", re.S)
_LINE = re.compile(r"[^\n]*\n?")
HEAD = re.compile(r"[ \t\u3000]*#{1,6}(?:[ \t\u3000]+|$|(?=[^\s#]))")
LIST = re.compile(r"[ \t\u3000]*(?:[-*]|\d{1,9}\.)[ \t\u3000]+")
SPEAKER = re.compile(r"\s*[^\s:：.!?。！？][^:：\n.!?。！？]{0,60}?[:：]\s*")
_GUARD = re.compile(r"`[^`\n]+`|\$(?!\s)[^$\n]{1,200}(?<!\s)\$")
_QUOTES = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
_MARKS = re.compile(f"[{re.escape(ASCII_MARKS + WIDE_MARKS)}]+(?:[ \u00a0\u202f]*[{re.escape(ASCII_MARKS + WIDE_MARKS)}]+)*")
_MARKS_OR_THAI = re.compile(_MARKS.pattern + r"|(?<=[฀-๿])\s+(?=[฀-๿])")
THAI = re.compile("[฀-๿]")
_PUNCTUATION = re.compile("[.,!?;:…‥،؛٬、，；：·" + re.escape(WIDE_MARKS) + "]")
_AFTER = re.compile(f"(?:\\s*[{EMOJI}]+)+")
_EMOJI = re.compile(f"[{EMOJI}]")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\s぀-ヿ㐀-鿿豈-﫿]+")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿]{2,}")
SPACE = "␣"
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿＀-￯]")
_DIGITS = re.compile(r"\d+")
_WS = " \t\r\n\u00a0\u3000\x0b\x0c\u2028\u2029\u202f\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u205f\x85\x1c\x1d\x1e\x1f"


class Gap(NamedTuple):
    end: int  # end of the left sentence
    start: int  # start of the right one
    keys: tuple  # l0, l1, l2, r1, r2
    first: int  # the left word is the first of its sentence: 1 yes, 0 no, 2 only if the previous gap is a boundary


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a] in _WS or text[a].isspace()):
        a += 1
    while b > a and (text[b - 1] in _WS or text[b - 1].isspace()):
        b -= 1
    return a, b


def units(text: str, chat: bool, lines: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, content start): ranges no sentence may cross. ``lines``: each line break ends one."""
    out: list[tuple[int, int, int]] = []

    def add(a: int, b: int, body: int) -> None:
        a, b = _trim(text, a, b)
        if a < b:
            out.append((a, b, min(max(a, body), b)))

    def plain(a: int, b: int) -> None:
        begun = None
        pos = a
        while pos < b:
            m = _LINE.match(text, pos, b)
            s, e = m.start(), m.end()
            pos = e
            line = text[s:e]
            if not line.strip(_WS).strip():
                if begun is not None:
                    add(begun, s, begun)
                    begun = None
                continue
            mark = None
            if chat:
                mark = SPEAKER.match(line)
                body = s + (mark.end() if mark else 0)
            else:
                mark = HEAD.match(line) or LIST.match(line)
                body = s + (mark.end() if mark else 0)
            if chat or mark or lines:
                if begun is not None:
                    add(begun, s, begun)
                    begun = None
                add(s, e, body)
            elif begun is None:
                begun = s
        if begun is not None:
            add(begun, b, begun)

    last = 0
    if "$$" in text:
        for m in _FORMULA.finditer(text):
            plain(last, m.start())
            add(m.start(), m.end(), m.end())
            last = m.end()
    plain(last, len(text))
    return out


def guarded(unit: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Ranges inside which no sentence ends, and close position -> open position of quotes and brackets."""
    zones = [(m.start(), m.end()) for m in _GUARD.finditer(unit)] if "`" in unit or "$" in unit else []
    stack: list[tuple[str, int]] = []
    closes: dict[int, int] = {}
    z = 0
    for m in _QUOTES.finditer(unit):
        at, ch = m.start(), m.group()
        while z < len(zones) and zones[z][1] <= at:
            z += 1
        if z < len(zones) and zones[z][0] <= at:
            continue
        hit = next((k for k in range(len(stack) - 1, -1, -1) if ch in PAIRS[stack[k][0]]), None)
        if hit is not None:
            closes[at] = stack[hit][1]
            del stack[hit:]
        elif ch in PAIRS:
            stack.append((ch, at))
    return zones, closes


@lru_cache(maxsize=100_000)
def _shape(word: str) -> str:
    if not word:
        return "-"
    c = word[-1]
    if _CJK.match(c):
        return "C"
    core = word.strip("“”«»()[]„‘’\"'")
    if core.replace(".", "").replace(",", "").isdigit():
        return "0"
    letters = core.replace(".", "")
    if len(letters) == 1:
        return "1"
    if "." in core:
        return "d"
    if len(letters) <= 4:
        return "Ab" if letters[:1].isupper() else "ab"
    return "Aw" if letters[:1].isupper() else "w"


def first_word(unit: str, n: int) -> tuple[str, str]:
    """Right context at ``n``: first word (two characters where words are not spaced) and its class."""
    k, size = n, len(unit)
    while k < size and k < n + 3 and not unit[k].isalnum():
        k += 1
    lead = unit[n:k].strip() if k > n else ""
    d = unit[k : k + 1]
    if not d:
        return lead or unit[n], "sym"
    if d > "\u2fff" and _CJK.match(d):
        return lead + unit[k : k + 2], (lead[:1] or "") + "C"
    number = d.isdigit()
    words = unit[k : k + 24].split(None, 2)
    word = " ".join(words[: 1 + number]).rstrip(",;:.!?")
    if number or not word.isalpha():
        word = _DIGITS.sub("0", word)
    return lead + word, (lead[:1] or "") + ("0" if number else "U" if d.isupper() else "l" if d.islower() else "o")


def word_key(token: str) -> str:
    """Form of a word wherever it stands: without marks behind it, digits alike."""
    return _DIGITS.sub("0", token.rstrip(",;:.!?…。！？।؟۔、，"))[-20:]


def count_words(text: str, into: Counter) -> None:
    """All words of a text as they stand (``word_key`` is applied to the types), and all pairs of characters that are not spaced."""
    runs = _UNSPACED.findall(text)
    if runs:
        for run in runs:
            into.update(map("".join, zip(run, run[1:])))
        text = _UNSPACED.sub(" ", text)
    into.update(text.split())


def word_gaps(text: str, a: int, b: int) -> tuple[list[tuple[int, int, str, str]], bool]:
    """Places between the words of a unit without punctuation: (end, start, left key, right key); whether words are not spaced."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    out, unspaced = [], 0
    for (s1, e1), (s2, e2) in zip(tokens, tokens[1:]):
        left, right = text[s1:e1], text[s2:e2]
        if e1 - s1 == 1 and _CJK.match(left):
            left = text[max(a, e1 - 2) : e1]
        if e2 - s2 == 1 and _CJK.match(right):
            right = text[s2 : s2 + 2]
            unspaced += 1
        out.append((e1, s2, word_key(left), word_key(right)))
    return out, unspaced * 2 > len(out)


def _context(unit: str, begin: int, s: int, closer: str) -> tuple[str, str, bool]:
    """Last word and last two words before ``s``, and whether nothing else stands since ``begin``."""
    left = unit[max(begin, s - 48) : s].rstrip(" \u00a0\u202f") if s > begin else ""
    last = left[-1:]
    if last > "\u2fff" and _CJK.match(last) or (left and not closer and last in "”」』）》】"):
        w1, w2, alone = left[-2:], left[-4:], s - begin <= 3
    else:
        words = left.rsplit(None, 2)
        w1, w2, alone = words[-1] if words else "", " ".join(words[-2:]), len(words) <= 1
    if _DIGITS.search(left):
        w1, w2 = _DIGITS.sub("0", w1), _DIGITS.sub("0", w2)
    return w1[-20:], w2[-32:], alone


def gaps(text: str, a: int, b: int, body: int, ascii_marks: bool = True, thai: bool | None = None, emoji: bool | None = None) -> tuple[list[Gap], bool, tuple | None]:
    """Of one unit: its gaps at marks and Thai spaces, whether it has no punctuation at all (see ``word_gaps``), keys of its end.

    ``thai``, ``emoji``: whether the text has any, where the caller knows."""
    unit = text[a:b]
    off = body - a
    thai = THAI.search(unit) is not None if thai is None else thai
    emoji = _EMOJI.search(unit) is not None if emoji is None else emoji
    zones, closes = guarded(unit)
    merged: list[tuple[int, int]] = []
    if zones or closes:
        for s, e in sorted(zones + [(o, c + 1) for c, o in closes.items()]):
            if merged and s < merged[-1][1]:
                if e > merged[-1][1]:
                    merged[-1] = (merged[-1][0], e)
            else:
                merged.append((s, e))
    found: list[Gap] = []
    final = None
    size = len(unit)
    z = 0
    begin = off  # start of the last possible sentence
    begun_sure = True
    bare = True
    for m in (_MARKS_OR_THAI if thai else _MARKS).finditer(unit, off):
        bare = False
        s, e = m.span()
        marks = m.group()
        space = marks.isspace()
        if not space:
            if not ascii_marks and not any(c in WIDE_MARKS for c in marks):
                continue
            if ";" in marks and not (s and "Ͱ" <= unit[s - 1] <= "῿"):
                marks = marks.replace(";", "")
                if not marks.strip():
                    continue
        g, x = s if space else e, None
        while not space and (closes or emoji):  # closers and emoji after the mark
            g = k = e
            while k < size and unit[k] in " \u00a0\u202f":
                k += 1
            if k in closes and (k == e or unit[k] == "»") and closes[k] < s:
                e = k + 1
                continue
            x = _AFTER.match(unit, e) if emoji else None
            if x:
                e = x.end()
                continue
            break
        while z < len(merged) and merged[z][1] <= s:
            z += 1
        closer = ""
        opened_at = None
        if z < len(merged) and merged[z][0] <= s < merged[z][1]:
            if space or merged[z][1] > e:
                continue  # inside a quotation, bracket, code or formula that goes on
            if merged[z][1] - 1 not in closes:
                continue
            closer = unit[merged[z][1] - 1]
            opened_at = merged[z][0]
        n = e
        while n < size and (unit[n] in _WS or unit[n].isspace()):
            n += 1
        if space:
            kind = SPACE
        elif len(marks) == 1:
            kind = "…" if marks in "…‥" else marks
        else:
            kind = "…" if all(c in ".…‥ \u00a0\u202f" for c in marks) else next((c for c in marks if c in "!?！？؟"), marks.strip()[:1])
        # an end mark that opens a word (.gitignore) or stands alone does not end one
        w1, w2, alone = _context(unit, begin, s, closer)
        if not w1 and n < size and n == e:
            continue
        qs = ("q" if opened_at is not None and opened_at <= begin else "") + closer
        emo = "e" if emoji and e > m.end() and _AFTER.search(unit, m.end(), e) else ""
        first = (1 if begun_sure else 2) if alone else 0
        tail = f"|{kind}{qs}"
        keys3 = (w2 + tail, w1 + tail, f"{_shape(w1)}{tail}{emo}")
        if n >= size:
            final = (*keys3, first)
            continue
        nxt = unit[n]
        if nxt in CONTINUES:
            continue
        if n == e and not closer and not emo and not space:
            wide_mark = any(c in WIDE_MARKS for c in marks)
            if not wide_mark and not _CJK.match(nxt):
                continue  # 3.14, notes.md, a?b
            if not wide_mark and kind == "." and s and unit[s - 1].isascii() and unit[s - 1].isalnum():
                continue
        found.append(Gap(a + g, a + n, (*keys3, *first_word(unit, n)), first))
        begin, begun_sure = n, False
    if thai and final is None and THAI.match(unit[-1]):  # a Thai unit's end is one like its spaces
        w1, w2, alone = _context(unit, begin, size, "")
        tail = "|" + SPACE
        final = (w2 + tail, w1 + tail, _shape(w1) + tail, (1 if begun_sure else 2) if alone else 0)
    return found, bare and not merged and _PUNCTUATION.search(unit, off) is None, final
