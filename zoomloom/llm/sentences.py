"""Sentence units across languages and scripts: candidate boundaries, classified with maximum-entropy features.

Plan
1. A text becomes lines, lines become paragraphs (hard wraps are undone, page headers set aside, a paragraph that
   a header cuts in two is put together again).
2. Each paragraph yields candidate boundaries: end marks with the quotation marks, brackets and note marks that close after
   them, and blanks in scripts that use no end marks. Candidates inside quotations and brackets are none.
3. Candidates go to a maximum-entropy model over the neighbouring tokens, their case, length, digits and script, and over whether mark and
   surroundings follow a shape that leaves no doubt (for instance a question mark before a blank and a capital).
4. The model is fitted on reliable boundaries of the corpus itself: paragraph ends set against paragraph starts, and sure marks,
   against candidates followed by lower case, those inside brackets, and those after tokens that never end or before tokens that
   never start a paragraph. Ends are paired with starts of their own script. The fit uses a bounded sample (TRAIN_DOCS
   documents, and of a script with fewer than SCRIPT_DOCS among them up to SCRIPT_DOCS); every document is segmented whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoomloom.session import check_names, widen

TRAIN_DOCS = 2_000
SCRIPT_DOCS = 500  # a script with a small share of the texts is sampled up to so many
SCRIPT_HEAD = 400  # code points of a text that tell its script, for the sample
MOST_ROWS = 50_000
EPOCHS = 16
BATCH = 4096
SEED = 11

_LINE = re.compile("[^\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]+")
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_HEADERS = [
    re.compile(r"[\[(（]?\s*(?:page|pg\.?|seite|pág(?:ina|\.)?|стр(?:аница|\.)?|σελ(?:ίδα|\.)?|صفحة|पृष्ठ|หน้า|p\.)\s*\d+(?:\s*(?:of|von|de|sur|из|/)\s*\d+)?\s*[\])）]?", re.I),
    re.compile(r"[—–-]\s*\d+\s*[—–-]"),
    re.compile(r"[（(]?\s*第?\s*\d+\s*[頁页]\s*[)）]?"),
    re.compile(r"(?:\w{1,6}\.? )?[A-Z]{1,3} \d+/\d{4}\s*(?:\|\s*\D{0,12}\d+|\s{2,}\d+)"),
]
_OPENER = re.compile(r"(?:[§¶]+\s*)?(?:[\[(（]\s*(?:\d{1,4}|[ivxlcIVXLC]{1,6}|[一二三四五六七八九十]{1,3})\s*[\])）][.、:]?|(?:\d{1,4}|[IVXLC]{1,6}|[一二三四五六七八九十]{1,3})(?:[.、．)]|(?=\s+[^\sa-zß-öø-ÿ]))(?!\S*[0-9]))\s*")
_NOTE = re.compile(r"\s{4,}|\t\t|~{3}|<\|?\w+\|?>")
_NUMBERED = re.compile(r"(?:[§¶]+\s*\d|[\[(（]\s*\d{1,4}\s*[\])）]|\d{1,4}[.、．]?\s+\S|\d{1,4}、)")
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "【": "】", "‹": "›", "〈": "〉"}
_CLOSE = {v: k for k, v in _PAIRS.items()}
_OPENS = {*_PAIRS, "„", '"'}
_SPAN_CHARS = re.compile("[“”„\"«»「」『』()（）\\[\\]《》【】‹›〈〉]")
_MARK = re.compile(
    "([.!?…؟।॥。！？．]+(?![0-9])|;)"
    "((?:[   ]?[»›]|[”“\"’'」』)）\\]】》]|[⁰¹²³⁴-⁹*†‡]+(?=\\s|$)|\\[\\d{1,3}\\])*)"
)
_THAI_GAP = re.compile("[฀-๿”“\"»)\\]*_█▇xX…][  ]+(?=[ก-๎])")
_THAI = re.compile("[ก-๎]")
_CONTENT = re.compile(r"[^\W_]")
_GLUED = re.compile(r"^.*[^\W\d_A-Z]{4,}[.!?]")
_WORD = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_OPENING = "“„«「『(（[《【‹"
_LEAD = "“„«\"'‘(（[「『¿¡"
_LEAD_BLANKS = _LEAD + " \u00a0\u202f"
_GOES_ON = set(",;:،；，、·)]}»”–—-/%&=+|")
_STRONG = set("!?؟।॥。！？")


def is_header(line: str) -> bool:
    return len(line) < 60 and (line[-1].isdigit() or line[-1] in "])）頁页—–-") and any(h.fullmatch(line) for h in _HEADERS)


def numbered_headers(lines: list[str]) -> set[str]:
    """Lines that come again on the next page: alike but for their numbers, the last of which counts on by one."""
    alike: dict[str, list[str]] = {}
    for t in lines:
        if len(t) < 60 and _DIGITS.search(t) and not _NUMBERED.match(t) and _ends_open(t):
            alike.setdefault(_DIGITS.sub("0", t), []).append(t)
    out = set()
    for ts in alike.values():
        last = [int(_DIGITS.findall(t)[-1][-9:]) for t in ts]
        out |= {t for i, t in enumerate(ts) if i and last[i] == last[i - 1] + 1 or i + 1 < len(ts) and last[i + 1] == last[i] + 1}
    return out


def _has_content(s: str) -> bool:
    return s[:1].isalpha() or _CONTENT.search(s) is not None


class Paragraph:
    """Lines of one paragraph: [start, end) with the parts that are not its own (page headers)."""

    __slots__ = ("start", "end", "holes", "kind", "lines")

    def __init__(self, start, end, kind, lines=1):
        self.start, self.end, self.kind, self.lines, self.holes = start, end, kind, lines, []

    def body(self, text: str) -> str:
        if not self.holes:
            return text[self.start : self.end]
        out, at = [], self.start
        for a, b in self.holes:
            out += [text[at:a], " " * (b - a)]
            at = b
        out.append(text[at : self.end])
        return "".join(out)


def _ends_open(s: str) -> bool:
    """No end mark at the end of s."""
    s = s.rstrip("”“\"’'»›」』)）]】》   ⁰¹²³⁴⁵⁶⁷⁸⁹*†‡")
    return not s or s[-1] not in ".!?…؟।॥。！？．;"


def paragraphs(text: str) -> list[Paragraph]:
    """Paragraphs of a text, hard wraps undone; kinds are 'text', 'header', 'note' (of a scanner) and 'mark' (no letter or digit)."""
    lines = []
    for m in _LINE.finditer(text):
        s = m.group()
        t = s.strip()
        if t:
            a = m.start() + len(s) - len(s.lstrip())
            lines.append((a, a + len(t), t))
    if not lines:
        return []
    gaps = [b[0] - a[1] > 1 and len(_BREAK.findall(text, a[1], b[0])) > 1 for a, b in zip(lines, lines[1:])]
    # blank lines around page headers say nothing about the layout of the rest
    short = [t for _, _, t in lines if len(t) < 60 and _DIGITS.search(t)]
    again = numbered_headers(short) if len(short) > 1 else ()
    head = [len(t) < 60 and (t in again or is_header(t)) for _, _, t in lines]
    apart = [g for g, a, b in zip(gaps, head, head[1:]) if not a and not b]
    spaced = sum(apart) >= max(1, 0.04 * len(apart))
    widths = [len(t) for _, _, t in lines]
    widest = max(widths)
    out: list[Paragraph] = []
    for i, (a, b, t) in enumerate(lines):
        kind = "header" if head[i] else "mark" if not _has_content(t) else "note" if len(t) < 80 and _NOTE.search(t) else "text"
        if i and not gaps[i - 1] and kind != "header" and out[-1].kind == "text" and (kind == "text" or spaced):
            before = lines[i - 1][2]
            go = spaced and (len(before) <= 130 or t[0].islower())
            if not go and 50 <= widest <= 130:
                first = 1 if _CJK.match(t) else len(_WORD.match(t).group())
                go = len(before) + 1 + first > widest - (2 if first == 1 else 0) and _ends_open(before)
            if go:
                out[-1].end = b
                out[-1].lines += 1
                continue
        out.append(Paragraph(a, b, kind))
    for p in out:
        if p.kind == "text" and 1 < p.lines <= 3 and p.end - p.start < 60:
            words = text[p.start : p.end].split()
            if is_header(" ".join(words)) or is_header(" ".join(words[:-1]) + "  " + words[-1]):
                p.kind = "header"  # a header that was wrapped itself
    return out


def _spans(body: str) -> list[tuple[int, int]]:
    """(open, close) of quotations and brackets that do close; in order of opening, outermost only."""
    first = _SPAN_CHARS.search(body)
    if first is None:
        return []
    waits: dict[str, list[int]] = {}  # a stack a sign: no search, so no bound on the depth
    found = []
    for m in _SPAN_CHARS.finditer(body, first.start()):
        c, at = m.group(), m.start()
        if c == "“" and waits.get("„") or c == '"' and waits.get('"'):
            want = "„" if c == "“" else '"'
        elif c in _OPENS:
            waits.setdefault(c, []).append(at)
            continue
        elif c == "”" and not waits.get("“") and waits.get("„"):
            want = "„"
        else:
            want = _CLOSE.get(c)
        if want and waits.get(want):
            start = waits[want].pop()
            found.append((start, at))
            for w in waits.values():  # what opened inside and still waits never closes
                while w and w[-1] > start:
                    w.pop()
    found.sort()
    outer = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _shape(tok: str) -> str:
    if not tok:
        return "none"
    core = tok.strip("”“\"'«»()[]（）")
    if not core:
        return "punct"
    if core[0].isdigit():
        if core.isdigit():
            return f"d{min(len(core), 4)}"
        return "date" if core.count(".") == 2 else "num"
    if "." in core[:-1]:
        return "dotted"
    letters = [c for c in core if c.isalpha()]
    if len(letters) == 1:
        return "one" + ("U" if letters[0].isupper() else "l")
    if not letters:
        return "sym"
    if letters[0].isupper():
        return "UU" if letters[-1].isupper() else "Ul"
    return "ll" if letters[0].islower() else "oo"


def _plain(w: str) -> str:
    w = w.rstrip(",;:.)]”»“")
    if w.isalpha():
        return "I" if len(w) == 1 and w.isupper() else w  # initials are alike
    return _DIGITS.sub("0", w)


def _cjk(c: str) -> bool:
    """Whether a text starts with a character of the scripts of `_CJK`."""
    return c > "\u303f" and _CJK.match(c) is not None


def _start_token(after: str) -> tuple[str, str]:
    """Normal form of the first and second token of what follows."""
    after = after.lstrip()
    if not after:
        return "", ""
    lead, rest = "", after
    if after[0] in _LEAD:
        lead, rest = after[0], after.lstrip(_LEAD_BLANKS)
    if rest > "\u0e00":
        if _cjk(rest):
            return lead + rest[:2], rest[2:4]
        if rest[0] <= "\u0e7f":
            return lead + rest[:8].split(" ")[0], ""
    parts = rest[:60].split(None, 2)
    if not parts:
        return lead, ""
    return lead + _plain(parts[0])[:16], _plain(parts[1])[:16] if len(parts) > 1 else ""


def _end_tokens(before: str) -> tuple[str, str]:
    """Last and last but one token of what stands before a mark."""
    tail = before[-48:]
    c = tail[-1:]
    if c >= "\u0e00":
        if _cjk(c):
            return tail[-2:], tail[-4:-2]
        if c <= "\u0e7f":
            return tail[-8:].rsplit(" ", 1)[-1], ""
    parts = tail.rsplit(None, 2)
    if not parts:
        return "", ""
    last = parts[-1]
    if "." in last:
        last = _GLUED.sub("", last)
    return last.lstrip(_LEAD)[-20:], parts[-2].lstrip(_LEAD)[-16:] if len(parts) > 1 else ""


def _script(c: str) -> str:
    if not c or c < "\u0370":
        return "L"
    return "T" if "\u0e00" <= c <= "\u0e7f" else "D" if "\u0900" <= c <= "\u097f" else "A" if "\u0600" <= c <= "\u06ff" else "C" if _CJK.match(c) else "G" if c <= "\u03ff" else "R" if c <= "\u04ff" else "L"


_SCRIPTS = {"T": "ก-๎", "D": "\u0900-\u097f", "A": "\u0600-\u06ff", "C": "぀-ヿ㐀-鿿豈-﫿", "G": "Ͱ-Ͽ", "R": "\u0400-\u04ff"}


def _script_at(s: str) -> str:
    """Script of the first letter of s; marks and digits belong to no script."""
    for c in s:
        if c.isalpha():
            return _script(c)
    return "L"


def left_features(p: str, pp: str, mark: str) -> tuple[list[str], str, str, str]:
    """Features of the last two tokens before a mark; normal form and shape of the last, and the kind of the mark."""
    pn, ps = "I" if len(p) == 1 and p.isupper() else _DIGITS.sub("0", p), _shape(p)
    kind = mark if len(mark) == 1 else ".." if mark == ".." else "…"
    return [f"p{kind}{pn}", f"s{kind}{ps}", f"q{_DIGITS.sub('0', pp)}", f"l{min(len(p), 6)}{kind}"], pn, ps, kind


def right_features(n: str, nn: str) -> tuple[list[str], str, str]:
    """Features of the first two tokens after a mark; normal form and shape of the first."""
    lead = n[:1] if n[:1] in _LEAD else ""
    ns = (lead and "q") + _shape(n[len(lead) :])
    return [f"n{n}", f"t{ns}", f"u{nn}", f"nu{n}|{nn}"], n, ns


def shape_features(ps: str, ns: str, kind: str, closer: str, gap: bool, script: str, sign: bool) -> list[str]:
    return ["b", f"m{kind}{script}", f"st{ps}{ns}", f"c{closer}{ns}", f"g{gap}{ps}{ns}", f"r{sign}"]


_left_known, _right_known = functools.lru_cache(50_000)(left_features), functools.lru_cache(50_000)(right_features)


def features(before: str, mark: str, closers: str, gap: bool, after: str, sign: bool = False) -> list[str]:
    """All features of a candidate; sign tells whether mark and surroundings follow one of the shapes that `candidates` calls sure."""
    left, pn, ps, kind = _left_known(*_end_tokens(before), mark)
    right, n, ns = _right_known(*_start_token(after))
    return [*left, *right, *shape_features(ps, ns, kind, closers[-1:], gap, _script(after.lstrip()[:1]), sign), f"pt{pn}|{ns}", f"sn{ps}|{n}"]


class Candidate:
    __slots__ = ("at", "sure", "args", "inner")

    def __init__(self, at, sure, args, inner=False):
        self.at = at
        self.sure = sure
        self.args = args
        self.inner = inner


def candidates(body: str, inner: bool = False) -> list[Candidate]:
    """Candidates of a paragraph by position. sure is True (the shape leaves no doubt), False (no boundary) or None; the model decides on all but False.

    inner: also those that are none beyond doubt, such as those inside brackets and quotations (for training).
    """
    spans = _spans(body)
    opens = {a for a, _ in spans}
    opener = _OPENER.match(body)
    skip = opener.end() if opener else 0
    out = []
    k = 0
    size = len(body)
    for m in _MARK.finditer(body):
        at, end = m.span()
        if at < skip or end >= size:
            continue
        nxt = body[end]
        if not inner and nxt == " " and body[end + 1].islower() and m.group(1) != ";" and not m.group(2):
            continue  # goes on beyond doubt
        mark, closers = m.groups()
        if closers and opens:  # a sign that opens what follows does not close this
            for j in range(m.start(2), end):
                if j in opens and body[j] in '“"':
                    end, closers = j, body[m.start(2) : j]
                    break
        nxt = body[end]
        if not inner and (nxt in ",;:" or nxt == " " and body[end + 1].islower()):
            continue  # goes on beyond doubt
        blank = nxt.isspace()
        while k < len(spans) and spans[k][1] < at:
            k += 1
        inside = k < len(spans) and spans[k][0] < at and spans[k][1] >= end
        if mark == ";":
            if not ("Ͱ" <= body[max(0, at - 1)] <= "Ͽ" or "ἀ" <= body[max(0, at - 1)] <= "῿" or body[max(0, at - 1)].isdigit() and re.search("[Ͱ-Ͽ]", body[max(0, at - 60) : at])) or not (blank or nxt.isupper()):
                continue
        if inside:
            if inner and blank and mark != ";":
                out.append(Candidate(end, False, (body[max(0, at - 48) : at], mark, "", True, body[end : end + 60]), True))
            continue
        rest = body[end : end + 60]
        ahead = rest.lstrip() if blank else rest
        if not ahead:
            continue
        c = ahead[0]
        none = c.islower() or c in _GOES_ON and not (c in "-–—" and blank and len(ahead) > 1 and ahead[1].isalpha())
        if none and not inner:
            continue
        before = body[max(0, at - 48) : at]
        args = (before, mark, closers, blank, rest)
        if none:
            out.append(Candidate(end, False, args))
            continue
        cjk = mark[0] in "。！？．" or _cjk(c) or _cjk(before[-1:])
        if cjk and not blank:
            if (mark[0] in "。！？" or mark[0] == "．" and not nxt.isdigit()) and not closers:
                out.append(Candidate(end, True, args))
            elif mark[0] in "!?" and not closers and _cjk(before[-1:]):
                out.append(Candidate(end, True, args))
            continue
        if not blank:
            if closers and closers[-1] == "]" and c.isupper():
                pass
            elif mark in ("!", "?", "؟", "।") and not closers and (c.isupper() or c in _OPENING):
                out.append(Candidate(end, True, args))
                continue
            elif not (c.isupper() or c in _OPENING or c in "¿¡") and not (c.isalpha() and not c.isupper()):
                continue
            elif mark == "." and (len(_end_tokens(before)[0]) < 3 or "." in _end_tokens(before)[0] or len(ahead) < 2 or not (ahead[1].islower() or ahead[1] in " '’.")) and c.isupper():
                continue
            elif c.isalpha() and not c.isupper() and (mark == "." and len(_end_tokens(before)[0]) < 3):
                continue
        if mark[-1] in _STRONG and not closers:
            out.append(Candidate(end, True, args))
            continue
        out.append(Candidate(end, None, args))
    if _THAI.search(body):
        k = 0
        for m in _THAI_GAP.finditer(body):
            at, end = m.start() + 1, m.end()
            if at <= skip:
                continue
            while k < len(spans) and spans[k][1] < m.start():
                k += 1
            inside = k < len(spans) and spans[k][0] < at and spans[k][1] >= end
            args = (body[max(0, at - 48) : at], " ", "", True, body[end : end + 60])
            if not inside:
                out.append(Candidate(at, None, args))
            elif inner:
                out.append(Candidate(at, False, args, True))
        out.sort(key=lambda c: c.at)
    return out


class Model:
    """Weights by feature; the score of a candidate is their sum.

    Sums of features are kept by all that these features read: the tokens before and the mark, the tokens after, and the shapes of both sides.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.left: dict[tuple, tuple] = {}
        self.right: dict[tuple, tuple] = {}
        self.shapes: dict[tuple, float] = {}
        self.cuts: dict[str, list[tuple[int, int]]] = {}

    def _sum(self, names: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in names])

    def boundary(self, args: tuple, sign: bool = False) -> bool:
        """Whether the score is positive."""
        before, mark, closers, gap, after = args
        key = (*_end_tokens(before), mark)
        left = self.left.get(key)
        if left is None:
            if len(self.left) > 100_000:
                self.left.clear()
            names, pn, ps, kind = left_features(*key)
            left = self.left[key] = (self._sum(names), pn, ps, kind, {})
        key = _start_token(after)
        right = self.right.get(key)
        if right is None:
            if len(self.right) > 100_000:
                self.right.clear()
            names, n, ns = right_features(*key)
            right = self.right[key] = (self._sum(names), n, ns, {})
        one, pn, ps, kind, by_start = left
        two, n, ns, by_end = right
        c = after[1:2] if after[:1] == " " else after[:1]
        if c.isspace():
            c = after.lstrip()[:1]
        key = (ps, ns, kind, closers[-1:], gap, "L" if c < "\u0370" else _script(c), sign)
        three = self.shapes.get(key)
        if three is None:
            if len(self.shapes) > 100_000:
                self.shapes.clear()
            three = self.shapes[key] = self._sum(shape_features(*key))
        four, five = by_start.get(ns), by_end.get(ps)
        if four is None:
            four = by_start[ns] = self.weights.get(f"pt{pn}|{ns}", 0.0)
        if five is None:
            five = by_end[ps] = self.weights.get(f"sn{ps}|{n}", 0.0)
        return one + two + three + four + five > 0


def _cut_in_two(text: str, a: Paragraph, b: Paragraph, model: Model) -> bool:
    """Whether b goes on where a page header broke a off."""
    one, two = a.body(text), text[b.start : b.end]
    c = two[0]
    if c in ",;:)]»”）」』、，。&":
        return True
    opened = [p for p in _SPAN_CHARS.finditer(one)]
    if opened:
        depth = _open_at_end(one)
        if depth and depth in two and not _NUMBERED.match(two):
            return True
    prose = a.lines > 1 or len(one) > 60 or bool(_NUMBERED.match(one))
    if _ends_open(one):
        if c.islower():
            return prose or not one[-1] in ",:"
        if not prose or "฀" <= c <= "๿":
            if prose and "฀" <= one[-1] <= "๿" or one[-1].isdigit() and "฀" <= c <= "๿":
                return not model.boundary((one[-48:], " ", "", True, two[:60])) and not _NUMBERED.match(two)
            return False
        return not (_NUMBERED.match(two) and _NUMBERED.match(one) and re.match(r"(?:[§¶]+\s*\d|[\[(（]\s*\d|\d{1,4}[.、．]\s|\d{1,4}\s+[^\W\d_])", two) and one[-1] in ".")
    if c.islower():
        return True
    m = None
    for m in _MARK.finditer(one):
        pass
    if m is None or m.end() < len(one) or m.group(1)[-1] in _STRONG or m.group(1) == "．" or _NUMBERED.match(two) and not two[:1].isdigit():
        return False
    return prose and not model.boundary((one[: m.start()][-48:], m.group(1), m.group(2), True, two[:60])) and not (two[:1].isdigit() and re.match(r"\d{1,4}[.、．]?\s+[^\W\d_]", two) and m.group(1) == "." and _shape(_end_tokens(one[: m.start()])[0]) not in ("dotted", "oneU"))


def _open_at_end(body: str) -> str:
    """The closing sign that a paragraph still waits for, '' if none."""
    stack = []
    for m in _SPAN_CHARS.finditer(body):
        c = m.group()
        if c == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif c in _PAIRS or c == "„":
            stack.append(c)
        elif stack and (_CLOSE.get(c) == stack[-1] or c == "”" and stack[-1] == "„"):
            stack.pop()
    return "" if not stack else "“" if stack[-1] == "„" else _PAIRS[stack[-1]]


def assemble(text: str, model: Model) -> list[Paragraph]:
    """Paragraphs with the headers that cut them put inside."""
    parts = paragraphs(text)
    out: list[Paragraph] = []
    i = 0
    while i < len(parts):
        p = parts[i]
        if p.kind == "header" and out and out[-1].kind == "text":
            j = i
            while j < len(parts) and parts[j].kind == "header":
                j += 1
            if j < len(parts) and parts[j].kind == "text" and _cut_in_two(text, out[-1], parts[j], model):
                a, b = out[-1], parts[j]
                a.holes.append((a.end, b.start))
                a.end = b.end
                a.lines += b.lines
                i = j + 1
                continue
            out.extend(parts[i:j])
            i = j
            continue
        out.append(p)
        i += 1
    return out


def _cut(body: str, model: Model) -> list[tuple[int, int]]:
    """Units of one paragraph."""
    out = []
    last = 0
    for at in [*[c.at for c in candidates(body) if c.sure is not False and model.boundary(c.args, bool(c.sure))], len(body)]:
        piece = body[last:at]
        if _has_content(piece):
            out.append((last + len(piece) - len(piece.lstrip()), last + len(piece.rstrip())))
            last = at
    return out


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """[start, end) of every sentence unit of a text, in code points."""
    out = []
    for p in assemble(text, model):
        if p.kind == "mark":
            continue
        if p.kind in ("header", "note"):
            out.append((p.start, p.end))
            continue
        body = p.body(text)
        cuts = model.cuts.get(body)  # nothing else decides, so what a worker saw before changes no result
        if cuts is None:
            if len(model.cuts) > 20_000:
                model.cuts.clear()
            cuts = model.cuts[body] = _cut(body, model)
        out += [(p.start + a, p.start + b) for a, b in cuts]
    return out


def labelled(texts: list[str], rng: np.random.Generator, most: int = MOST_ROWS) -> dict[tuple[str, bool], list[tuple]]:
    """Arguments of reliable boundaries (True) and of places that are none (False) by (script, label), at most `most` of each."""
    ends: list[tuple] = []  # (before, mark, closers) of paragraph ends
    starts: dict[str, list[str]] = {}
    good: list[tuple] = []
    bad: list[tuple] = []
    unsure: list[tuple] = []
    ends_of, inside_of, starts_of, within_of = Counter(), Counter(), Counter(), Counter()
    known: dict[str, list[Candidate]] = {}  # paragraphs of the sample, many of which repeat
    for t in texts:
        parts = paragraphs(t)
        for i, p in enumerate(parts):
            if p.kind != "text":
                continue
            cut_before = i > 0 and parts[i - 1].kind == "header"
            cut_after = i + 1 == len(parts) or parts[i + 1].kind == "header"
            body = p.body(t)
            m = _OPENER.match(body)
            if p.lines == 1 and len(body) < 60 and not (m and m.end() < len(body) and _NUMBERED.match(body)):
                for c in candidates(body):  # captions and the like: where blanks are the only marks, they tell what follows one without starting anything
                    if c.sure is None and c.args[1] == " ":
                        inside_of[_end_tokens(c.args[0])[0]] += 1
                        within_of[_start_token(c.args[4])[0]] += 1
                        unsure.append(c.args)
                continue
            thai = "฀" <= body[-1] <= "๿"
            if _ends_open(body) and not thai:
                continue
            lead = body[m.end() :] if m else body
            if not cut_before:
                starts.setdefault(_script_at(lead[:60]), []).append(lead[:60])
                starts_of[_start_token(lead)[0]] += 1
            if cut_after:
                pass
            elif thai:
                ends.append((body[-48:], " ", ""))
            else:
                last = None
                for last in _MARK.finditer(body, max(0, len(body) - 40)):
                    pass
                if last is not None and last.end() == len(body) and (last.group(1) != ";"):
                    ends.append((body[: last.start()][-48:], last.group(1), last.group(2)))
                    ends_of[_end_tokens(body[: last.start()])[0]] += 1
            told = known.get(body)
            if told is None:
                told = known[body] = candidates(body, inner=True)
            for c in told:
                p_, n_ = _end_tokens(c.args[0])[0], _start_token(c.args[4])[0]
                inside_of[p_] += 1
                within_of[n_] += 1
                if c.inner:
                    if c.args[1] not in ("!", "?", "؟", "।", "。"):
                        unsure.append(c.args)
                elif c.sure is None:
                    unsure.append(c.args)
                else:
                    (good if c.sure else bad).append((*c.args, bool(c.sure)))
    for a in unsure:  # tokens that are common here but never end, or never start, a paragraph
        p_, n_ = _end_tokens(a[0])[0], _start_token(a[4])[0]
        never_ends = a[1] == "." and inside_of[p_] >= (4 if p_[:1].islower() else 12) and ends_of[p_] <= inside_of[p_] / 60 and _shape(p_)[0] != "d" and _shape(p_) != "num"
        never_starts = within_of[n_] >= 12 and starts_of[n_] <= within_of[n_] / 60 and n_[:1] not in _LEAD and len(n_) > 1 and not n_[0].isdigit()
        if never_ends or never_starts:
            bad.append(a)
    # ends and starts of one script go together; mixed pairs teach nothing
    good = [a for a in good if _script_at(a[0][::-1]) == _script_at(a[4])]
    for a in ends:
        own = starts.get(_script_at(a[0][::-1]), [])
        good += [(*a, True, own[int(rng.integers(len(own)))]) for _ in range(2 if own else 0)]
    kinds: dict[tuple[str, bool], list[tuple]] = {}
    for label, rows in ((True, good), (False, bad)):
        for a in rows:
            kinds.setdefault((_script_at(a[0][::-1]), label), []).append(a)
    return {k: [v[i] for i in rng.permutation(len(v))[:most]] for k, v in kinds.items()}


def fit(texts: list[str], most: int = MOST_ROWS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Maximum-entropy model from reliable boundaries of the texts; at most `most` labelled rows of either label in every script."""
    rng = np.random.default_rng(seed)
    kinds = labelled(texts, rng, most)
    if not kinds:
        return Model({"b": -1.0})
    code: dict[str, int] = {}
    rows = [[code.setdefault(f, len(code)) for f in features(*a)] for v in kinds.values() for a in v]
    index = np.array(rows, dtype=np.int32)
    y = np.array([float(label) for (_, label), v in kinds.items() for _ in v])
    of = Counter()  # both labels weigh alike in every script, so that the rows of one do not shift another
    for (s, _), v in kinds.items():
        of[s] += len(v)
    weight = [0.5 * of[s] / len(v) for (s, _), v in kinds.items() for _ in v]
    del rows, kinds
    often = np.bincount(index.ravel()) > 1
    names = {f: i for i, f in enumerate(f for f, c in code.items() if often[c])}
    place = np.full(len(code), len(names), dtype=np.int32)
    place[often] = np.arange(len(names))
    index = place[index]
    width = index.shape[1]
    share = np.array(weight)
    w = np.zeros(len(names) + 1)
    speed = np.full(len(w), 1e-8)
    n = len(y)
    for _ in range(epochs):  # Adagrad over small batches
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            part = order[at : at + BATCH]
            rows_ = index[part]
            g = (1 / (1 + np.exp(-np.clip(w[rows_].sum(1), -30, 30))) - y[part]) * share[part] / len(part)
            grad = np.bincount(rows_.ravel(), weights=np.repeat(g, width), minlength=len(w))
            grad[-1] = 0
            speed += grad * grad
            w -= 0.2 * grad / np.sqrt(speed)
    return Model({f: float(w[i]) for f, i in names.items() if math.fabs(w[i]) > 1e-4})


def training_texts(df: DataFrame, ident: str, text: str, docs: int = TRAIN_DOCS) -> list[str]:
    """About `docs` texts and, of every script with fewer than SCRIPT_DOCS among them, about SCRIPT_DOCS (all, if there are no more).

    Picked by a hash of the id, at most twice as many; the bound of the fit.
    """
    body = F.col(text).cast("string")
    head = F.substring(body, 1, SCRIPT_HEAD)
    # the middle one of all letters of these scripts; texts with few of them are not looked at
    known = F.regexp_replace(head, f"[^{''.join(_SCRIPTS.values())}]+", "")
    middle = F.substring(known, (F.length(known) / 2 + 1).cast("int"), 1)
    script = F.when(F.octet_length(head) < 1.3 * F.length(head), "L").otherwise(functools.reduce(lambda rest, e: F.when(middle.rlike(f"[{e[1]}]"), e[0]).otherwise(rest), _SCRIPTS.items(), F.lit("L")))
    some = df.where(body.isNotNull())
    count = {r["s"]: r["count"] for r in some.groupBy(script.alias("s")).count().collect()}
    total = sum(count.values())
    want = {s: max(SCRIPT_DOCS, docs * n // total) for s, n in count.items()}
    if not want:
        return []
    step = {s: max(1, n // want[s]) for s, n in count.items()}
    chance = F.xxhash64(ident)
    any_ = functools.reduce(lambda a, b: a | b, [F.pmod(chance, F.lit(k)) == 0 for k in sorted(set(step.values()))])  # cheap, so first
    own = F.element_at(F.create_map(*[F.lit(x) for pair in step.items() for x in pair]), script)
    rows = some.where(any_).where(F.pmod(chance, own) == 0).select(body.alias("t")).limit(2 * sum(want.values()))
    return [t for t in sorted(rows.toArrow()["t"].to_pylist()) if t.strip()]


def sentence_units(df: DataFrame, ident: str, text: str, model: Model | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(ident, start_char, end_char): one row for each sentence unit of each text; offsets in code points, end exclusive.

    Units have no white space at either end and do not overlap. Null, empty and blank texts, and lines without a letter or digit,
    give no rows. Texts of any length are divided whole. Without a model one is fitted on a bounded sample of the texts.
    """
    check_names(ident, "start_char", "end_char")
    model = model or fit(training_texts(df, ident, text, train_docs))
    weights = model.weights

    def run(batches):
        own = Model(weights)
        for b in batches:
            ids = b.column(0)
            rows, start, end = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    for s, e in units(t, own):
                        rows.append(i)
                        start.append(s)
                        end.append(e)
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[ident, "start_char", "end_char"])
                    rows, start, end = [], [], []
            if rows:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[ident, "start_char", "end_char"])

    kind = df.schema[ident].dataType.simpleString()
    return widen(df.select(F.col(ident), F.col(text).cast("string"))).mapInArrow(run, f"`{ident}` {kind}, start_char int, end_char int")
