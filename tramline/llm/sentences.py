"""Sentence units by a hidden-event n-gram model, decided by forward-backward posteriors.

A text is a sequence of words, each with the signs and the blank behind it; between any two a boundary event may
hide. In scripts that put no blanks between words every letter cluster is a word. The model is a trigram over words and
events: P(event | the two words before it, or an event and the word after that), P(word | event), P(word | none), and
P(word | an event and the word after that). Every order is averaged with the next lower one, down to the forms of words and
the kinds of signs and blanks behind them, so that counts alone decide what an abbreviation, an end mark or a
blank means, in any script.

Nothing tells the model where events are but what the definition of a unit makes certain: blank lines and list items
(a block's end is an event, a block's start follows one), dots in a row (an event, unless a small letter, an ideograph or
kana follows), and that a quotation, a bracket or an item's marker holds none. All others are hidden. A first pass counts
what ends blocks and begins them. Block ends are a share of all events, and the share is told by the signs that
nearly always end a unit; so the first counts give P(event | words before). A second pass counts, by these chances,
which words events are expected before. Then every block is decided by forward-backward over its slots.

Counts are kept by hash in tables of fixed size, so that the model has the same size for any corpus while every
document counts.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import keep

#: What counts as a blank beside white space: it has no width (fixed values).
_BLANK = "\\s\u200b\ufeff"
#: Signs that begin a list item (fixed values).
_ITEM = re.compile(r"[ \t]*(?:([-*•‣◦▪●○–—·+])|\(?(\d{1,3}|[A-Za-z])[.)])[ \t]+\S")
#: Signs by what they are (fixed values).
_STOPS, _STRONG = ".", "!?。！？｡।॥።፧؟‼⁇⁈⁉۔;"
_DOTS = "…"
_OPEN, _CLOSE = "([{“„«‹「『（【《〈〔", ")]}”»›」』）】》〉〕"
#: Straight double quotes are told apart in pairs before words are.
_OPENED, _CLOSED = "\ue000", "\ue001"
_COMMA, _COLON, _DASH = ",;،؛，、፣፤·", ":：፡፥", "-–—"
_GERMAN = re.compile("„[^“„]*“")
_STRAIGHT = re.compile('"([^"]*)"')


def _signs() -> str:
    """Everything in the basic plane that is no letter, mark, digit or blank, as a character class."""
    out, run = [], None
    for k in range(0x10000):
        c = chr(k)
        sign = (unicodedata.category(c)[0] in "PS" and c != "_") or c in _OPENED + _CLOSED
        if sign and run is None:
            run = k
        elif not sign and run is not None:
            out.append((run, k - 1))
            run = None
    return "".join(f"\\u{a:04x}-\\u{b:04x}" if b > a else f"\\u{a:04x}" for a, b in out)


_SIGNS = _signs()
_O, _C = re.escape(_OPEN + _OPENED), re.escape(_CLOSE + _CLOSED)
_CLUSTER = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]|[\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e50-\u0e59][\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]*"
_LETTER = f"[^{_BLANK}{_SIGNS}\u0e01-\u0e5b\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]"
#: (openers, word, signs behind it, blank): a text is nothing but these, one after the other.
_TOKEN = re.compile(f"([{_O}¿¡]*)({_CLUSTER}|{_LETTER}+(?:[-'’]{_LETTER}+)*)?((?:(?![{_O}¿¡])[{_SIGNS}\u0e31\u0e34-\u0e3a\u0e47-\u0e5b])*(?:[{_BLANK}]{{1,3}}[!?]+)?)([{_BLANK}]*)")
_DIGITS = re.compile(r"\d+")
_AT = re.compile("@|://")
_EDGE = re.compile(f"[{_BLANK}{_O}\u0e01-\u0e5b\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]")
_SIGN = re.compile(f"[{_SIGNS}]")


def _joined(text: str) -> str:
    """text with mail and web addresses as single words: signs in them become letters."""
    out, done = [], 0
    for m in _AT.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and not _EDGE.match(text[a - 1]):
            a -= 1
        while b < len(text) and not _EDGE.match(text[b]):
            b += 1
        while b > m.end() and _SIGN.match(text[b - 1]):
            b -= 1
        out += (text[done:a], _SIGN.sub("\ue010", text[a:b]))
        done = b
    return "".join(out) + text[done:]


# Forms of words: none, digits, capital, small, and letters without case in three groups of scripts.
NONE, DIGIT, UPPER, LOWER, IDEOGRAPH, THAI, PLAIN = range(7)
# Kinds of signs behind a word; those from CLOSED on have a quotation or bracket closed, `CARRIED` ones after a comma or colon.
BARE, COMMA, COLON, STOP, STRONG, DOTS, DASH, OTHER = range(8)
CLOSED, CARRIED = 8, 16


class Words(dict):
    """(hash, form, length group) of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        low = _DIGITS.sub("0", word.lower())
        c = word[:1]
        if not c:
            form = NONE
        elif c.isdigit():
            form = DIGIT
        elif c.isupper():
            form = UPPER
        elif c.islower():
            form = LOWER
        elif "\u0e00" <= c <= "\u0e7f":
            form = THAI
        else:
            form = IDEOGRAPH if re.match(_CLUSTER, c) else PLAIN
        n = min(5, len(low))
        got = self[word] = (zlib.crc32(low.encode("utf-8", "surrogatepass")) << 6) | (form << 3) | n
        return got


class Tails(dict):
    """(hash, whether one is an ideographic sign, how many close, kind) of the signs behind a word, remembered."""

    def __missing__(self, tail: str) -> int:
        if len(self) > 100_000:
            self.clear()
        inner = tail.rstrip(_CLOSE + _CLOSED)
        bare = inner.rstrip()
        if not bare:
            kind = BARE
        elif _DOTS in bare or ".." in bare:
            kind = DOTS
        elif any(c in _STRONG for c in bare):
            kind = STRONG
        elif bare[-1] == _STOPS:
            kind = STOP
        elif bare[-1] in _COLON:
            kind = COLON
        elif bare[-1] in _COMMA:
            kind = COMMA
        else:
            kind = DASH if bare[-1] in _DASH else OTHER
        closes = sum(c in _CLOSE + _CLOSED for c in tail)
        got = self[tail] = (zlib.crc32(tail.encode("utf-8", "surrogatepass")) << 8) | (any("\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uff65" for c in tail) << 7) | (min(closes, 7) << 4) | kind
        return got


_words, _tails = Words(), Tails()
_ENDED = re.compile(r"[.!?…。！？।።:：;,][\"'”’»)\]」』]*\s*$")


def _next_item(mark: str, new: str, ended: bool) -> bool:
    """Whether a line that looks like an item is one, and not a number, initial or dash that a line break put there."""
    if new.isdigit():
        return int(new) == int(mark) + 1 if mark.isdigit() else ended and int(new) == 1
    if new.isalpha():
        return ord(new) == ord(mark) + 1 if len(mark) == 1 and mark.isalpha() else ended and new in "aA"
    return new == mark or new in "*•‣◦▪●○" or ended and new in "-+"


def blocks(own: str) -> list[tuple[int, int]]:
    """(start, end) between certain boundaries: blank lines and list items."""
    out, start, pos, end = [], None, 0, 0
    mark, ended = "", True  # marker of the item before, whether the line before came to an end
    for line in own.split("\n"):
        if not line.strip(" \t\r\n 　​﻿\x0b\x0c"):
            if start is not None:
                out.append((start, end))
                start = None
        else:
            item = _ITEM.match(line)
            if start is None:
                start = pos
                mark = (item[1] or item[2]) if item else ""
            elif item and _next_item(mark, item[1] or item[2], ended):
                out.append((start, end))
                start, mark = pos, item[1] or item[2]
            ended = bool(_ENDED.search(line))
        if start is not None:
            end = pos + len(line)
        pos += len(line) + 1
    if start is not None:
        out.append((start, end))
    return out


_PAIRED = re.compile(f"[{_O}{_C}]")
# Bits of a word's `bits`: what opens before it, whether a blank follows, and what holds of the place behind it.
OPENS, INVERTED, BLANK, FIRST, HELD, CARRIES = 1, 2, 4, 8, 16, 32
_PREFIX = {"": 0}


def _prefix(p: str) -> int:
    got = _PREFIX.get(p)
    if got is None:
        got = (OPENS if any(c not in "¿¡" for c in p) else 0) | (INVERTED if any(c in "¿¡" for c in p) else 0)
        if len(_PREFIX) < 10_000:
            _PREFIX[p] = got
    return got


_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "​﻿"


class Scanned:
    """The words of texts, end to end, as lists that grow."""

    def __init__(self) -> None:
        self.word: list[int] = []
        self.tail: list[int] = []
        self.bits: list[int] = []
        self.size: list[int] = []
        self.skip: list[int] = []

    def add(self, own: str) -> tuple[int, int]:
        """(where the first word begins, number of words) of a text."""
        at, first, total = 0, 0, 0
        for a, b in blocks(own):
            text = own[a:b]
            x, y = a + len(text) - len(text.lstrip(_SPACE)), a + len(text.rstrip(_SPACE))
            if x >= y:
                continue
            if total:
                self.skip[-1] = x - at
            else:
                first = x
            total += self._block(own[x:y])
            at = y
        return first, total

    def _block(self, text: str) -> int:
        paired = _PAIRED.search(text) is not None or '"' in text
        if paired:
            if "„" in text:
                text = _GERMAN.sub(lambda m: m[0][:-1] + "”", text)
            if '"' in text:
                text = _STRAIGHT.sub(_OPENED + r"\1" + _CLOSED, text)
        if "@" in text or "://" in text:
            text = _joined(text)
        found = _TOKEN.findall(text)
        if not any(found[-1]):
            found.pop()
        pre, word, tail, blank = zip(*found, strict=True)
        n = len(found)
        bits = [_prefix(p) | (BLANK if g else 0) for p, g in zip(pre, blank, strict=True)]
        bits[0] |= FIRST
        tails = list(map(_tails.__getitem__, tail))
        size = [len(p) + len(w) + len(t) for p, w, t in zip(pre, word, tail, strict=True)]
        skip = list(map(len, blank))
        if paired:
            _hold(pre, tail, bits, tails)
        head = _ITEM.match(text)
        if head:  # no event inside an item's marker
            at = k = 0
            while k < n - 1 and at + size[k] < head.end():
                bits[k] |= HELD
                at += size[k] + skip[k]
                k += 1
        self.word += map(_words.__getitem__, word)
        self.tail += tails
        self.bits += bits
        self.size += size
        self.skip += skip
        return n


def _hold(pre: tuple, tail: tuple, bits: list[int], tails: list[int]) -> None:
    """Mark the places inside quotations and brackets as held, and what closes one that a comma or colon came before as carried. What never
    closes opens nothing, what never opened closes nothing."""
    stack: list[tuple[str, int, bool]] = []
    for k, (p, t) in enumerate(zip(pre, tail, strict=True)):
        for c in p:
            if c in _OPEN or c == _OPENED:
                stack.append((c, k, k > 0 and (tails[k - 1] & 15) in (COMMA, COLON)))
        if tails[k] >> 4 & 7:
            for c in t:
                if c in _CLOSE or c == _CLOSED:
                    if stack:
                        _, a, carried = stack.pop()
                        for i in range(a, k):
                            bits[i] |= HELD
                        if carried:
                            bits[k] |= CARRIES
                        if stack:
                            bits[k] |= HELD


COLUMNS = ("word", "tail", "bits", "size", "skip")
#: Tables of counts and the log2 of their places: in all, and of them events (_e). `left` goes by the word before a slot with what is
#: behind it, `left2` by the two words before, `short` by a word that an event is before; `form` and `shape` are what these back off
#: to. `start` and `mid` go by the word after an event, or after none; `mid2` by both words; `start2` and `all2` by two words after.
SMALL, WORD, PAIR = 12, 18, 20
TABLES = {
    "seed": 8, "seed_e": 8, "slots": 8, "slots_e": 8, "left": WORD, "left_e": WORD, "left2": PAIR, "left2_e": PAIR, "short": WORD, "short_e": WORD,
    "all_form": SMALL, "all": WORD, "all2": PAIR, "start_form": SMALL, "start": WORD, "start2": PAIR, "begin_all": SMALL, "begin_form": SMALL, "mid_all": SMALL, "mid_form": SMALL,
}
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def place(bits: int, *keys: np.ndarray) -> np.ndarray:
    """Places in a table of 2 ** bits of the combined keys."""
    h = np.zeros(len(keys[0]), np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ k.astype(np.uint64)) * _K1
            h ^= h >> np.uint64(29)
        h *= _K2
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Text:
    """The words of a batch of texts with their places in the tables. Slot i is the place behind word i."""

    def __init__(self, word: np.ndarray, tail: np.ndarray, bits: np.ndarray, text: np.ndarray):
        n = self.n = len(word)
        self.text = text  # number of the text that a word is of
        low, form, length = word >> 6, word >> 3 & 7, word & 7
        signs, closes, kind = tail >> 8, (tail >> 4 & 7) > 0, tail & 15
        after = lambda v, by=1: np.concatenate([v[by:], np.zeros(min(by, n), v.dtype)])[:n]
        behind = lambda v: np.concatenate([np.zeros(min(1, n), v.dtype), v[:-1]])
        first = self.first = (bits & FIRST) > 0
        last = self.last = np.concatenate([first[1:], np.ones(min(1, n), bool)])
        begins = np.flatnonzero(first)
        long = np.repeat(np.diff(np.append(begins, n)) >= LONG, np.diff(np.append(begins, n)))
        self.long = long
        self.teaches = last & long  # a block's end that shows how sentences end; greetings and headings don't
        # a closing sign that stands alone ends what the word before it ended
        alone = (form == NONE) & (kind == BARE) & closes & ~first
        kind = np.where(alone, behind(kind), kind)
        mark = self.mark = (kind == STOP) | (kind == STRONG) | (kind == DOTS)
        kind = kind + np.where((bits & CARRIES) > 0, CARRIED, np.where(closes, CLOSED, 0))
        blank = ((bits & BLANK) > 0) | (last & (form != IDEOGRAPH))  # as it would be before a next sentence
        opener = bits & (OPENS | INVERTED)
        nform, nopen = after(form), after(opener)
        dots = self.dots = (kind & 7) == DOTS
        goes_on = ((nform == LOWER) | (nform == IDEOGRAPH)) & (nopen == 0)
        # what is certain: 1 an event, 0 none, -1 hidden
        self.sure = np.where(last, 1, np.where((bits & HELD) > 0, 0, np.where(dots, np.where(goes_on, 0, 1), -1))).astype(np.int8)
        shape = kind * 2 + blank
        # digits are of the script of their signs, if those have one
        self.script = np.where((form == DIGIT) & (tail >> 7 & 1 > 0), 2, np.where(form == THAI, 1, np.where(form == IDEOGRAPH, 2, np.where(form == PLAIN, 3, 0))))
        # behind a sign a blank may be missing; where there is none it is all there is to see
        sign = kind * 2 + (blank & (kind == BARE))
        self.seed = self.script * 64 + sign
        self.left = place(WORD, low, signs, sign)
        self.left2 = place(PAIR, np.where(first, 1, behind(low) * 64 + behind(kind) + 2), low, signs, sign)
        self.short = self.left
        look = low * 64 + form * 4 + opener  # a word as it begins: letters, case, openers
        self.look_form, self.look = place(SMALL, form * 4 + opener), place(WORD, look)
        self.look2 = place(PAIR, look, np.where(last, 0, after(look)))
        nshape = nform * 4 + nopen
        self.all_form = self.start_form = after(self.look_form)
        self.all = self.start = after(self.look)
        self.begin_all, self.begin_form = place(SMALL, self.script), place(SMALL, nshape, self.script)
        self.mid_all = place(SMALL, shape, form)
        self.mid_form = place(SMALL, nshape, shape, form)


def counts_of(x: Text, p: np.ndarray | None) -> dict[str, np.ndarray]:
    """Counts of the tables. Without p what is certain: signs, words and pairs before block ends (_e) and all slots, words that begin
    blocks and all words. With the posteriors p, what is expected: the words after an event, and after none by what is before."""
    count = lambda kind, w, at=None: np.bincount(getattr(x, kind) if at is None else at, w, 1 << TABLES[kind.replace("look", "all")])
    inner = (~x.last).astype(float)
    begins = (x.first & x.long).astype(float)
    if p is None:
        hidden = ((x.sure < 0) | x.teaches).astype(float)
        ends = x.teaches.astype(float)
        w = {k: count(k, hidden) for k in ("left", "left2")} | {k + "_e": count(k, ends) for k in ("left", "left2")}
        plain = ~x.dots
        w |= {k: np.bincount(x.seed, v * plain, 1 << TABLES[k]) for k, v in (("slots", hidden), ("slots_e", ends))}
        for k, some in (("seed", hidden > 0), ("seed_e", x.teaches)):
            # a word with its signs counts once a text, so that no text, however it repeats itself, tells what a sign means
            own = np.flatnonzero(some & ~x.dots)
            once = own[np.unique(x.text[own] << WORD | x.left[own], return_index=True)[1]]
            w[k] = np.bincount(x.seed[once], minlength=1 << TABLES[k]).astype(float)
        one = x.first.astype(float)
        w |= {f"all{k}": count(f"all{k}", inner) + count(f"all{k}", one, getattr(x, f"look{k}")) for k in ("_form", "")}
        w["all2"] = count("look2", one + np.concatenate([[0.0], inner[:-1]]))
        return w
    began = np.where(x.first, x.long, np.concatenate([[0.0], p[:-1]])[: x.n])  # how sure a word is the first of its unit
    w = {f"start{k}": count(f"start{k}", inner * p) + count(f"start{k}", begins, getattr(x, f"look{k}")) for k in ("_form", "")}
    w["start2"] = count("look2", began * (1 - p))
    open_ = ((x.sure < 0) | x.teaches).astype(float)
    w |= {"short": count("short", open_ * began), "short_e": count("short", open_ * began * p)}
    w |= {k: count(k, inner * p) for k in ("begin_all", "begin_form")}
    w |= {k: count(k, inner * (1 - p)) for k in ("mid_all", "mid_form")}
    return w


#: Words that are looked at together, which bounds what a task holds unless one text has more.
PIECE_WORDS = 200_000
KAPPA = 4.0
SURE = 0.98
ANCHOR = 20.0
LONG = 8
MID = 1e9


class Model:
    """Counts and the probabilities that follow from them: each order is averaged with the next lower one, which counts for KAPPA occurrences."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.c = counts

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Per script, the share of true events that are block ends, and per script and signs the chance of an event.

        The signs of a script that end blocks most often are taken to be always an event, which tells the share.
        """
        tell = lambda kind: (self.c[kind + "_e"].reshape(4, 64), self.c[kind].reshape(4, 64) + 10.0)
        most = lambda e, n: np.maximum(1e-3, np.where(e >= 0.02 * e.sum(1, keepdims=True), e / n, 0.0).max(1))
        e, n = tell("seed")
        return most(*tell("slots")), np.clip(e / n / most(e, n)[:, None], 1e-4, SURE).ravel()

    def of(self, kind: str, x: Text) -> np.ndarray:
        return self.c[kind][getattr(x, kind.removesuffix("_e"))]

    def left(self, x: Text) -> tuple[np.ndarray, np.ndarray]:
        """P(event | the word before), P(event | the two words before): how often they end a block, in relation to the share of events that are
        block ends. What nearly always or hardly ever ends a unit counts for more, so that rare words can't outweigh it."""
        share, signs = self.shares()
        lam, q = share[x.script], signs[x.seed]
        weight = lambda r: KAPPA * np.clip(0.5 / np.minimum(r, 1 - r), 1.0, 1000.0)
        k = weight(q)
        one = np.minimum(SURE, (self.of("left_e", x) / lam + k * q) / (self.of("left", x) + k))
        k = weight(one)
        return one, np.minimum(SURE, (self.of("left2_e", x) / lam + k * one) / (self.of("left2", x) + k))

    def first_guess(self, x: Text) -> np.ndarray:
        """By what is before a slot alone."""
        return np.where(x.sure < 0, self.left(x)[1], x.sure)

    def potentials(self, x: Text) -> tuple[np.ndarray, ...]:
        """Of every slot: P(event | no event before the word before), P(event | one), P(next word | event) / P(next word | none), and
        P(next word | event before the word before) / P(next word | none)."""
        of = lambda kind: self.of(kind, x)
        events, words = self.c["start_form"].sum(), self.c["all_form"].sum()
        f1 = (of("start_form") + 0.1) / (events + 1)
        f1 = (of("begin_form") + KAPPA * f1) / (of("begin_all") + KAPPA)
        f0 = (np.maximum(0.0, of("all_form") - of("start_form")) + 0.1) / (words - events + 1)
        f0 = (of("mid_form") + KAPPA * f0) / (of("mid_all") + KAPPA)

        def of_lower(s, a, s0, a0):
            """s of s0 against what is left of a of a0, each averaged with a of a0."""
            q = (a + 1e-3) / (a0 + 1e-3)
            return ((s + KAPPA * q) / (s0 + KAPPA)) / ((np.maximum(0.0, a - s) + KAPPA * q) / (np.maximum(0.0, a0 - s0) + KAPPA))

        begins = f1 / f0 * of_lower(of("start"), of("all"), of("start_form"), of("all_form"))
        at = x.look
        second = of_lower(self.c["start2"][x.look2], self.c["all2"][x.look2], self.c["start"][at], self.c["all"][at])
        one, two = self.left(x)
        short = (of("short_e") + KAPPA * one) / (of("short") + KAPPA)
        known = x.sure >= 0  # what is certain says nothing about the slot before
        two, short = np.where(known, 0.5, two), np.where(known, 0.5, np.minimum(SURE, short))
        return two, short, np.clip(begins, 1e-6, 1e6), np.clip(second, 1e-2, 1e2)

    def posteriors(self, x: Text) -> np.ndarray:
        return forward_backward(*self.potentials(x), x.sure, x.first)


def forward_backward(q0: np.ndarray, q1: np.ndarray, begins: np.ndarray, second: np.ndarray, sure: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors of chains of slots, laid end to end; `first` says where each begins, after an event.

    q0 and q1 are the chances of an event after none and after one in the slot before, begins is how much likelier an event makes the
    next word than none does, second how much likelier an event in the slot before makes it, if none follows. sure fixes a slot (0 or 1), -1 leaves it open. Chains are taken side by side, longest first.
    """
    n = len(q0)
    on, off = begins * (sure != 0), (sure != 1).astype(float)
    t01, t11, t00, t10 = q0 * on, q1 * on, (1 - q0) * off, (1 - q1) * second * off
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), "right").tolist()  # chains of more than k slots
    f, out = np.empty(n), np.empty(n)  # chance of an event by the words up to the slot, and by all
    f0, f1 = np.zeros(len(start)), np.ones(len(start))
    alone = next((k for k, m in enumerate(active) if m == 1), len(active))  # from here on only the longest chain is left
    for k, m in enumerate(active[:alone]):
        at = start[:m] + k
        e = f0[:m] * t01[at] + f1[:m] * t11[at]
        o = f0[:m] * t00[at] + f1[:m] * t10[at]
        f1 = e / np.maximum(e + o, 1e-300)
        f0 = 1 - f1
        f[at] = f1
    b0 = b1 = np.empty(0)
    if alone < len(active):
        rest = slice(int(start[0]) + alone, int(start[0]) + len(active))
        f[rest], out[rest], c0, c1 = _one_chain(float(f1[0]), *(v[rest].tolist() for v in (t00, t01, t10, t11)))
        b0, b1 = np.array([c0]), np.array([c1])
    for k in range(alone - 1, -1, -1):
        m = active[k]
        at = start[:m] + k
        c0, c1 = np.ones(m), np.ones(m)
        c0[: len(b0)], c1[: len(b1)] = b0, b1
        e, o = f[at] * c1, (1 - f[at]) * c0
        out[at] = e / np.maximum(e + o, 1e-300)
        b0, b1 = t00[at] * c0 + t01[at] * c1, t10[at] * c0 + t11[at] * c1
        z = np.maximum(b0 + b1, 1e-300)
        b0, b1 = b0 / z, b1 / z
    return out


def _one_chain(f1: float, t00: list[float], t01: list[float], t10: list[float], t11: list[float]) -> tuple[list[float], list[float], float, float]:
    """Forward chances and posteriors of the rest of one chain, and what it says about the slot before, by plain numbers."""
    f = []
    for a, b, c, d in zip(t00, t01, t10, t11, strict=True):
        e, o = (1 - f1) * b + f1 * d, (1 - f1) * a + f1 * c
        f1 = e / max(e + o, 1e-300)
        f.append(f1)
    out, c0, c1 = [0.0] * len(f), 1.0, 1.0
    for k in range(len(f) - 1, -1, -1):
        e, o = f[k] * c1, (1 - f[k]) * c0
        out[k] = e / max(e + o, 1e-300)
        c0, c1 = t00[k] * c0 + t01[k] * c1, t10[k] * c0 + t11[k] * c1
        z = max(c0 + c1, 1e-300)
        c0, c1 = c0 / z, c1 / z
    return f, out, c0, c1


LISTS = {"word": "bigint", "tail": "bigint", "bits": "int", "size": "int", "skip": "int"}
SCAN_SQL = "doc_id long, at long, n int, " + ", ".join(f"{c} array<{t}>" for c, t in LISTS.items())
_ARROW = {"bigint": pa.int64(), "int": pa.int32()}
SCAN = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), *[(c, pa.list_(_ARROW[t])) for c, t in LISTS.items()]])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (doc_id, start, own) to a row per text with its words; at is where the first begins in the whole text."""
    for batch in batches:
        s, rows = Scanned(), []
        for doc, start, own in zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), batch.column("own"), strict=True):
            own = own.as_py()
            if own and not own.isspace():
                first, n = s.add(own)
                if n:
                    rows.append((doc, start + first, n))
            if len(s.word) > PIECE_WORDS:
                yield _scanned(s, rows)
                s, rows = Scanned(), []
        if rows:
            yield _scanned(s, rows)


def _scanned(s: Scanned, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, at, n = zip(*rows, strict=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(getattr(s, c), _ARROW[t])) for c, t in LISTS.items()]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), *lists], schema=SCAN)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of scanned batches in pieces of about PIECE_WORDS words; a text is never cut."""
    for b in batches:
        at = np.cumsum(b.column("n").to_numpy()) // PIECE_WORDS
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(edges[:-1], edges[1:], strict=True) if y > x)


def text_of(b: pa.RecordBatch) -> Text:
    text = np.repeat(np.arange(b.num_rows), b.column("n").to_numpy())
    return Text(*(b.column(c).flatten().to_numpy().astype(np.int64) for c in ("word", "tail", "bits")), text)


def count(model: Model | None):
    """Arrow batches of scanned texts to counts (kind, place, n), summed within the task: certain ones without a model, else those that its first guess expects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in pieces(batches):
            if b.num_rows:
                x = text_of(b)
                for k, v in counts_of(x, model and model.first_guess(x)).items():
                    total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k] * len(some), pa.string()), "place": pa.array(some, pa.int64()), "n": pa.array(v[some], pa.float64())})

    return run


def tables(rows: pa.Table | list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Tables of counts from rows (kind, place, n); kinds that none of the rows has are empty."""
    c = {k: np.zeros(1 << size, np.float32) for k, size in TABLES.items()}
    for b in rows.to_batches() if isinstance(rows, pa.Table) else rows:
        kinds = b.column("kind").dictionary_encode()
        at, n = b.column("place").to_numpy(), b.column("n").to_numpy()
        for i, k in enumerate(kinds.dictionary.to_pylist()):
            own = kinds.indices.to_numpy() == i
            np.add.at(c[k], at[own], n[own])
    return c


def train(scanned: DataFrame) -> dict[str, np.ndarray]:
    """The counts of all the texts, in two passes. What comes to the driver and goes to the tasks is bounded by the size of the tables."""
    spark = scanned.sparkSession

    def summed(shared=None) -> dict[str, np.ndarray]:
        run = lambda batches: count(Model(pickle.loads(shared.value)) if shared else None)(batches)
        counts = scanned.mapInArrow(run, "kind string, place long, n double").groupBy("kind", "place").agg(F.sum("n").alias("n"))
        return tables(counts.toArrow())

    certain = summed()
    expected = summed(spark.sparkContext.broadcast(pickle.dumps(certain)))
    return {k: certain[k] + expected[k] for k in TABLES}  # each pass has tables of its own


def units_of(b: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every unit of a batch of scanned texts, starts and ends in the whole text."""
    n = b.column("n").to_numpy()
    size, skip = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("size", "skip"))
    step = np.cumsum(size + skip) - (size + skip)
    row = np.repeat(np.arange(b.num_rows), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    start = step - np.repeat(step[first], n) + np.repeat(b.column("at").to_numpy(), n)
    ends = np.flatnonzero(model.posteriors(text_of(b)) >= 0.5)
    begins = np.concatenate([[0], ends[:-1] + 1])
    return row[ends], start[begins], (start + size)[ends]


UNITS = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def split(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(pickle.loads(shared.value))
        for b in pieces(batches):
            if b.num_rows:
                row, x, y = units_of(b, model)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(x), pa.array(y)], schema=UNITS)

    return run


def own_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, start, own): text[own_start, own_end); offsets are cut to the text, null ones mean its edges."""
    n = F.length("text")
    a = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("own_start").cast("long"), F.lit(0).cast("long")))
    b = F.coalesce(F.least(F.col("own_end").cast("long"), n.cast("long")), n.cast("long"))
    return docs.filter("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), a.alias("start"), F.col("text").substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0).cast("long")).cast("int")).alias("own")
    )


def sentence_units(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit of every document's own text.

    Null and empty texts, and ranges that are empty or blank, give no units; a range beyond the text is cut
    to it. Texts of any length are split whole. Repeated rows give their units each. Extra columns are ignored.
    """
    scanned = keep(own_texts(docs).mapInArrow(scan, SCAN_SQL))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(scanned)))
    return scanned.mapInArrow(split(shared), "doc_id long, start_char long, end_char long")


def trained(texts: list[str]) -> tuple[list[pa.RecordBatch], dict[str, np.ndarray]]:
    """A few texts scanned, and the counts of them, without Spark."""
    own = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "start": pa.array([0] * len(texts), pa.int64()), "own": pa.array(texts, pa.string())})
    rows = list(scan(iter([own])))
    certain = tables(list(count(None)(iter(rows))))
    expected = tables(list(count(Model(certain))(iter(rows))))
    return rows, {k: certain[k] + expected[k] for k in TABLES}


def units(texts: list[str], counts: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int]]]:
    """The units of a few texts without Spark; the model is trained on them unless its counts are given."""
    rows, own = trained(texts)
    model = Model(own if counts is None else counts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for b in rows:
        ids = b.column("doc_id").to_pylist()
        for r, x, y in zip(*(v.tolist() for v in units_of(b, model)), strict=True):
            out[ids[r]].append((x, y))
    return out
