"""Readable parts of a raw message as plain text, and plain text as comparable words."""

from __future__ import annotations

import binascii
import html
import re
import unicodedata

import regex

_BLANK_LINE = re.compile(r"\r?\n[ \t]*\r?\n")
_HEADER = re.compile(r"[!-9;-~]+:")
_FOLD = re.compile(r"\r?\n[ \t]+")
_TYPE = re.compile(r"(?im)^content-type:[ \t]*([^;\r\n]*)(.*)$")
_CODING = re.compile(r"(?im)^content-transfer-encoding:[ \t]*([A-Za-z0-9-]+)")
_PARAM = re.compile(r"""(?i);\s*(boundary|charset)\s*=\s*(?:"([^"]*)"|([^\s;"]+))""")
_B64_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_DROP = re.compile(r"(?is)<!--.*?-->|<(style|script)\b.*?</\1\s*>")
#: Tags inside of which text runs on (fixed values); every other tag parts words.
_INLINE = re.compile(r"(?i)</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|mark|s|small|span|strike|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>")
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
#: What mailers put before quoted lines: > and | in any number, also after initials (fixed values).
_QUOTE = re.compile(r"(?m)^[ \t]*(?:(?:[A-Z]{1,4}>|[>|»])[ \t]?)+")
#: Characters that have no width: soft hyphen, joiners, direction marks, byte order mark (fixed values).
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿]")
_APOSTROPHE = re.compile("['‘’ʼ`´′]")
_MARKS = regex.compile(r"\p{M}+")
_IDEOGRAPH = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(f"[{_IDEOGRAPH}]|[^\\W_{_IDEOGRAPH}]+")
_WORD_ASCII = re.compile("[a-z0-9]+")


def decoded(body: str, coding: str, charset: str) -> str | None:
    """The text of a part's body, or None if its bytes are no text."""
    coding = coding.lower()
    if coding == "base64":
        joined = "".join(x for x in map(str.strip, body.splitlines()) if _B64_LINE.fullmatch(x)).rstrip("=")
        try:
            data = binascii.a2b_base64(joined[: len(joined) - (len(joined) % 4 == 1)] + "==")
        except binascii.Error:
            return None
    elif coding == "quoted-printable":
        data = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    tries = ["utf-8", charset, "latin-1"] if not charset.lower().startswith(("utf-16", "utf-32", "utf-7", "iso-2022", "hz")) else [charset, "utf-8", "latin-1"]
    for name in tries:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return None


def leaves(text: str) -> list[tuple[str, str]]:
    """(content type, decoded text) of every readable part, in order, however deeply parts are nested. A text without headers is one plain part.

    Multipart bodies without closing boundary end with the text; a boundary that never occurs leaves the
    body as one plain part. Parts that aren't text are kept if they hold no control characters.
    """
    out: list[tuple[str, str]] = []
    # What is still to be read, next part last: (text, None) is a part with its headers, (text, type) a plain one.
    todo: list[tuple[str, str | None]] = [(text, None)]
    whole = True
    while todo:
        part, known = todo.pop()
        if known:
            out.append((known, part))
            continue
        inside, leaf = _opened(part, whole)
        out += leaf
        todo += reversed(inside)
        whole = False
    return out


def _opened(text: str, whole: bool) -> tuple[list[tuple[str, str | None]], list[tuple[str, str]]]:
    """The parts right inside of a part, and the part itself if it is a leaf. whole: it is the message."""
    if _HEADER.match(text):
        m = _BLANK_LINE.search(text)
        head, body = (text[: m.start()], text[m.end() :]) if m else (text, "")
    elif not whole and (m := _BLANK_LINE.match("\n" + text)):
        head, body = "", text[m.end() - 1 :]
    else:
        head, body = "", text
    if head:
        head = _FOLD.sub(" ", head)
    kind, charset, boundary, coding = "text/plain", "utf-8", "", ""
    if m := _TYPE.search(head):
        kind = m[1].strip().lower() or kind
        for p in _PARAM.finditer(m[2]):
            if p[1].lower() == "charset":
                charset = p[2] or p[3] or charset
            else:
                boundary = p[2] or p[3]
    if m := _CODING.search(head):
        coding = m[1]
    if kind.startswith("multipart/") and boundary:
        chunks = ("\n" + body).split("\n--" + boundary)
        if len(chunks) > 1:
            inside: list[tuple[str, str | None]] = []
            if chunks[0].strip():
                inside.append((chunks[0], "text/plain"))
            for c in chunks[1:]:
                if c.startswith("--"):
                    rest = c[2:].strip("-\r\n\t ")
                    if rest:
                        inside.append((rest, "text/plain"))
                    continue
                nl = c.find("\n")
                inside.append((c[nl + 1 :] if nl >= 0 else "", None))
            return inside, []
    if kind.startswith("message/"):
        return [(decoded(body, coding, charset) or "", None)], []
    plain = decoded(body, coding, charset)
    if plain is None or not kind.startswith(("text/", "multipart/")) and _unreadable(plain):
        return [], []
    return [], [(kind, plain)]


def _unreadable(plain: str) -> bool:
    """Whether decoded bytes that claim to be no text are none."""
    return any(ord(c) < 9 or 13 < ord(c) < 32 or 127 <= ord(c) < 160 for c in plain)


def plain_text(kind: str, text: str) -> str:
    """Text without markup and without quote marks at line starts."""
    if kind == "text/html" or kind.endswith("xhtml+xml"):
        return html.unescape(_TAG.sub(" ", _INLINE.sub("", _DROP.sub(" ", text)) if "<" in text else text))
    return _QUOTE.sub("", text)


def words(text: str) -> list[str]:
    """Words without case, accents, punctuation and invisible characters; every ideograph is a word."""
    if text.isascii():
        return _WORD_ASCII.findall(text.lower().replace("'", "").replace("`", ""))
    text = unicodedata.normalize("NFKD", _APOSTROPHE.sub("", _INVISIBLE.sub("", text)).casefold())
    return _WORD.findall(_MARKS.sub("", text))


def message_words(text: str | None) -> list[list[str]]:
    """The words of every readable part of a message; null and empty texts have no parts."""
    return [words(plain_text(k, t)) for k, t in leaves(text)] if text else []
