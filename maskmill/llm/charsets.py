"""Encoding chains: how a text was written and how it was misread, and the way back.

A chain ``utf-8>cp1252`` is a text written in UTF-8 and decoded as cp1252; repeated
parts (``utf-8>cp1252>utf-8>cp1252``) mean that it happened twice. Bytes a code page
leaves open are read as the C1 control of that number, as browsers and most exporters
do.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Readers that turn UTF-8 into garbled text.
READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman")
#: Families of single-byte code pages that are taken for one another.
FAMILIES = (
    ("cp1252", "cp437", "cp850", "mac-roman", "latin-1"),
    ("cp1250", "iso8859-2", "cp852", "cp1252", "latin-1"),
    ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1252", "latin-1"),
    ("cp1253", "iso8859-7", "cp1252", "latin-1", "cp737"),
    ("cp1254", "iso8859-9", "cp857", "cp1252", "latin-1"),
)
TWICE = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("latin-1", "cp1252"), ("mac-roman", "mac-roman"), ("cp1250", "cp1250"))


@lru_cache(maxsize=64)
def page(name: str) -> str:
    """The 256 characters of a code page; open bytes are C1 controls."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=64)
def _bytes_of(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(page(name))))}


@lru_cache(maxsize=256)
def _retold(wrong: str, right: str) -> dict[str, str]:
    """For a single-byte chain: misread character -> written character."""
    back, read = _bytes_of(wrong), page(right)
    return {c: read[b] for c, b in back.items() if b >= 128}


def unread(text: str, wrong: str) -> bytes | None:
    """The bytes that ``wrong`` read as ``text``; None if it cannot have."""
    table = _bytes_of(wrong)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def undo(text: str, chain: str) -> str | None:
    """The text before the chain; None if it cannot have come out of it or is no other."""
    steps = chain.split(">")
    current = text
    for right, wrong in reversed(list(zip(steps[::2], steps[1::2], strict=True))):
        if right == "utf-8":
            raw = unread(current, wrong)
            if raw is None:
                return None
            try:
                current = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            table = _retold(wrong, right)
            out = [c if c < "\x80" else table.get(c) for c in current]
            if None in out:
                return None
            current = "".join(out)
    return None if current == text else current


def garble(text: str, chain: str) -> str | None:
    """The text after the chain, for tests; None if a code page lacks a character."""
    steps = chain.split(">")
    for right, wrong in zip(steps[::2], steps[1::2], strict=True):
        raw = text.encode("utf-8") if right == "utf-8" else unread(text, right)
        if raw is None:
            return None
        text = "".join(page(wrong)[b] for b in raw)
    return text


@lru_cache(maxsize=1)
def chains() -> tuple[str, ...]:
    out = [f"utf-8>{r}" for r in READERS] + [f"utf-8>{a}>utf-8>{b}" for a, b in TWICE]
    for family in FAMILIES:
        for right in family:
            for wrong in family:
                if right != wrong and page(right) != page(wrong) and f"{right}>{wrong}" not in out and not (right == "latin-1" and wrong == "cp1252"):
                    out.append(f"{right}>{wrong}")
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _readable_by(c: str) -> int:
    """Bit mask of the chains whose last reading can give the character."""
    mask = 0
    for i, chain in enumerate(chains()):
        right, wrong = chain.split(">")[-2:]
        table = _bytes_of(wrong) if right == "utf-8" else _retold(wrong, right)
        mask |= (c in table) << i
    return mask


def possible_chains(text: str) -> list[str]:
    """The chains that every non-ASCII character of the text can have come out of."""
    mask = -1
    for c in set(text):
        if c > "\x7f":
            mask &= _readable_by(c)
    if mask <= 0:
        return []
    return [chain for i, chain in enumerate(chains()) if mask >> i & 1]


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    if not c.isalpha():
        return ""
    if c < "\x80":
        return "latin"
    name = unicodedata.name(c, "?").split(" ")[0]
    return {"MASCULINE": "", "FEMININE": "", "MICRO": "", "MODIFIER": "", "SUPERSCRIPT": ""}.get(name, name.lower())


def plausible(text: str) -> bool:
    """Could it stand in sound writing? One script per token, no controls, and no symbol
    between letters other than those that writing has there."""
    script, before, gap = "", "", False
    for c in text:
        if "\x7f" <= c < "\xa0" or c == "�" or c < " ":
            return False
        s = _script(c)
        if s:
            if script and s != script:
                return False
            if gap:
                return False
            script = s
        elif before and _script(before) and c > "\x7f" and c not in "’‘ʼ–—…×·³²°”“»«‐‑⁻⁴ªº":
            gap = True
        else:
            gap = gap and c > "\x7f"
        before = c
    return True
