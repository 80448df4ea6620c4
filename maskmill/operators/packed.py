"""Several values packed in one text field: a quote-aware finite-state tokenizer.

Every exporter writes lists differently: ``a;b``, ``a, b``, ``a | b``, one value a
line, ``"a";"b;c"``, ``["a", "b"]``, ``['a', "b'c"]``, ``{1, 2}``, and mixtures of them.
The tokenizer walks a field once through these states:

====== ================================================================
START  before a value; white space is skipped, quotes and brackets open
BARE   inside an unquoted value; a delimiter ends it
QUOTED inside quotes; delimiters are text, escapes are resolved
AFTER  behind a closing quote; only a delimiter or a bracket may follow
====== ================================================================

Between the characters that can change the state it jumps with a compiled class
scan, so the cost is that of the separators, not of the text.

Defined results
    * null, empty, blank, ``[]`` and ``;`` fields hold no value: no rows.
    * empty values between delimiters are skipped and do not count in ``pos``.
    * quotes open only at the start of a value (``reader's pick`` is bare text) and
      close only before a delimiter, a bracket or the end; a quote that never closes
      is text.
    * inside quotes a doubled quote is one quote; inside a bracketed list backslash
      escapes are those of JSON; elsewhere a backslash escapes only a quote or, in
      bare text, a delimiter.
    * brackets nest, and delimiters inside brackets opened within a bare value belong
      to it, unless the bracket is never closed; a field is a bracketed list only if its first bracket is closed
      by its last character, so ``[4170] scan.png`` stays one value.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimiters of any packed field; a field may add its own (see ``split_packed``).
DELIMITERS = ";,|\t\r\n；"
_PAIRS = {"[": "]", "{": "}"}
_BRACKET = re.compile(r"[\[\]{}]")
_JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@lru_cache(maxsize=64)
def _scanners(delimiters: str) -> tuple[re.Pattern, re.Pattern, re.Pattern, frozenset]:
    d = re.escape(delimiters)
    return (
        re.compile(rf"[{d}\\]"),  # bare, depth 0
        re.compile(rf"[{d}\\\[\]{{}}]"),  # bare, inside brackets
        re.compile(rf"[{d}]"),
        frozenset(delimiters),
    )


def _wrapped(text: str, delims: frozenset) -> bool:
    """Is the whole text one bracketed list?"""
    close = _PAIRS.get(text[0])
    if close is None or text[-1] != close:
        return False
    depth, i, n, fresh = 0, 0, len(text), True
    while i < n:
        c = text[i]
        if fresh and c in "\"'":
            end = _closing_quote(text, i, delims, True)
            if end > 0:
                i, fresh = end + 1, False
                continue
        if c in _PAIRS:
            depth += 1
            fresh = True
        elif c in "]}":
            depth -= 1
            if depth == 0 and i < n - 1:
                return False
            fresh = False
        elif c in delims:
            fresh = True
        elif not c.isspace():
            fresh = False
        i += 1
    return depth == 0


def _bracketed(text: str) -> dict[int, int]:
    """Index of each bracket that is closed, with that of its closing one."""
    out, still = {}, []
    for m in _BRACKET.finditer(text):
        if m.group() in _PAIRS:
            still.append((m.start(), _PAIRS[m.group()]))
        elif still and still[-1][1] == m.group():
            out[still.pop()[0]] = m.start()
    return out


def _closing_quote(s: str, start: int, delims: frozenset, nested: bool) -> int:
    """Index of the quote that closes the one at ``start``; -1 if none does."""
    q, i, n = s[start], start + 1, len(s)
    while True:
        i = s.find(q, i)
        if i < 0:
            return -1
        if i > start + 1 and s[i - 1] == "\\":
            back = i - 1
            while back > start and s[back - 1] == "\\":
                back -= 1
            if (i - back) % 2 == 1 and (nested or not _ends_value(s, i + 1, delims, nested)):
                i += 1
                continue
        if i + 1 < n and s[i + 1] == q:
            if i == start + 1 and _ends_value(s, i + 1, delims, nested):
                return i
            i += 2
            continue
        if _ends_value(s, i + 1, delims, nested):
            return i
        i += 1


def _ends_value(s: str, i: int, delims: frozenset, nested: bool) -> bool:
    """Does only white space stand between ``i`` and a delimiter, a bracket or the end?"""
    n = len(s)
    while i < n:
        c = s[i]
        if c in delims or (nested and c in "]}"):
            return True
        if not c.isspace():
            return False
        i += 1
    return True


def _unescape(body: str, quote: str, nested: bool) -> str:
    body = body.replace(quote * 2, quote)
    if "\\" not in body:
        return body
    out, i, n = [], 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\" and i + 1 < n:
            e = body[i + 1]
            if e == quote or (nested and e in "\\/\"'"):
                out.append(e)
                i += 2
                continue
            if nested and e in _JSON_ESCAPES:
                out.append(_JSON_ESCAPES[e])
                i += 2
                continue
            if nested and e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", body[i + 2 : i + 6]):
                out.append(chr(int(body[i + 2 : i + 6], 16)))
                i += 6
                continue
        out.append(c)
        i += 1
    text = "".join(out)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def tokenize(text: str | None, delimiters: str = DELIMITERS) -> list[str]:
    """The non-empty values of one packed field, in written order."""
    if not text:
        return []
    s = text.strip()
    if not s:
        return []
    bare, bare_nested, _, delims = _scanners(delimiters)
    nested = _wrapped(s, delims)
    closed = {} if nested else _bracketed(s)
    out: list[str] = []
    depth, i, n = 0, 0, len(s)
    while i < n:
        c = s[i]
        # START
        if c in delims or c.isspace():
            i += 1
            continue
        if nested and c in _PAIRS:
            depth += 1
            i += 1
            continue
        if nested and c in "]}" and depth:
            depth -= 1
            i += 1
            continue
        if c in "\"'":
            end = _closing_quote(s, i, delims, nested)
            if end > 0:  # QUOTED, then AFTER
                value = _unescape(s[i + 1 : end], c, nested).strip()
                if value:
                    out.append(value)
                i = end + 1
                continue
        # BARE
        start, pieces, inner, until, scan = i, [], 0, 0, bare_nested if nested or closed else bare
        while True:
            m = scan.search(s, i)
            if m is None:
                i = n
                break
            i, c = m.start(), m.group()
            if c == "\\":
                if i + 1 < n and s[i + 1] in delims:
                    pieces.append(s[start:i])
                    start = i + 1
                i += 2
                continue
            if not nested and c in "[]{}":
                until = max(until, closed.get(i, 0))
                i += 1
                continue
            if c in "[{":
                inner += 1
                i += 1
                continue
            if c in "]}" and inner:
                inner -= 1
                i += 1
                continue
            if (inner or i < until) and c in delims:
                i += 1
                continue
            break
        i = min(i, n)
        value = ("".join(pieces) + s[start:i]).strip()
        if value:
            out.append(value)
    return out


def _class(characters: str) -> str:
    return "[" + re.sub(r"([\\\[\]^\-])", r"\\\1", characters) + "]"


def packed_values(column, delimiters: Mapping[str, str] | str = DELIMITERS, field_name=None):
    """Array of the values of a packed text column.

    ``delimiters`` may differ by the value of ``field_name``. Texts without any special
    character never leave the JVM.
    """
    by_field = {"": delimiters} if isinstance(delimiters, str) else dict(delimiters)
    field_name = F.lit("") if field_name is None else field_name

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([tokenize(x, by_field[f]) if x is not None else None for x, f in zip(texts, names, strict=True)], dtype=object)

    none = F.array().cast("array<string>")
    plain = F.regexp_replace(column, r"^\s+|\s+$", "")
    is_plain = ~column.rlike(_class("".join(dict.fromkeys("".join(by_field.values()).replace(" ", "") + "\"'[]{}\\"))))
    if any(" " in d for d in by_field.values()):
        is_plain &= ~plain.contains(" ")
    inside = split(F.when(is_plain, F.lit(None).cast("string")).otherwise(column), field_name)
    return F.when(column.isNull(), none).when(is_plain, F.when(plain == "", none).otherwise(F.array(plain))).otherwise(inside)


def split_packed(
    df: DataFrame,
    keys: Sequence[str],
    fields: Iterable[str],
    extra_delimiters: Mapping[str, str] | None = None,
    min_values: int = 1,
    names: tuple[str, str, str] = ("field_name", "pos", "item"),
) -> DataFrame:
    """One row per value of the packed ``fields``: keys, field name, position, value.

    ``extra_delimiters`` adds delimiters for single fields (folds may be written
    ``1+2`` or ``1 / 2``, which would be text in a path). With ``min_values`` 2 only
    fields that hold several values give rows, and fields without any delimiter are
    dropped before the tokenizer sees them. Repeated records give one row. Columns
    other than ``keys`` and ``fields`` never enter the plan, so they cannot clash.
    Keys may be null; they are kept. An empty table gives an empty result.
    """
    extra = dict(extra_delimiters or {})
    fields = list(fields)
    clash = set(names) & set(keys)
    if clash:
        raise ValueError(f"output names {sorted(clash)} are also keys; pass other names")
    if not fields:
        raise ValueError("no fields")
    delims = {f: DELIMITERS + extra.get(f, "") for f in fields}
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("t")) for f in fields])
    kept = [F.col(f"`{k}`") for k in keys]
    long = df.select(*kept, F.explode(pairs).alias("__p")).select(*kept, F.col("__p.f").alias("__f"), F.col("__p.t").alias("__t"))
    if min_values > 1:
        several = F.lit(False)
        for d in set(delims.values()):
            several |= F.col("__f").isin([f for f in fields if delims[f] == d]) & F.col("__t").rlike(_class(d))
        long = long.filter(several)
    else:
        long = long.filter(F.col("__t").isNotNull())
    values = long.withColumn("__v", packed_values(F.col("__t"), delims, F.col("__f"))).filter(F.size("__v") >= min_values)
    out = values.select(*kept, F.col("__f").alias(names[0]), F.posexplode("__v").alias("__i", names[2]))
    return out.select(*kept, names[0], (F.col("__i") + 1).cast("int").alias(names[1]), names[2]).distinct()
