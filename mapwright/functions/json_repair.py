"""Broken JSON, as models write it, made whole: a pushdown automaton over the characters of a reply.

The stack holds the open objects and lists. A value is put into its container only once it is complete, so an item that
the text breaks off in is never there, while a container that merely lacks its bracket is closed where the text ends.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Deeper texts are not repaired.
DEPTH = 200
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/", "'": "'"}
_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\Z")
_GAP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)*", re.DOTALL)
_BARE = re.compile(r"[^,{}\[\]\n]*")
_BARE_KEY = re.compile(r"[^\s:,{}\[\]\"']+")
#: What may follow the end of a key; of a value, with and without the comma; of an item of a list.
_AFTER_KEY = re.compile(r"\s*:")
_AFTER_VALUE = re.compile(r"\s*(?:[}\]]|\Z|//|/\*|,\s*(?:[\"'“‘`}\]]|[\w$-]+\s*:|\Z|//|/\*)|[\"'“‘`][^\"'“”‘’`\n]{1,80}[\"'”’`]\s*:|\n\s*[\w$-]+\s*:)")
_AFTER_ITEM = re.compile(r"\s*(?:[}\]]|\Z|//|/\*|,\s*(?:[\"'“‘`{}\[\]\d-]|\w+\s*[,\]]|\Z|//|/\*)|\n\s*[\"'“‘`])")


class _CutOff(Exception):
    """The text ends inside of a token."""


def _string(text: str, at: int, after: re.Pattern) -> tuple[str, int]:
    """The string whose quote is at ``at``, and where it ends. A quote that nothing fitting follows belongs to the string."""
    close, out, k = _QUOTES[text[at]], [], at + 1
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            following = text[k + 1]
            if following == "u" and re.match(r"[0-9a-fA-F]{4}", text[k + 2 : k + 6]):
                out.append(chr(int(text[k + 2 : k + 6], 16)))
                k += 6
                continue
            out.append(_ESCAPES.get(following, "\\" + following))
            k += 2
        elif c == close and after.match(text, k + 1):
            # halves of characters beyond the plane, written as two escapes
            return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), k + 1
        else:
            out.append(c)
            k += 1
    raise _CutOff


def _bare(text: str, at: int) -> tuple[object, int]:
    """A value without quotes: a word or number of JSON or Python, else a string up to a comma, bracket or line end."""
    end = _BARE.match(text, at).end()
    word = re.split(r"//|/\*", text[at:end])[0]
    value = word.strip()
    if value.lower() in _WORDS:
        return _WORDS[value.lower()], at + len(word)
    if end == len(text):
        raise _CutOff
    if _NUMBER.match(value):
        return (float(value) if re.search("[.eE]", value) else int(value)), at + len(word)
    return value, at + len(word)


def _value_at(text: str, start: int) -> tuple[object, int]:
    """The object or list that begins at ``start``, and where it ends."""
    stack: list[tuple[dict | list, list[str]]] = []  # a container, and the key that waits for its value
    k, c, done = start, "", None

    def put(value: object) -> None:
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[key.pop()] = value

    def close() -> None:
        nonlocal done
        box, key = stack.pop()
        if key:
            box[key.pop()] = None  # a key without a value
        if stack:
            put(box)
        else:
            done = box

    try:
        while done is None:
            k = _GAP.match(text, k).end()
            box, key = stack[-1] if stack else (None, None)
            if k >= len(text):
                if isinstance(box, dict) and (key or not box or c == ","):
                    raise _CutOff
                break
            c = text[k]
            waits = isinstance(box, dict) and not key
            if c in "{[" and not waits:
                stack.append(({}, []) if c == "{" else ([], []))
                if len(stack) > DEPTH:
                    raise ValueError("too deep")
                k += 1
            elif c in "}]":
                want = dict if c == "}" else list
                if any(isinstance(b, want) for b, _ in stack):
                    while not isinstance(stack[-1][0], want):  # brackets that are missing
                        close()
                    close()
                k += 1
            elif c == ",":
                if key:
                    box[key.pop()] = None
                k += 1
            elif c == ":" or c in "{[" or (c in ")(;" and not key):
                k += 1
            elif c in _QUOTES and waits:
                name, k = _string(text, k, _AFTER_KEY)
                key.append(name)
            elif c in _QUOTES:
                value, k = _string(text, k, _AFTER_ITEM if isinstance(box, list) else _AFTER_VALUE)
                put(value)
            elif waits:
                name = _BARE_KEY.match(text, k)
                if not name:
                    k += 1
                    continue
                k = name.end()
                if _AFTER_KEY.match(text, k):
                    key.append(name.group())
                elif k >= len(text):
                    raise _CutOff
            else:
                value, k = _bare(text, k)
                put(value)
    except _CutOff:
        k = len(text)
        # the innermost item of a list that is not whole goes, and with it what is open inside of it
        if any(isinstance(box, list) for box, _ in stack):
            while not isinstance(stack[-1][0], list):
                stack.pop()
        elif stack:
            stack[-1][1].clear()
    while stack:
        close()
    return done, k


def repair(text: str | None) -> str | None:
    """The first object in ``text`` that has a member, as JSON; null where there is none.

    Words around it, fences and what follows go. Brackets that are missing are closed, where the text ends or where an
    outer one closes; strings may stand in single or typographic quotes, keys and words in none; commas may lack or be
    too many; comments go; words of Python become those of JSON; line ends and quotes inside of strings stay. An item
    of a list that the text breaks off in is dropped; one that lacks its bracket only is kept. Of equal keys the last
    counts. Texts that nest deeper than DEPTH are null.
    """
    at = 0
    while text and (at := text.find("{", at)) >= 0:
        try:
            value, end = _value_at(text, at)
        except ValueError:
            return None
        if value:
            return json.dumps(value, ensure_ascii=False)
        at = max(end, at + 1)
    return None


def repaired(text: Column) -> Column:
    """:func:`repair` of a column; null texts cost nothing."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repair, na_action="ignore").astype(object)

    return F.pandas_udf(run, StringType())(text)
