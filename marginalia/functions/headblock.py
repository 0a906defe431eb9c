"""Head blocks of notes with lists, nested maps and multi-line texts, as VARIANT values.

A head block is read line by line with a stack of indentations: a deeper line opens a list or map
inside the entry above it, a shallower one closes those that are deeper. Values on one line may be
lists and maps in brackets. Plain scalars are typed (nothing, truth values, numbers); dates stay text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = {"": None, "~": None, "null": None, "true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}
_INT = re.compile(r"[-+]?(0|[1-9][0-9_]*)$")
_FLOAT = re.compile(r"[-+]?([0-9][0-9_]*\.[0-9_]*|\.[0-9]+)(e[-+][0-9]+)?$", re.I)
_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[{&*!|>%@`,-][^\n]*?|-[^\s][^\n]*?))\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)\s*(?:#.*)?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}
_ESCAPED = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))")


def scalar(text: str):
    """A plain or quoted value."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        return _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[0]), text[1:-1])
    if text.lower() in _WORDS and (text.islower() or text.isupper() or text.istitle() or not text.isalpha()):
        return _WORDS[text.lower()]
    if _INT.match(text) and len(text) < 19:
        return int(text.replace("_", ""))
    if _FLOAT.match(text):
        return float(text.replace("_", ""))
    return text


def _uncommented(text: str) -> str:
    """A value without a comment behind it; signs inside quotes are part of the value."""
    quote = ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and (quote == "'" or text[i - 1] != "\\") else quote
        elif ch in "\"'" and (i == 0 or text[i - 1] in " [{,:"):
            quote = ch
        elif ch == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


def _inline(text: str, at: int = 0):
    """(value, end) of a value in brackets that begins at ``at``. Brackets are kept on a stack."""
    stack: list[tuple[object, object]] = []  # open list or map, and the key that waits for a value
    token, quoted, value, key = "", "", None, None

    def put(into, key, item):
        if isinstance(into, dict):
            into[str(item) if key is None else key] = None if key is None else item
        else:
            into.append({key: item} if key is not None else item)

    here: object = None
    done = False  # a bracketed value was just closed and waits to be stored
    i = at
    while i < len(text):
        ch = text[i]
        if quoted:
            token += ch
            if ch == quoted == text[i + 1 : i + 2] == "'":  # a doubled quote is a sign of the text
                token += ch
                i += 1
            elif ch == quoted and not (quoted == '"' and text[i - 1] == "\\"):
                quoted = ""
        elif ch in "\"'" and not token.strip():
            quoted, token = ch, ch
        elif ch in "[{":
            stack.append((here, key))
            here, key, token = [] if ch == "[" else {}, None, ""
        elif ch in ",]}":
            if done:
                put(here, key, value)
            elif token.strip() or key is not None:
                put(here, key, scalar(token))
            token, key, done = "", None, False
            if ch in "]}":
                value, done = here, True
                here, key = stack.pop()
                if not stack:
                    return value, i + 1
        elif ch == ":" and key is None and (text[i + 1 : i + 2] in (" ", "", "]", "}", ",") or token.strip()[-1:] in ("'", '"')):
            key, token = str(scalar(token)), ""
        elif not done:
            token += ch
        i += 1
    raise ValueError("a bracket is not closed")


def _value(text: str):
    text = _uncommented(text.strip())
    if text[:1] in ("[", "{"):
        found, end = _inline(text)
        if text[end:].strip():
            raise ValueError("text behind a bracket")
        return found
    return scalar(text)


def _folded(lines: list[str], style: str, keep: str) -> str:
    """A multi-line text: its least indentation goes, lines are joined as the style says."""
    filled = [x for x in lines if x.strip()]
    margin = min((len(x) - len(x.lstrip(" ")) for x in filled), default=0)
    lines = [x[margin:] if x.strip() else "" for x in lines]
    while lines and not lines[-1] and keep != "+":
        lines.pop()
    if style == "|":
        text = "\n".join(lines)
    else:
        text = ""
        for i, x in enumerate(lines):
            before = lines[i - 1] if i else None
            if before is None:
                text = x
            elif x and before and not x.startswith(" ") and not before.startswith(" "):
                text += " " + x
            elif x and not before and not x.startswith(" "):
                text += x
            else:
                text += "\n" + x
    return text if keep == "-" or not filled else text + "\n"


def read(block: str):
    """The value of a head block: usually a map. Raises ValueError where it is no such block."""
    lines = block.split("\n")
    root: list = []  # the whole block is the only item of this list
    stack: list[tuple[int, object]] = [(-1, root)]  # indentation, open list or map
    waiting: tuple[object, object] | None = (root, None)  # entry without a value yet: container and key
    plain: tuple[object, object, int] | None = None  # plain text that deeper lines may go on with

    def store(into, key, item) -> None:
        if isinstance(into, dict):
            into[key] = item
        else:
            into.append(item)

    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError("a tab in an indentation")
        depth = len(line) - len(line.lstrip(" "))
        if plain and depth > plain[2] and not _KEY.match(text):
            into, key, _ = plain
            into[key] = f"{into[key]} {_uncommented(text)}"
            continue
        plain = None
        while True:  # an entry may follow a dash, or several, on one line
            item = text == "-" or text.startswith("- ")
            while stack[-1][0] > depth or (stack[-1][0] == depth and isinstance(stack[-1][1], list) and not item):
                stack.pop()
                if waiting and waiting[0] is not root and not any(c is waiting[0] for _, c in stack):
                    store(*waiting, None)
                    waiting = None
            top = stack[-1][1]
            fits = stack[-1][0] == depth and isinstance(top, list if item else dict)
            if waiting and waiting[0] is top and fits and not (item and isinstance(top, dict)):
                store(*waiting, None)
                waiting = None
            if not fits or (waiting and item and isinstance(waiting[0], dict) and waiting[0] is top):
                if not waiting:
                    raise ValueError("an indentation that fits nothing above")
                if not item and not _KEY.match(text):
                    store(*waiting, _value(text))
                    waiting = None
                    break
                opened: object = [] if item else {}
                store(*waiting, opened)
                waiting = None
                stack.append((depth, opened))
                top = opened
            if item:
                waiting = (top, None)
                rest = text[1:]
                depth += 1 + len(rest) - len(rest.lstrip(" "))
                text = rest.strip()
                if not text or text.startswith("#"):
                    break
                if text == "-" or text.startswith("- ") or (_KEY.match(text) and text[0] not in "[{"):
                    continue
                key, rest = None, text
            else:
                found = _KEY.match(text)
                if not found:
                    raise ValueError("a line without a key")
                key, rest = str(scalar(found[1])) if found[1][0] in "\"'" else found[1].strip(), text[found.end() :].strip()
                waiting = (top, key)
                if not rest or rest.startswith("#"):
                    break
            waiting = None
            style = _BLOCK.match(rest)
            if style:
                inner = []
                own = stack[-1][0]
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > own):
                    inner.append(lines[i])
                    i += 1
                store(top, key, _folded(inner, style[1], style[2]))
                break
            store(top, key, _value(rest))
            last = top[key] if isinstance(top, dict) else top[-1]
            if isinstance(last, str) and rest[0] not in "\"'[{":
                plain = (top, key if isinstance(top, dict) else len(top) - 1, stack[-1][0])
            break
    if waiting and waiting[0] is not root:
        store(*waiting, None)
    return root[0] if root else None


@F.pandas_udf(T.StringType())
def _as_json(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(block: str | None) -> str | None:
        if not block:
            return None
        try:
            return json.dumps(read(block), ensure_ascii=False)
        except (ValueError, IndexError, TypeError, AttributeError, RecursionError):
            return None  # no head block after all; the note is read without one

    for part in blocks:
        yield part.map(one)


def values(block: Column) -> Column:
    """The text between the head marks as a VARIANT; null where it cannot be read."""
    return F.try_parse_json(_as_json(block))


def texts(variant: Column, path: str) -> Column:
    """A list of texts at a path; one text counts as a list of one, other kinds are left out."""
    many = F.try_variant_get(variant, path, "array<variant>")
    one = F.when(F.schema_of_variant(F.try_variant_get(variant, path, "variant")) == "STRING", F.array(F.try_variant_get(variant, path, "variant")))
    listed = F.coalesce(many, one, F.array().cast("array<variant>"))
    return F.filter(F.transform(listed, lambda v: F.try_variant_get(v, "$", "string")), lambda s: s.isNotNull())
