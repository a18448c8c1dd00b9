"""JSON of any depth: the standard reader and writer, and a reader and writer with a stack of their own where those would recurse too far."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:(\.[0-9]+)?([eE][-+]?[0-9]+)?)")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def read(text: str):
    """The value a text holds; ValueError where it is not one JSON value."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str):
    skip = lambda i: _SPACE.match(text, i).end()
    holders: list = []  # open arrays and objects
    names: list = []  # for an open object the name whose value comes next
    i = skip(0)
    while True:
        # one value, or the opening of one
        c = text[i : i + 1]
        if c in ("[", "{"):
            holder = [] if c == "[" else {}
            i = skip(i + 1)
            if text[i : i + 1] == ("]" if c == "[" else "}"):
                value, i = holder, i + 1
            else:
                name = None
                if c == "{":
                    name, i = _name(text, i, skip)
                holders.append(holder)
                names.append(name)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif (m := _NUMBER.match(text, i)) is not None:
            value, i = (float if m[1] or m[2] else int)(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(f"no JSON value at {i}")
            value, i = _WORDS[word], i + len(word)
        # the value is whole: give it to its holder, and close what ends here
        while True:
            i = skip(i)
            if not holders:
                if i != len(text):
                    raise ValueError(f"more after the value at {i}")
                return value
            holder = holders[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[names[-1]] = value
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(holder, dict):
                    names[-1], i = _name(text, i, skip)
                break
            if c != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"neither comma nor end at {i}")
            value, i = holders.pop(), i + 1
            names.pop()


def _name(text: str, i: int, skip) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError(f"no name at {i}")
    name, i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return name, skip(i + 1)


def write(value) -> str:
    """The value as JSON text, letters as they are."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [("value", value)]
    while stack:
        kind, v = stack.pop()
        if kind == "text":
            out.append(v)
        elif isinstance(v, dict):
            stack.append(("text", "}"))
            for k, (name, item) in reversed(list(enumerate(v.items()))):
                stack += [("value", item), ("text", f"{', ' if k else ''}{json.dumps(name, ensure_ascii=False)}: ")]
            stack.append(("text", "{"))
        elif isinstance(v, list):
            stack.append(("text", "]"))
            for k, item in reversed(list(enumerate(v))):
                stack += [("value", item), ("text", ", " if k else "")]
            stack.append(("text", "["))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def map_texts(value, change, skip=frozenset()):
    """The same value with every text changed, but not those under a skipped name; any depth."""
    root = [value]
    stack: list = [(root, 0)]
    while stack:
        holder, at = stack.pop()
        v = holder[at]
        if isinstance(v, str):
            holder[at] = change(v)
        elif isinstance(v, list):
            holder[at] = copy = list(v)
            stack += [(copy, i) for i in range(len(copy) - 1, -1, -1)]
        elif isinstance(v, dict):
            holder[at] = copy = dict(v)
            stack += [(copy, k) for k in reversed(list(copy)) if k not in skip]
    return root[0]
