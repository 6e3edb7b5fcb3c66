"""Settings files: JSON, or the part of YAML that settings use, over nested defaults.

Read are maps by indentation, lists of ``- item``, ``[a, b]`` and ``{}``, plain, single- and double-quoted values and comments. Tabs in the
indentation, a key that stands twice in one map, lines that belong to nothing and block scalars are errors that name their line.
"""

from __future__ import annotations

import json
import re
from typing import Any

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:'"\[\]{}][^:#]*?)\s*:(?:\s+(.*)|$)""")
_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}


class SettingsError(ValueError):
    pass


def _without_comment(line: str) -> str:
    """The line up to a ``#`` that stands outside quotes, at the start or after a space."""
    quote = ""
    for i, char in enumerate(line):
        if quote:
            quote = "" if char == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif char in "'\"" and (i == 0 or line[i - 1] in " [,:-"):
            quote = char
        elif char == "#" and (i == 0 or line[i - 1] == " "):
            return line[:i]
    return line


def _items(inner: str) -> list[str]:
    """The parts of ``a, "b, c"`` between commas outside quotes."""
    return [x.strip() for x in re.findall(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,])+""", inner) if x.strip()]


def value_of(text: str, number: int) -> Any:
    text = text.strip()
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return json.loads(text)
    if text.startswith("'") and text.endswith("'") and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text.startswith("[") and text.endswith("]"):
        return [value_of(x, number) for x in _items(text[1:-1])]
    if text == "{}":
        return {}
    if text[:1] in ("|", ">", "&", "*", "!", "{", "[", '"', "'"):
        raise SettingsError(f"line {number}: {text!r} is not understood")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if _NUMBER.fullmatch(text):
        return float(text) if any(x in text for x in ".eE") else int(text)
    return text


def parse(content: str) -> Any:
    """The value of a settings text; an empty one is an empty map."""
    lines = []
    for number, line in enumerate(content.splitlines(), 1):
        kept = _without_comment(line).rstrip()
        if not kept.strip() or kept.strip() == "---":
            continue
        indent = len(kept) - len(kept.lstrip())
        if "\t" in kept[:indent]:
            raise SettingsError(f"line {number}: a tab in the indentation")
        lines.append((indent, kept.strip(), number))

    def block(at: int, indent: int) -> tuple[Any, int]:
        """The map or list whose lines begin at ``indent``, and the line behind it."""
        is_list = lines[at][1] == "-" or lines[at][1].startswith("- ")
        out: Any = [] if is_list else {}
        while at < len(lines) and lines[at][0] >= indent:
            depth, text, number = lines[at]
            if is_list and depth == indent and not (text == "-" or text.startswith("- ")):
                break  # the key after a list that stands as deep as its own key
            if depth > indent or is_list != (text == "-" or text.startswith("- ")):
                raise SettingsError(f"line {number}: {text!r} belongs to nothing")
            if is_list:
                text = text[1:].strip()
                if _KEY.fullmatch(text):  # a map within the list: its first key stands behind the dash
                    lines[at] = (indent + 2, text, number)
                    value, at = block(at, indent + 2)
                elif text:
                    value, at = value_of(text, number), at + 1
                else:
                    value, at = inner(at + 1, indent)
                out.append(value)
                continue
            found = _KEY.fullmatch(text)
            if not found:
                raise SettingsError(f"line {number}: {text!r} is no key: value")
            key = str(value_of(found[1], number)) if found[1][0] in "'\"" else found[1]
            if key in out:
                raise SettingsError(f"line {number}: {key!r} stands twice")
            out[key], at = (value_of(found[2], number), at + 1) if (found[2] or "").strip() else inner(at + 1, indent, lists_too=True)
        return out, at

    def inner(at: int, indent: int, lists_too: bool = False) -> tuple[Any, int]:
        """What stands below a key or dash: deeper lines, a list at the same depth below a key, or nothing."""
        if at < len(lines) and (lines[at][0] > indent or (lists_too and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")))):
            return block(at, lines[at][0])
        return None, at

    if not lines:
        return {}
    value, end = block(0, lines[0][0])
    if end < len(lines):
        raise SettingsError(f"line {lines[end][2]}: {lines[end][1]!r} belongs to nothing")
    return value


def merged(defaults: dict, found: dict, path: str = "") -> dict:
    """``found`` over ``defaults``, map by map; a key without a default, and a map in the place of a value or the other way round, are errors."""
    if unknown := [f"{path}{key}" for key in found if key not in defaults]:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = dict(defaults)
    for key, value in found.items():
        if isinstance(defaults[key], dict) and defaults[key]:
            if not isinstance(value, dict):
                raise ValueError(f"{path}{key} is a section")
            value = merged(defaults[key], value, f"{path}{key}.")
        elif isinstance(value, dict) and value and not isinstance(defaults[key], dict):
            raise ValueError(f"{path}{key} is no section")
        out[key] = value
    return out
