"""A scanner for lists of records as models write them: JSON, Python literals, ``dict(...)`` calls, and mixtures.

Grammar, from which the scanner is written::

    answer  := item (","? item)*                      an outer list may be missing
    item    := list | record | scalar
    list    := ("[" | "(" | "list[" | "list(") item* closer
    record  := ("{" | "dict[" | "dict(") (key (":" | "=") item)* closer
    closer  := "]" | ")" | "}"                        any of them ends the innermost open bracket
    scalar  := quoted string | number | true, false, null and Python's names of these | bare words

Commas may be missing or stand last; closers that are missing at the end are added; a record that opens where a key is
due ends the record before it. A quote ends a string only before a separator, a closer, a quote or the end. Brackets are
kept on a stack of at most MOST_DEPTH; each character is looked at a fixed number of times.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

#: Brackets inside brackets beyond which a text is not read, and characters beyond which a number stays text.
MOST_DEPTH, LONG_NUMBER = 256, 40

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<open>(?:list|dict)\s*[\[(] | [\[{(])
    | (?P<close>[\])}])
    | (?P<comma>[,;])
    | (?P<sep>[:=])
    | (?P<string>"(?:[^"\\]|\\.|"(?!\s*(?:[,;:=\])}"]|\Z)))*" | '(?:[^'\\]|\\.|'(?!\s*(?:[,;:=\])}']|\Z)))*')
    | (?P<cut>["'].*)
    | (?P<bare>[^\s\[\](){},;:="'][^\s\[\](){},;:="]*)
    )""",
    re.X | re.S,
)
_NUMBER = re.compile(r"[+-]?(?:\d+(?P<point>\.\d*)?|\.\d+)(?P<power>[eE][+-]?\d+)?")
_NAMES = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)

#: Where an answer's list may begin, in order of preference.
FENCE = re.compile(r"```json\s*(?=\[)")
RECORDS = re.compile(r"\[\s*\{")
CALLS = re.compile(r"\b(?:list\s*\[\s*)?dict\s*[\[(]")


def _unquoted(token: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), token)


def _scalar(words: str) -> Any:
    if words in _NAMES:
        return _NAMES[words]
    m = _NUMBER.fullmatch(words) if len(words) <= LONG_NUMBER else None
    if not m:
        return words
    if not (m["power"] or "." in words):
        return int(words)
    return float(words) if math.isfinite(float(words)) else words


class _Frame:
    """An open bracket: its items, and for a record the key that waits for a value."""

    def __init__(self, record: bool):
        self.record, self.value, self.key, self.due = record, {} if record else [], None, False

    def take(self, item: Any) -> None:
        if not self.record:
            self.value.append(item)
        elif self.due:
            self.value[str(self.key)], self.due, self.key = item, False, None
        else:
            self.key = item if isinstance(item, str) else json.dumps(item)


def scan(text: str, start: int = 0) -> list | None:
    """The records or items from ``start`` on, up to the end of the outer list or of the last item that follows
    directly; None where nothing can be read."""
    stack, at, bare = [_Frame(False)], start, None
    opened = False

    def flush() -> None:
        nonlocal bare
        if bare:
            stack[-1].take(_scalar(text[bare[0] : bare[1]]))
            bare = None

    def close() -> None:
        done = stack.pop()
        if done.due:  # a key without a value
            done.value[str(done.key)] = None
        stack[-1].take(done.value)

    while m := _TOKEN.match(text, at):
        kind, token = m.lastgroup, m[m.lastgroup]
        if kind == "bare" and len(stack) == 1 and opened:
            break  # prose after the list
        at = m.end()
        if kind == "bare":
            bare = (bare[0] if bare else m.start("bare"), m.end("bare"))
            continue
        flush()
        top = stack[-1]
        if kind == "open":
            record = token[0] in "{d"
            if record and top.record and not top.due:
                close()  # a record where a key is due
            if len(stack) > MOST_DEPTH:
                return None
            stack.append(_Frame(record))
            opened = True
        elif kind == "close":
            if len(stack) == 1:
                break
            outer = len(stack) == 2 and not stack[-1].record
            close()
            if outer:
                break
        elif kind == "sep":
            if top.record and not top.due and top.key is not None:
                top.due = True
        elif kind == "comma":
            if top.record and top.due:
                top.take(None)
        else:
            top.take(_unquoted(token[1:-1] if kind == "string" else token[1:]))
    flush()
    while len(stack) > 1:
        close()
    items = stack[0].value
    if len(items) == 1 and isinstance(items[0], list):
        items = items[0]
    return items if opened or items else None


def read_records(reply: str) -> list:
    """The list of a whole reply: of a JSON block, else of the first list of records, else, with an answer block, of calls."""
    for pattern, needed in ((FENCE, ""), (RECORDS, ""), (CALLS, "<answer>")):
        m = pattern.search(reply)
        if m and needed in reply:
            return scan(reply, m.end() if pattern is FENCE else m.start()) or []
    return []
