"""SQL text with its literals set aside, so that patterns never look inside quotes or comments."""

from __future__ import annotations

import re

QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
MARK = re.compile("\x01(\\d+)\x01")
#: A set-aside literal, as patterns name it.
LIT = "\x01(\\d+)\x01"


def hide(text: str) -> tuple[str, list[str]]:
    """The text with a mark for each quoted part and a blank for each comment, and the parts."""
    kept: list[str] = []

    def take(m: re.Match) -> str:
        if m[0][:2] in ("--", "/*"):
            return " "
        kept.append(m[0])
        return f"\x01{len(kept) - 1}\x01"

    return QUOTED.sub(take, text), kept


def value(part: str) -> str:
    """What a quoted part says."""
    return part[1:-1].replace("''", "'") if part[0] == "'" else part[1:-1]


def show(text: str, kept: list[str]) -> str:
    """The text with its parts as Spark writes them: a doubled quote is one quote, a backslash is itself."""

    def put(m: re.Match) -> str:
        part = kept[int(m[1])]
        if part[0] == "'":
            return "'" + value(part).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "`" + value(part) + "`"

    return MARK.sub(put, text)


def words(hidden: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Za-z_]\w*", hidden)}


def split_list(text: str, sign: str = ",") -> list[str]:
    """Parts of a list outside parentheses."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "([") - (ch in ")]")
        if ch == sign and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


DEPTH, NOTS, CTES = 50, 100, 16


def check_depth(hidden: str) -> None:
    """Limits on what a statement may nest: parentheses, NOTs, common table expressions."""
    depth = most = 0
    for ch in hidden:
        depth += (ch == "(") - (ch == ")")
        most = max(most, depth)
    if most > DEPTH or len(re.findall(r"\bNOT\b", hidden, re.I)) > NOTS or len(re.findall(r"\w+\s+AS\s*\(\s*(?:SELECT|WITH)\b", hidden, re.I)) > CTES:
        raise ValueError("nested too deeply")
