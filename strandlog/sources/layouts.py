"""Regexes from layouts: a line as its documentation prints it, with <name> or <name:kind> where values stand."""

from __future__ import annotations

import re

#: What a value of a kind looks like. Without a kind a value goes to the character that follows it in the layout.
KINDS = {
    "int": r"\d+",
    "signed": r"-?\d+",
    "number": r"\d+(?:\.\d+)?",
    "decimal": r"\d+\.\d+",
    "hex": r"0x[\da-fA-F]+",
    "uuid": r"[\da-f]{8}-[\da-f]{4}-[\da-f]{4}-[\da-f]{4}-[\da-f]{12}",
    "word": r"\S+",
    "phrase": r"[^;=\n]*[^;=\s]",
    "letters": r"[A-Za-z]+",
    "code": r"(?:\d+|-)",
    "real": r"-?\d+(?:\.\d+)?",
    "stem": r'[^ ?"]+',
    "stamp": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "slashed": r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d [+-]\d\d:\d\d",
    "compact": r"\d{8} \d\d:\d\d:\d\d\.\d{3}",
    "month": r"[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d",
    "weekday": r"[A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]?\d \d\d:\d\d:\d\d (?:[A-Z]{3,4} )?\d{4}",
    "halfday": r"\d\d/\d\d/\d{4} \d\d:\d\d:\d\d:\d{3} [AP]M [A-Z]+",
    "clf": r"\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}",
    "rest": r".*",
    "line": r"[^\n]+",
    "text": r"[\s\S]*",
}


def _literal(text: str) -> str:
    return "".join("\\n" if ch == "\n" else re.escape(ch) for ch in text)


def layout(text: str) -> str:
    """The regex of a layout. A run of blanks stands for one or more, `[[` and `]]` enclose what may be missing, <> skips a word."""
    parts = re.split(r"(\[\[|\]\]|<\w*(?::\w+)?>)", text)
    out = []
    for i, part in enumerate(parts):
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif part == "<>":
            out.append(r"\S*")
        elif i % 2:
            name, _, kind = part[1:-1].partition(":")
            follows = next((p[0] for p in parts[i + 1 :] if p and p not in ("[[", "]]")), "\n")
            out.append(f"(?<{name}>{KINDS[kind] if kind else '[^' + _literal(follows + chr(10)) + ']*'})")
        else:
            out += [" +" if run.isspace() and "\n" not in run else _literal(run) for run in re.findall(r" +|[^ ]+", part)]
    return "".join(out)


def columns(*names: str) -> str:
    """The layout of a table's row: values between runs of blanks."""
    return " ".join(f"<{n}>" if ":" in n else f"<{n}:word>" for n in names)
