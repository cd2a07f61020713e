"""Pseudonyms: personal tokens of texts replaced by stand-ins of the same form, no two values by the same one.

A stand-in is a keyed permutation of the token's form (a Feistel network over its letters and digits, or over the 32 bits
of an address): an address stays an address, a card number keeps its spaces, a word its capitals. Being a permutation, it
gives distinct values distinct stand-ins without a table of what was seen, so partitions need not agree on anything. In
addresses, URLs and paths each run of letters and digits is permuted on its own, so that a host has one stand-in wherever
it stands. Only who has the salt can tell or undo it.

Hex digits count by their value, whichever case they are in. A null text stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlog.operators.shared import spread

ROUNDS = 8
REMEMBER = 100_000

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The kinds of tokens, in the order they are tried; words only where they are asked for.
KINDS = (
    ("tag", r"<[A-Za-z][\w:.-]*\s[^<>]*>"),
    ("url", r"\b[a-z][a-z0-9+.-]*://[^\s\"'<>]+"),
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("uuid", r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"),
    ("mac", r"\b[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){5}\b"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}\b"),
    ("dump", r"\b[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){2,}\b"),
    ("ipv4", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w.]*\w)"),
    ("path", r"\B/(?:[\w.-]+/)+[\w.-]*"),
    ("card", r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b"),
    ("phone", r"\+\d[\d ()-]{7,}\d"),
    ("hex", r"\b0x[0-9a-fA-F]+\b"),
    ("digest", r"\b[0-9a-f]{16,}\b"),
)
WORD = ("word", r"[A-Za-z]{5,}")

_RUNS = re.compile(rf"%[0-9A-Fa-f]{{2}}|(?P<ipv4>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w.]*\w))|(?P<run>[A-Za-z0-9]+)")
_VALUES = re.compile(r"""(=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)""")


class Permuter:
    """Stand-ins under one salt."""

    def __init__(self, salt: str):
        self.key = hashlib.blake2b(salt.encode(), digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _stream(self, tweak: bytes, values: list[int], n: int) -> list[int]:
        """n numbers below 2**32 that depend on the key, the tweak and the values."""
        seed = b"%b|%b" % (tweak, ",".join(map(str, values)).encode())
        out = b"".join(hashlib.blake2b(seed, digest_size=64, key=self.key, salt=i.to_bytes(8, "big")).digest() for i in range((n + 15) // 16))
        return [int.from_bytes(out[4 * i : 4 * i + 4], "big") for i in range(n)]

    def permute(self, values: list[int], sizes: list[int], form: str) -> list[int]:
        """A permutation of all lists of numbers below these sizes; another one for each form."""
        half = len(values) // 2
        sides, limits = [values[:half], values[half:]], [sizes[:half], sizes[half:]]
        for i in range(ROUNDS):
            a, b = i % 2, 1 - i % 2
            moves = self._stream(b"%d|%b" % (i, form.encode()), sides[b], len(sides[a]))
            sides[a] = [(x + m) % s for x, m, s in zip(sides[a], moves, limits[a])]
        return sides[0] + sides[1]

    def letters(self, text: str) -> str:
        """ASCII letters and digits permuted, each among those of its kind."""
        at, values, sizes, form = [], [], [], []
        for i, ch in enumerate(text):
            base, size = ("0", 10) if "0" <= ch <= "9" else ("a", 26) if "a" <= ch <= "z" else ("A", 26) if "A" <= ch <= "Z" else ("", 0)
            form.append(base or ch)
            if size:
                at.append(i)
                values.append(ord(ch) - ord(base))
                sizes.append(size)
        out = list(form)
        for i, v in zip(at, self.permute(values, sizes, "".join(form))):
            out[i] = chr(ord(form[i]) + v)
        return "".join(out)

    def hexadecimal(self, text: str) -> str:
        """Hex digits permuted; in capitals where the text has no small letter but a capital one."""
        prefix, digits = ("0x", text[2:]) if text.startswith("0x") else ("", text)
        at = [i for i, ch in enumerate(digits) if ch in "0123456789abcdefABCDEF"]
        form = ["x" if ch in "0123456789abcdefABCDEF" else ch for ch in digits]
        mixed = self.permute([int(digits[i], 16) for i in at], [16] * len(at), "hex" + "".join(form))
        show = "0123456789ABCDEF" if digits.upper() == digits != digits.lower() else "0123456789abcdef"
        for i, v in zip(at, mixed):
            form[i] = show[v]
        return prefix + "".join(form)

    def ipv4(self, text: str) -> str:
        """The 32 bits permuted, in halves of 16."""
        a, b, c, d = map(int, text.split("."))
        high, low = self.permute([a << 8 | b, c << 8 | d], [1 << 16, 1 << 16], "ipv4")
        return f"{high >> 8}.{high & 255}.{low >> 8}.{low & 255}"

    def runs(self, text: str) -> str:
        """Every run of letters and digits on its own; addresses stay addresses, %20 and the like stay."""
        return _RUNS.sub(lambda m: self.of("ipv4", m[0]) if m["ipv4"] else self.of("run", m[0]) if m["run"] else m[0], text)

    def of(self, kind: str, text: str) -> str:
        """The stand-in of a token of a kind."""
        found = self.known.get((kind, text))
        if found is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            found = self.known[kind, text] = self._of(kind, text)
        return found

    def _of(self, kind: str, text: str) -> str:
        if kind == "url":
            scheme, rest = text.split("://", 1)
            return f"{scheme}://{self.runs(rest)}"
        if kind == "tag":  # names stay, values go by runs
            return _VALUES.sub(lambda m: m[1] + self.runs(m[2]), text)
        if kind in ("email", "path"):
            return self.runs(text)
        if kind == "ipv4":
            return self.ipv4(text)
        if kind in ("uuid", "mac", "ipv6", "dump", "hex", "digest"):
            return self.hexadecimal(text)
        return self.letters(text)


def _pattern(words: bool) -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in (*KINDS, *([WORD] if words else []))), re.ASCII)


def anonymize(df: DataFrame, column: str, salt: str = "", words: bool = False) -> DataFrame:
    """df with the tokens of KINDS in the column replaced by their stand-ins; words: words of five letters or more as well."""
    pattern, schema = _pattern(words).pattern, df.schema
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, p = re.compile(pattern, re.ASCII), Permuter(salt)
        for batch in batches:
            out = [None if t is None else find.sub(lambda m: p.of(m.lastgroup, m[0]), t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(out, pa.string()))

    return spread(df).mapInArrow(run, schema)


#: The kinds of tokens of hashed(), in the order they are tried; without what some engines' regexes lack, so that SQL can say it.
PLAIN_KINDS = (
    ("url", r"\b[a-z][a-z0-9+.-]*://[^\t-\r \"'<>]+"),
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("uuid", r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"),
    ("mac", r"\b[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){5}\b"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("short ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}\b"),
    ("ipv4", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("path", r"\B/(?:[\w.-]+/)+[\w.-]*"),
    ("card", r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b"),
    ("phone", r"\+\d[\d ()-]{7,}\d"),
    ("hex", r"\b0x[0-9a-fA-F]+\b"),
    ("digest", r"\b[0-9a-f]{16,}\b"),
)
PLAIN = "|".join(f"(?:{pattern})" for _, pattern in PLAIN_KINDS)
#: Words that stand-ins begin with.
STAND_INS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "inlet", "jetty", "knoll", "larch", "maple", "north", "ocean", "petal")


def hashed(df: DataFrame, column: str, name: str, salt: str = "") -> DataFrame:
    """df with `name`: the column's text with the tokens of PLAIN_KINDS replaced by their SHA-256 under the salt.

    A stand-in is two words and 62 hex digits, which together are the whole hash, so that no two values are known to share one.
    """
    pattern, at, new = PLAIN, df.columns.index(column), name not in df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]) if new else df.schema

    def of(m: re.Match) -> str:
        h = hashlib.sha256((salt + m[0]).encode()).hexdigest()
        return f"{STAND_INS[int(h[0], 16)]}-{STAND_INS[int(h[1], 16)]}-{h[2:]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern, re.ASCII)
        for batch in batches:
            out = pa.array([None if t is None else find.sub(of, t) for t in batch.column(at).to_pylist()], pa.string())
            if new:
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])
            else:
                yield batch.set_column(batch.schema.get_field_index(name), name, out)

    return spread(df).mapInArrow(run, schema)


def stand_ins(df: DataFrame, value: str, kind: str, name: str = "stand_in", salt: str = "") -> DataFrame:
    """df with the stand-in of each value, a whole token of the kind that its row names."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(salt)
        for batch in batches:
            out = [None if v is None or k is None else p.of(k, v) for v, k in zip(batch.column(value).to_pylist(), batch.column(kind).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(out, pa.string())], [*kept, name])

    return df.mapInArrow(run, schema)
