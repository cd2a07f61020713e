"""Scalar helpers on strings, numbers, paths and JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in rising order.
LEVELS = ("unknown", "trace", "debug5", "debug4", "debug3", "debug2", "debug", "info", "stats", "notice", "warning", "error", "critical", "fatal", "invalid")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- sort keys that stand for the collations ---------------------------------


def natural_key(x: Column | str, nocase: bool = False) -> Column:
    """Digit runs compare as numbers: each gets its length before it, as a digit for every nine and one for the rest."""
    s = F.lower(c(x)) if nocase else c(x)
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.repeat(F.lit("9"), F.floor(F.length(number(p)) / 9).cast("int")), (F.length(number(p)) % 9).cast("string"), number(p))).otherwise(p)), "")


def ipv4_number(x: Column | str) -> Column:
    """A dotted address, plain or mapped into v6, as a number; null for anything else."""
    m = F.regexp_extract(c(x), r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    p = F.transform(F.split(m, r"\."), lambda v: v.cast("bigint"))
    ok = (m != "") & F.forall(F.split(F.when(m != "", m).otherwise("0"), r"\."), lambda v: v.cast("bigint") <= 255)
    return F.when(ok, F.aggregate(F.when(m != "", p).otherwise(F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, v: a * 256 + v))


def ip_key(x: Column | str) -> Column:
    """Addresses by number, after everything that is none."""
    n = ipv4_number(x)
    return F.struct(n.isNotNull().alias("is_ip"), n.alias("number"), natural_key(x, True).alias("rest"))


def level_ordinal(x: Column | str) -> Column:
    """A level's place; its first letters do as well."""
    s = F.lower(F.trim(c(x)))
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(LEVELS))):
        out = F.when(F.length(s).between(1, len(name)) & F.startswith(F.lit(name), s), i).otherwise(out)
    return out


def measure(x: Column | str) -> Column:
    """A number with a size or time unit, or h:m:s, as a double; null for anything else."""
    s = F.trim(c(x))
    pattern = r"^(-?\d+(?:\.\d+)?)\s*([KMGTPE])?(i)?(?:[bB](?:/s)?)?$"
    value, unit, binary = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3))
    power = F.instr(F.lit("KMGTPE"), F.nullif(unit, F.lit("")))
    size = F.try_divide(value.try_cast("double"), F.lit(1.0)) * F.pow(F.when(binary != "", 1024.0).otherwise(1000.0), F.coalesce(power, F.lit(0)))
    second = r"^(-?\d+(?:\.\d+)?)\s*([munpf]?)s$"
    scale = F.pow(F.lit(1000.0), -F.coalesce(F.instr(F.lit("munpf"), F.nullif(F.regexp_extract(s, second, 2), F.lit(""))), F.lit(0)))
    clock = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$"
    h, m, sec = (F.coalesce(F.nullif(F.regexp_extract(s, clock, i), F.lit("")).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3))
    return (
        F.when(s.rlike(pattern), size).when(s.rlike(second), F.regexp_extract(s, second, 1).try_cast("double") * scale).when(s.rlike(clock), h * 3600 + m * 60 + sec)
    )


# -- strings -------------------------------------------------------------------


def pad_left(x: Column | str, n: int, fill: str = " ") -> Column:
    return F.lpad(c(x), F.greatest(F.lit(n), F.length(c(x))), fill)


def pad_right(x: Column | str, n: int, fill: str = " ") -> Column:
    return F.rpad(c(x), F.greatest(F.lit(n), F.length(c(x))), fill)


def pad_centre(x: Column | str, n: int) -> Column:
    left = F.greatest(F.floor((F.lit(n) - F.length(c(x))) / 2), F.lit(0))
    return pad_right(F.concat(F.repeat(F.lit(" "), left.cast("int")), c(x)), n)


def only_characters(x: Column | str, allowed: str) -> Column:
    return F.regexp_replace(c(x), "[^" + "".join("\\" + ch if ch in "\\]^-[" else ch for ch in allowed) + "]", "")


def soundex_difference(a: Column | str, b: Column | str) -> Column:
    """How many of the four places of the soundex codes are equal."""
    x, y = F.soundex(c(a)), F.soundex(c(b))
    return sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("bigint") for i in range(1, 5))


def greatest_or_null(*xs: Column | str) -> Column:
    """The greatest value, null if any is null."""
    some = F.lit(False)
    for x in xs:
        some = some | c(x).isNull()
    return F.when(~some, F.greatest(*map(c, xs)))


def least_or_null(*xs: Column | str) -> Column:
    some = F.lit(False)
    for x in xs:
        some = some | c(x).isNull()
    return F.when(~some, F.least(*map(c, xs)))


def coth(x: Column | str) -> Column:
    return 1 / F.tanh(c(x))


# -- paths -----------------------------------------------------------------------


def base_name(x: Column | str) -> Column:
    s = F.regexp_replace(c(x), r"(?<=.)/+$", "")
    return F.when(c(x) == "", ".").when(s == "/", "/").otherwise(F.regexp_extract(s, r"([^/]*)$", 1))


def dir_name(x: Column | str) -> Column:
    s = F.regexp_replace(c(x), r"(?<=.)/+$", "")
    head = F.regexp_extract(s, r"^(.*)/[^/]*$", 1)
    return F.when(~s.contains("/"), ".").when((head == "") | s.rlike(r"^/+[^/]*$"), "/").otherwise(F.regexp_replace(head, r"(?<=.)/+$", ""))


def join_path(*parts: Column | str) -> Column:
    """Parts with one slash between; an absolute part starts afresh."""
    out = c(parts[0])
    for p in parts[1:]:
        p = c(p)
        out = F.when(p.startswith("/") | (out == ""), p).when(out.endswith("/"), F.concat(out, p)).otherwise(F.concat(out, F.lit("/"), p))
    return out


# -- humanised values -----------------------------------------------------------------


def humanize_size(x: Column | str) -> Column:
    """Bytes in powers of 1000 with one decimal, whole below 1000."""
    n = c(x).cast("double")
    out = F.concat(n.cast("bigint").cast("string"), F.lit("B"))
    for i, unit in enumerate("KMGTPE", 1):
        out = F.when(F.abs(n) >= 1000.0**i, F.concat(F.format_string("%.1f", n / 1000.0**i), F.lit(f"{unit}B"))).otherwise(out)
    return out


def humanize_duration(seconds: Column | str) -> Column:
    """As 1d02h03m, 2h03m04s, 3m04s or 4s500."""
    ms = F.round(c(seconds).cast("double") * 1000).cast("bigint")
    part = lambda unit, mod: F.floor(ms / unit) % mod
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    d, h, m, s = F.floor(ms / 86_400_000), part(3_600_000, 24), part(60_000, 60), part(1000, 60)
    return (
        F.when(ms >= 86_400_000, F.concat(d.cast("string"), F.lit("d"), two(h), F.lit("h"), two(m), F.lit("m")))
        .when(ms >= 3_600_000, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(s), F.lit("s")))
        .when(ms >= 60_000, F.concat(m.cast("string"), F.lit("m"), two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s"), F.lpad((ms % 1000).cast("string"), 3, "0")))
    )


BARS = " ▁▂▃▄▅▆▇█"


def spark_bar(value: Column | str, upper: Column | float = 100.0) -> Column:
    """One bar glyph for a value between 0 and upper."""
    top = upper if isinstance(upper, Column) else F.lit(float(upper))
    at = F.greatest(F.lit(0), F.least(F.lit(8), F.ceil(c(value).cast("double") / F.nullif(top, F.lit(0.0)) * 8))).cast("int")
    return F.substring(F.lit(BARS), F.coalesce(at, F.lit(0)) + 1, F.lit(1))


# -- regex and JSON --------------------------------------------------------------------


def typed(text: Column) -> Column:
    """'integer', 'float' or 'text' for what a captured text holds."""
    return F.when(text.rlike(r"^[-+]?\d{1,18}$"), "integer").when(text.rlike(r"^[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?$"), "float").otherwise("text")


def captures_json(text: Column | str, pattern: str, names: list[str]) -> Column:
    """For each match of pattern the named captures as a JSON object, numbers unquoted: an array of texts."""
    groups = [F.regexp_extract_all(c(text), F.lit(pattern), F.lit(i)) for i in range(1, len(names) + 1)]
    def one(i: Column) -> Column:
        fields = []
        for name, g in zip(names, groups):
            v = F.get(g, i)
            fields.append(F.concat(F.lit(f'"{name}":'), F.when(typed(v) == "text", F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)).otherwise(v)))
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return F.transform(F.sequence(F.lit(0), F.size(groups[0]) - 1), one) if names else F.array()


def json_pointer(text: Column | str, pointer: str, default: str | None = None) -> Column:
    """The value at an RFC 6901 pointer, as text."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)
    found = F.get_json_object(c(text), path)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def json_contains(text: Column | str, value: str) -> Column:
    """Whether a top-level element, or the value itself, equals value; never what objects hold."""
    items = F.from_json(c(text), "array<string>")
    is_list = F.ltrim(c(text)).startswith("[")
    scalar = F.regexp_replace(F.trim(c(text)), r'^"(.*)"$', "$1")
    return F.when(is_list, F.coalesce(F.array_contains(items, value), F.lit(False))).when(F.ltrim(c(text)).startswith("{"), F.lit(False)).otherwise(scalar == value)


# -- encodings, hashes, regex matches, dates ---------------------------------------------------------


def encode(x: Column | str, how: str) -> Column:
    """The UTF-8 bytes as base64 or hex, or a text as part of a URI."""
    return {"base64": F.base64(c(x).cast("binary")), "hex": F.hex(c(x).cast("binary")), "uri": F.replace(F.url_encode(c(x)), F.lit("+"), F.lit("%20"))}[how]


def decode(x: Column | str, how: str) -> Column:
    return {"base64": F.unbase64(c(x)).cast("string"), "hex": F.unhex(c(x)).cast("string"), "uri": F.try_url_decode(F.replace(c(x), F.lit("+"), F.lit("%2B")))}[how]


def hash_key(*xs: Column | str) -> Column:
    """A 64-bit hash of values, each with its length, so that ("ab", "c") and ("a", "bc") differ and null is a value."""
    return F.xxhash64(*(part for x in xs for part in (F.coalesce(F.length(c(x).cast("string")), F.lit(-1)), c(x).cast("string"))))


def regexp_match(x: Column | str, pattern: str) -> Column:
    """The capture of the first match as a text; of several captures a JSON object by name (or col_0, col_1), numbers unquoted."""
    import re

    plain = re.sub(r"\(\?P?<\w+>", "(", pattern)
    named = re.findall(r"(?<!\\)\((?:\?P?<(\w+)>|(?!\?))", pattern)
    if len(named) == 1:
        return F.when(c(x).rlike(plain), F.regexp_extract(c(x), plain, 1))
    names = [n or f"col_{i}" for i, n in enumerate(named)]
    return F.get(captures_json(c(x), plain, names), F.lit(0)) if names else F.when(c(x).rlike(plain), F.regexp_extract(c(x), plain, 0))


# Letters of strftime and the layouts that give the same.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "ss.SSS", "j": "DDD", "e": "d", "I": "hh", "p": "a", "b": "MMM", "a": "EEE", "L": "SSS", "6": "SSSSSS", "z": "XX"}


def strftime(t: Column | str, layout: str) -> Column:
    """t as text; %s are seconds since 1970, %J the Julian day, %F and %T a date and a time."""
    layout = layout.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")
    parts, i = [], 0
    while i < len(layout):
        if layout[i] != "%":
            end = layout.find("%", i)
            end = len(layout) if end < 0 else end
            parts.append(F.lit(layout[i:end]))
            i = end
            continue
        letter, i = layout[i + 1], i + 2
        if letter == "%":
            parts.append(F.lit("%"))
        elif letter == "s":
            parts.append(F.floor(F.unix_micros(c(t).cast("timestamp")) / 1_000_000).cast("string"))
        elif letter == "J":
            parts.append((F.unix_micros(c(t).cast("timestamp")) / 86400e6 + 2440587.5).cast("string"))
        else:
            parts.append(F.date_format(c(t), STRFTIME[letter]))
    return F.concat(*parts)


def modified(t: Column | str, *modifiers: str) -> Column:
    """t moved by modifiers such as "+1 day", "-3 months", "start of month", "weekday 1"; one after the other."""
    import re

    out = c(t).cast("timestamp")
    for m in modifiers:
        m = m.strip().lower()
        if m.startswith("start of "):
            out = F.date_trunc(m[9:], out)
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            out = out + F.make_interval(days=F.pmod(F.lit(int(found[1])) - (F.dayofweek(out) - 1), F.lit(7)).cast("int"))
        elif found := re.fullmatch(r"([-+]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
            n, unit = float(found[1]), found[2]
            if unit in ("month", "year"):
                out = out + F.make_ym_interval(**{f"{unit}s": F.lit(int(n))})
            else:
                out = F.timestamp_micros(F.unix_micros(out) + F.lit(round(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit] * 1_000_000)))
        else:
            raise ValueError(f"no such modifier: {m}")
    return out
