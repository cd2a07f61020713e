"""JSON held as text: building, editing and joining it, as column expressions.

Numbers keep their value, not their spelling (2.50 becomes 2.5). The members of an edited object keep their order;
objects inside others are written with their keys sorted. A null or malformed text gives null where a result needs it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog.functions.text import c

_OBJECT, _LIST = "map<string,variant>", "array<variant>"


def value(x) -> Column:
    """A variant: of a plain Python value, or of a column (texts become JSON strings, variants stay)."""
    x = x if isinstance(x, Column) else F.lit(x)
    return F.coalesce(x.cast("variant"), F.parse_json(F.lit("null")))


def path_steps(path: str) -> list[tuple[str | int, bool]]:
    """The steps of a path such as $.a."b c"[0] or $.list[#], and whether each is a list's place; "#": the one after the end."""
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    steps: list[tuple[str | int, bool]] = []
    at = 1
    for m in re.finditer(r'\.(?:"([^"]*)"|([^.\["]+))|\[(\d+|#)\]', path[1:]):
        if m.start() + 1 != at:
            raise ValueError(f"malformed path: {path}")
        at = m.end() + 1
        if m[3]:
            steps.append(("#" if m[3] == "#" else int(m[3]), True))
        else:
            steps.append((m[2] if m[1] is None else m[1], False))
    if at != len(path):
        raise ValueError(f"malformed path: {path}")
    return steps


def _let(x: Column, use) -> Column:
    """use(x), with x worked out once however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _edit(text: Column, steps: list[tuple[str | int, bool]], how: str, new: Column | None) -> Column:
    (step, index), rest = steps[0], steps[1:]

    def inner(old: Column) -> Column:
        return F.parse_json(_let(F.to_json(old), lambda t: _edit(t, rest, how, new)))

    def in_list(items: Column) -> Column:
        at = F.size(items) if step == "#" else F.lit(step)
        has = at < F.size(items)
        if rest:
            out = F.transform(items, lambda v, i: F.when(i == at, inner(v)).otherwise(v))
        elif how == "remove":
            out = F.filter(items, lambda v, i: i != at)
        else:
            changed = F.transform(items, lambda v, i: F.when(i == at, new).otherwise(v))
            added = F.when(at == F.size(items), F.concat(items, F.array(new))).otherwise(items)
            out = F.when(has, items if how == "insert" else changed).otherwise(items if how == "replace" else added)
        return F.when(items.isNotNull(), F.to_json(out)).otherwise(text)

    def in_object(members: Column) -> Column:
        if rest:
            out = F.transform_values(members, lambda k, v: F.when(k == step, inner(v)).otherwise(v))
        elif how == "remove":
            out = F.map_filter(members, lambda k, v: k != step)
        else:
            changed = F.transform_values(members, lambda k, v: F.when(k == step, new).otherwise(v))
            added = F.map_concat(members, F.create_map(F.lit(step), new))
            out = F.when(F.map_contains_key(members, F.lit(step)), members if how == "insert" else changed).otherwise(members if how == "replace" else added)
        return F.when(members.isNotNull(), F.to_json(out)).otherwise(text)

    return _let(F.from_json(text, _LIST), in_list) if index else _let(F.from_json(text, _OBJECT), in_object)


def _bound(steps: list[tuple[str | int, bool]], how: str, new: Column | None):
    return lambda text: _edit(text, steps, how, new)


def _edited(text: Column | str, how: str, pairs: list[tuple[str, Column | None]]) -> Column:
    out = F.when(F.try_parse_json(c(text)).isNotNull(), c(text))
    for path, new in pairs:
        steps = path_steps(path)
        if not steps:
            out = F.lit(None).cast("string") if how == "remove" else out if how == "insert" else F.to_json(new)
        else:
            out = _let(out, _bound(steps, how, new))
    return out


def json_edit(text: Column | str, how: str, *pairs: tuple[str, object]) -> Column:
    """how: "set" puts each value at its path, "insert" only where nothing is, "replace" only where something is.

    The parent of a path must be there; else nothing changes. A list grows at its end only.
    """
    if how not in ("set", "insert", "replace"):
        raise ValueError(how)
    return _edited(text, how, [(path, value(new)) for path, new in pairs])


def json_remove(text: Column | str, *paths: str) -> Column:
    return _edited(text, "remove", [(p, None) for p in paths])


def json_concat(text: Column | str, *values) -> Column:
    """A list of the elements of `text` (itself, if it is no list; nothing, if it is null) and of the values."""
    t = c(text)
    first = F.when(t.isNull(), F.array().cast(_LIST)).otherwise(F.coalesce(F.from_json(t, _LIST), F.array(F.try_parse_json(t))))
    out = F.to_json(F.concat(first, F.array(*map(value, values)).cast(_LIST)))
    return F.when(t.isNull() | F.try_parse_json(t).isNotNull(), out)


def json_array(*values) -> Column:
    return F.to_json(F.array(*map(value, values)))


def json_object(**members) -> Column:
    return F.to_json(F.create_map(*(x for k, v in members.items() for x in (F.lit(k), value(v)))))


def json_quote(x) -> Column:
    """A text as a JSON string, a number as it is."""
    return F.to_json(value(x))


def json_valid(text: Column | str) -> Column:
    return F.try_parse_json(c(text)).isNotNull() & c(text).isNotNull()


def json_type(text: Column | str) -> Column:
    """null, true, false, integer, real, text, array or object; null for a malformed text."""
    kind = F.schema_of_variant(F.try_parse_json(c(text)))
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "BOOLEAN", F.trim(c(text)))
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real")
        .when(kind == "STRING", "text")
        .when(kind == "VOID", "null")
    )


def json_length(text: Column | str) -> Column:
    """Elements of a list, 0 of anything else that is JSON."""
    return F.when(json_valid(text), F.coalesce(F.json_array_length(c(text)), F.lit(0)))
