"""Tables found in message texts: discovered tables, search tables with guessed types, and the built-in ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.text import ip_key, level_ordinal, measure, natural_key
from strandlog.operators.analytics import MASKS, search_table, template
from strandlog.sources.layouts import columns, layout

# What a capture is tried on to guess its type, and the types.
SAMPLES = (("foobar", "string"), ("123.0", "double"), ("123", "bigint"))


#: What a capture that is none of these is tried on next, and the order that its values are sorted in.
ORDERED_SAMPLES = (("10.0.0.1", "address"), ("9KB", "measure"), ("1.5KB", "measure"), ("5s", "measure"), ("1:30:00", "measure"))


def group_bodies(pattern: str) -> dict[str, str]:
    """The regex inside each named group."""
    out, stack, i = {}, [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            end = i + 2 if pattern[i + 1 : i + 2] in ("]", "^") else i + 1
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            i = end
        elif ch == "(":
            m = re.match(r"\(\?P?<(\w+)>", pattern[i:])
            stack.append((m[1], i + len(m[0])) if m else None)
        elif ch == ")":
            if found := stack.pop():
                out[found[0]] = pattern[found[1] : i]
        i += 1
    return {n: out[n] for n in re.findall(r"\(\?P?<(\w+)>", pattern)}


def guess_kinds(pattern: str) -> dict[str, str]:
    """Types of the named groups: the first sample that a group's own regex matches as a whole; text if none."""
    kinds = {}
    for name, body in group_bodies(pattern).items():
        plain = re.sub(r"\(\?P?<\w+>", "(", body)
        kinds[name] = next((kind for sample, kind in SAMPLES if re.fullmatch(plain, sample)), "string")
    return kinds


def guess_orders(pattern: str) -> dict[str, str]:
    """The order of the named groups' values where it isn't that of their type: address or measure."""
    out = {}
    for name, body in group_bodies(pattern).items():
        plain = re.sub(r"\(\?P?<\w+>", "(", body)
        fits = lambda sample: re.fullmatch(plain, sample)  # noqa: E731, B023
        if not any(fits(sample) for sample, _ in SAMPLES):
            out |= {name: order for sample, order in reversed(ORDERED_SAMPLES) if fits(sample)}
    return out


def sort_key(df: DataFrame, column: str) -> Column:
    """What to sort a column by: the key of the order that its metadata names (see named_search_table), else itself."""
    order = df.schema[column].metadata.get("order")
    keys = {"address": ip_key, "measure": measure, "natural": natural_key}
    return keys[order](column) if order else F.col(column)


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """df sorted by these columns, each in its own order."""
    return df.orderBy(*(sort_key(df, x) for x in columns))


def named_search_table(messages: DataFrame, pattern: str, key: list[str], body: str = "log_body", level: str | None = None, glob: str | None = None, path: str = "log_path") -> DataFrame:
    """A row for each match of a regex with named groups: match_index and typed captures (null where a group took no part).

    Columns of addresses and measures name their order in their metadata, for sort_key() and in_order().
    level: only messages of this level; glob: only files whose path matches.
    """
    from strandlog.operators.messages import glob_regex
    from strandlog.sources.formats import positional

    rows = messages.where(level_ordinal("log_level") == level_ordinal(F.lit(level))) if level else messages
    rows = rows.where(F.col(path).rlike(glob_regex(glob))) if glob else rows
    plain, names = positional(pattern)
    kinds = guess_kinds(pattern)
    out = search_table(rows, plain, [n or f"_{i}" for i, n in enumerate(names)], key, body, {n: k for n, k in kinds.items() if k != "string"})
    orders = guess_orders(pattern)
    told = lambda n: {"metadata": {"order": orders[n]}} if n in orders else {}
    return out.select(*key, "match_index", *(F.nullif(F.col(n), F.lit("")).alias(n, **told(n)) if kinds[n] == "string" else F.col(n) for n in names if n))


@dataclass(frozen=True)
class SearchTable:
    pattern: str
    level: str | None = None
    glob: str | None = None


def _as_printed(text: str, **where: str) -> SearchTable:
    return SearchTable(layout(text), **where)


_PROFILE = "/SessionStats/SessionPool"

# The names and columns of the search tables that come with the catalogue. Each line is as its program prints it.
SEARCH_TABLES = {
    "hdfs_finalized_blocks": _as_printed(
        "src: <blk_src>, dest: <blk_dest>, bytes: <blk_bytes:int>, op: <blk_op>, cliID: <blk_cliid>, offset: <blk_offset>, srvID: <blk_srvid>, blockid: <blk_id>, duration(ns): <blk_duration:int>", level="info"
    ),
    "zk_established_session_id": _as_printed("Session establishment complete on server <> session[[ ]]id = <session_id:hex>", level="info"),
    "zk_notifications": _as_printed("Notification: my state:<my_state>; <nvalues:line>", level="info"),
    "zk_commit_session_id": _as_printed("Committing global session <session_id:hex>", level="info"),
    "procstate_procs": SearchTable("^" + layout(columns("user", "pid:int", "cpu_pct:number", "mem_pct:number", "vsz:int", "rss:int", "tty", "stat", "start_time", "cpu_time", "cmd:line")) + "$"),
    "cloudvm_ram_sizes": SearchTable("(?m)^(?!TOTAL )" + layout(columns("ServiceName", *(f"{x}:signed" for x in ("AllocatedMB", "MaxMB", "CurrentMB", "CurrRSS", "Cache", "MapFiles", "MemoryLimit"))))),
    "sudo_log": _as_printed("sudo: <login:word> : [[<error_msg:phrase> ; ]][[TTY=<tty:phrase> ; ]]PWD=<pwd:phrase> ; USER=<user:phrase> ; COMMAND=<command:line>"),
    "mysql_slow_stats": _as_printed(
        "# User@Host: <user:word> @ <host> [<>] Id: <conn_id:int>\n[[# Schema: <schema:word> Last_errno: <last_errno:int> Killed: <killed:int>\n]]"
        "# Query_time: <query_time:decimal> Lock_time: <lock_time:decimal> Rows_sent: <rows_sent:int> Rows_examined: <rows_examined:int>\n<query:text>"
    ),
    "vpxd_session_stats": _as_printed(f"{_PROFILE}/Session/Id='<SessionId>'/Username='<Username>'/ClientIP='<ClientIP>'<ProfileKey:word> <ProfileValue:line>", glob="*/vpxd-profile*"),
    "vpxd_session_pool_stats": _as_printed(f"{_PROFILE}/Id='<SessionId>'/Username='<Username>'<ProfileKey:word> <ProfileValue:line>", glob="*/vpxd-profile*"),
    "vpx_lro_begin": _as_printed("[VpxLRO] -- BEGIN <lro_id:word> -- <entity> -- <operation> -- [[<SessionId:uuid>[[(<SessionSubId:uuid>)]]]]"),
    "vpx_lro_finish": _as_printed("[VpxLRO] -- FINISH <lro_id:word>"),
}


def built_in_search_table(messages: DataFrame, name: str, key: list[str], body: str = "log_body", path: str = "log_path") -> DataFrame:
    t = SEARCH_TABLES[name]
    return named_search_table(messages, t.pattern, key, body, t.level, t.glob, path)


_HOLE = "\x00"


def shape_of(example: str) -> tuple[str, list[tuple[str, str]]]:
    """A regex for texts like the example, with a group for each of its variable parts, and their names and types.

    A part is named by the word before its = or :, else col_0, col_1 and so on; a name that comes again gets its number.
    """
    text, values = example, []
    for _, pattern in MASKS:
        out, kept, at, hole = [], [], 0, 0
        for m in re.finditer(pattern, text, re.ASCII):
            before, inside = text[at : m.start()], m[0]
            n = before.count(_HOLE)
            own = iter(values[hole + n : hole + n + inside.count(_HOLE)])
            kept += [*values[hole : hole + n], "".join(next(own) if ch == _HOLE else ch for ch in inside)]
            hole += n + inside.count(_HOLE)
            out += [before, _HOLE]
            at = m.end()
        text, values = "".join([*out, text[at:]]), kept + values[hole:]
    regex, fields = "", []
    literals = text.split(_HOLE)
    for i, (literal, value) in enumerate(zip(literals, values)):
        named = re.search(r"([A-Za-z_]\w*)\s*[=:]\s*$", literal)
        name = named[1] if named else f"col_{i}"
        kind = "bigint" if re.fullmatch(r"[-+]?\d{1,18}", value) else "double" if re.fullmatch(r"[-+]?\d+\.\d+", value) else "string"
        fields.append((f"{name}_{i}" if name in dict(fields) else name, kind))
        regex += re.escape(literal) + "(.+?)"
    return f"(?s)^{regex}{re.escape(literals[-1])}$", fields


def discovered_table(messages: DataFrame, example: str, key: list[str], body: str = "log_body") -> DataFrame:
    """The messages that share the example's template, one column for each of its variable parts (numbers as DOUBLE or BIGINT)."""
    regex, fields = shape_of(example)
    rows = messages.where(template(body) == template(F.lit(example)))
    part = lambda i, kind: F.regexp_extract(body, regex, i).try_cast(kind if kind != "string" else "string")
    return rows.select(*key, *(F.regexp_replace(part(i, k), '^"(.*)"$', "$1").alias(n) if k == "string" else part(i, k).alias(n) for i, (n, k) in enumerate(fields, 1)))


def breakpoints(messages: DataFrame, examples: list[str], body: str = "log_body") -> DataFrame:
    """The messages whose template is that of one of the example texts."""
    wanted = F.array(*(template(F.lit(x)) for x in examples))
    return messages.where(F.array_contains(wanted, template(body)))


def typed_fields(text: Column | str) -> Column:
    """k=v and k: v pairs as a JSON object, numbers and constants unquoted."""
    from strandlog.functions.text import typed
    from strandlog.operators.analytics import fields_of

    fields = fields_of(text)
    values = F.transform_values(fields, lambda k, v: F.when((typed(v) != "text") | v.isin("true", "false", "null"), F.coalesce(F.try_parse_json(v), v.cast("variant"))).otherwise(v.cast("variant")))
    return F.to_json(values)
