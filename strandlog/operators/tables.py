"""Table functions: captures, XML paths, JSON trees, fuzzy search, annotations; and small sinks."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.operators.shared import spread

_CAPTURE = "match_index int, capture_index int, capture_name string, capture_count int, range_start int, range_stop int, content string"


def _inlined(rows: DataFrame, names: list[str], column: str, always: str) -> DataFrame:
    """The columns of these names with the structs of a list column, one a row. always: a field that is never null.

    Outer, since for a plain inline() the optimizer asks first whether there are any, and works the list out once more for it.
    """
    return rows.select(*names, F.inline_outer(column)).where(F.col(always).isNotNull())


def regexp_capture(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """A row for each match and capture (0: the whole match) of each row's text, with 1-based places."""
    import re

    compiled = re.compile(pattern)
    names = {i: n for n, i in compiled.groupindex.items()}

    def captures(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows = []
            for m, found in enumerate(compiled.finditer(t or "")):
                for i in range(compiled.groups + 1):
                    a, b = found.span(i)
                    rows.append((m, i, names.get(i), compiled.groups + 1, a + 1 if a >= 0 else None, b + 1 if b >= 0 else None, found.group(i)))
            out.append(rows)
        return pd.Series(out)

    kind = f"array<struct<{_CAPTURE.replace(' int', ':int').replace(' string', ':string')}>>"
    udf = F.pandas_udf(captures, kind)
    return _inlined(df.withColumn("_c", udf(column)), df.columns, "_c", "match_index")


def xpath_nodes(df: DataFrame, column: str, path: str) -> DataFrame:
    """result, node_path, node_attr (JSON) and node_text of each node that an ElementTree path finds in a row's XML; none if it is not XML."""

    def nodes(texts: pd.Series) -> pd.Series:
        import json
        from xml.etree import ElementTree as E

        out = []
        for t in texts:
            rows = []
            try:
                root = E.fromstring(t or "")
            except E.ParseError:
                root = None
            if root is not None:
                places = {root: f"/{root.tag}"}
                for parent in root.iter():
                    seen: dict[str, int] = {}
                    same = [c.tag for c in parent]
                    for c in parent:
                        seen[c.tag] = seen.get(c.tag, 0) + 1
                        places[c] = f"{places[parent]}/{c.tag}" + (f"[{seen[c.tag]}]" if same.count(c.tag) > 1 else "")
                for n in root.findall(path):
                    rows.append((E.tostring(n, encoding="unicode").strip(), places[n], json.dumps(n.attrib), "".join(n.itertext())))
            out.append(rows)
        return pd.Series(out)

    udf = F.pandas_udf(nodes, "array<struct<result:string,node_path:string,node_attr:string,node_text:string>>")
    return _inlined(spread(df).withColumn("_n", udf(column)), df.columns, "_n", "node_path")


#: Functions whose value is a number, a text or a truth value; an expression that begins with one has one value.
_ONE_VALUE = r"\s*(?:count|sum|number|floor|ceiling|round|string|concat|substring|substring-before|substring-after|normalize-space|translate|string-length|name|local-name|boolean|not|contains|starts-with)\s*\("


#: What a check of plain tags, attributes and text leaves to Spark's own parsers.
_NOT_PLAIN = r"[^\x00-\x7f]|<[?!]|[&:]"


def _documents(texts: pd.Series) -> pd.Series:
    """1: one well-formed document, 0: none, 2: a text with more to XML than plain ASCII tags, attributes and text."""
    import re
    from xml.parsers import expat

    other = re.compile(_NOT_PLAIN).search

    def kind(t: str | None) -> int:
        if not t or other(t):
            return 2 if t else 0
        try:
            expat.ParserCreate().Parse(t, True)
        except expat.ExpatError:
            return 0
        return 1

    return pd.Series([kind(t) for t in texts], dtype="int32")


def _one_document(x: Column) -> Column:
    """Whether a text is one well-formed document without a document type, by Spark's own parsers."""
    inside = F.concat(F.lit("<_>"), F.regexp_replace(x, r"^\s*<\?xml[^>]*\?>", ""), F.lit("</_>"))
    bad = F.from_xml(inside, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).getField("_bad")
    alone = F.xpath_boolean(inside, F.lit("count(/_/*) = 1 and not(/_/text()[normalize-space()])"))
    return F.when(bad.isNull() & (F.trim(x) != ""), alone).otherwise(F.lit(False))


def xpath_values(df: DataFrame, column: str, path: str) -> DataFrame:
    """df's rows with match_index and value for each text or attribute that an XPath 1.0 expression finds in a row's XML.

    An expression such as count(//a) gives one row with its value. Elements have no value of their own: ask for their
    text(). A text that isn't one well-formed document, or declares a document type, gives no row.
    """
    names = [c for c in df.columns if c not in ("match_index", "value")]
    return xpath_values_of(df, column, {"": path}).select(*names, "match_index", "value")


def xpath_values_of(df: DataFrame, column: str, paths: Mapping[str, str], asked: str = "asked") -> DataFrame:
    """xpath_values() of several expressions in one pass over the rows, each text checked once; asked: an expression's name."""
    import re

    x, documents = F.coalesce(F.col(column), F.lit("")), F.pandas_udf(_documents, "int")
    rows = spread(df).withColumn("_kind", documents(x))
    good = F.when(F.col("_kind") == 2, _one_document(x)).otherwise(F.col("_kind") == 1)

    def found(name: str, path: str) -> Column:
        values = F.array(F.xpath_string(x, F.lit(path))) if re.match(_ONE_VALUE, path) else F.xpath(x, F.lit(path))
        return F.transform(values, lambda v, i: F.struct(F.lit(name).alias(asked), i.alias("match_index"), v.alias("value")))

    names = [c for c in df.columns if c not in (asked, "match_index", "value")]
    values = F.when(good, F.flatten(F.array(*(found(n, p) for n, p in paths.items()))))
    return _inlined(rows.withColumn("_v", values), names, "_v", "match_index")


def json_each(df: DataFrame, column: str) -> DataFrame:
    """key and value (as JSON text) of the members of a row's JSON object."""
    return df.select(*df.columns, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def json_tree(df: DataFrame, column: str) -> DataFrame:
    """key, value, type, atom, id, parent, fullkey and path of every node of a row's JSON, however deep; none if it is not JSON.

    value and atom are JSON texts; atom is null for lists and objects. id numbers a row's nodes from the root on.
    """

    def nodes(texts: pd.Series) -> pd.Series:
        import json

        kinds = {dict: "object", list: "array", str: "text", bool: "true", int: "integer", float: "real", type(None): "null"}
        written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        out = []
        for t in texts:
            rows: list[tuple] = []
            try:
                stack = [(None, json.loads(t), None, "$", None)] if t else []
            except ValueError:
                stack = []
            while stack:
                key, value, parent, fullkey, path = stack.pop()
                kind = "false" if value is False else kinds[type(value)]
                text = written(value)
                rows.append((key, text, kind, None if kind in ("object", "array") else text, len(rows), parent, fullkey, path))
                me = len(rows) - 1
                if kind == "object":
                    members = [(k, v, me, f"{fullkey}.{k}" if k.isidentifier() else f'{fullkey}."{k}"', fullkey) for k, v in value.items()]
                elif kind == "array":
                    members = [(str(i), v, me, f"{fullkey}[{i}]", fullkey) for i, v in enumerate(value)]
                else:
                    members = []
                stack += reversed(members)
            out.append(rows)
        return pd.Series(out, dtype=object)

    kind = "array<struct<key:string,value:string,type:string,atom:string,id:int,parent:int,fullkey:string,path:string>>"
    return _inlined(spread(df).withColumn("_n", F.pandas_udf(nodes, kind)(column)), df.columns, "_n", "id")


def flatten_json(df: DataFrame, column: str, name: str) -> DataFrame:
    """name: one flat JSON object of a row's JSON object, each leaf under its pointer (a/b/0); null if it is no object."""

    def flat(texts: pd.Series) -> pd.Series:
        import json

        out = []
        for t in texts:
            try:
                top = json.loads(t) if t else None
            except ValueError:
                top = None
            leaves, stack = {}, [("", top)]
            while stack:
                at, v = stack.pop()
                inner = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
                if inner:
                    stack += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", x) for k, x in reversed(inner)]
                else:
                    leaves[at[1:]] = v
            out.append(json.dumps(leaves, ensure_ascii=False, separators=(",", ":")) if isinstance(top, dict) else None)
        return pd.Series(out, dtype=object)

    return df.withColumn(name, F.pandas_udf(flat, "string")(column))


def fuzzy_search(df: DataFrame, column: str, pattern: str, k: int) -> DataFrame:
    """The k rows whose text holds the pattern's letters in order, best score first; ties by the other columns.

    The score is that of the best way to place the letters: 1 each, 4 more right after the one before, 3 more at a word's start.
    """
    import re

    letters = "".join(pattern.lower().split())
    rows = df.where(F.lower(column).rlike("(?s)" + ".*?".join(map(re.escape, letters))))

    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = t.lower()
            opens = [i == 0 or not t[i - 1].isalnum() for i in range(len(t))]
            best: dict[int, int] = {-2: 0}  # the place of the letter before: the best score so far
            for ch in letters:
                new, top, places = {}, None, sorted(best)
                j = 0
                for i, x in enumerate(t):
                    while j < len(places) and places[j] < i:
                        top = best[places[j]] if top is None else max(top, best[places[j]])
                        j += 1
                    if x == ch and top is not None:
                        near = best.get(i - 1)
                        new[i] = 1 + 3 * opens[i] + max(top, near + 4 if near is not None else top)
                best = new
            out.append(max(best.values()))
        return pd.Series(out, dtype="int64")

    return rows.withColumn("score", F.pandas_udf(score, "long")(column)).orderBy(F.desc("score"), *df.columns).limit(k)


def http_status_codes(spark) -> DataFrame:
    """(status, message) of the registered HTTP statuses."""
    from http import HTTPStatus

    return spark.createDataFrame([(x.value, x.phrase) for x in HTTPStatus], "status int, message string")


def annotate(messages: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """log_annotations: a map of the notes of the rules (condition, note) that a message meets."""
    entries = F.array(*(F.when(F.expr(cond), F.struct(F.lit(name).alias("k"), note.cast("string").alias("v"))) for name, (cond, note) in rules.items()))
    return messages.withColumn("log_annotations", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())))


def rewrite(df: DataFrame, column: str, lookup: DataFrame, key: str, text: str) -> DataFrame:
    """The column's value followed by its text in a small lookup table, as in 404 (Not Found)."""
    out = df.join(lookup.select(F.col(key).alias("_k"), F.col(text).alias("_t")), F.col(column) == F.col("_k"), "left")
    return out.withColumn(column, F.concat(F.col(column).cast("string"), F.coalesce(F.concat(F.lit(" ("), "_t", F.lit(")")), F.lit("")))).drop("_k", "_t")


def marked(messages: DataFrame, column: str = "log_mark") -> DataFrame:
    return messages.where(F.coalesce(F.col(column), F.lit(False)))


def sub_operations(messages: DataFrame, opid: str, subid: str, time: str = "log_time") -> DataFrame:
    """For each operation the ranges of its sub-operations, by start."""
    parts = messages.groupBy(opid, subid).agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("total"))
    return parts.groupBy(opid).agg(F.array_sort(F.collect_list(F.struct("start", subid, "stop", "total"))).alias("ranges"))


def sub_operation_ranges(messages: DataFrame, opid: str, subid: str, opens: Column, closes: Column, order: list[str], time: str = "log_time") -> DataFrame:
    """(opid, subid, range, start, stop, total, closed): every time that a sub-operation is open, numbered from 1.

    A range begins with a message that opens it, with the first one after a close, or with the first of all; it ends with a
    message that closes it or before the next that opens. order makes all rows unique. Rows go in blocks, so one operation
    with most of the messages isn't one task.
    """
    from strandlog.operators.carry import carry, numbered, previous

    rows = messages.select(*dict.fromkeys([opid, subid, time, *order]), F.coalesce(opens, F.lit(False)).alias("_opens"), F.coalesce(closes, F.lit(False)).alias("_closes"))
    rows = numbered(rows.where(F.col(opid).isNotNull() & F.col(subid).isNotNull()), order, "_n")
    rows = previous(rows, [opid, subid], "_n", "_closes", "_closed_before")
    begins = F.col("_opens") | F.coalesce(F.col("_closed_before"), F.lit(True))
    rows = carry(rows.withColumn("_begins", begins.cast("bigint")), [opid, subid], "_n", range=("sum", F.col("_begins")))
    return rows.groupBy(opid, subid, "range").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("total"), F.max("_closes").alias("closed"))
