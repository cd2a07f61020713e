"""WARC derivatives: linked metadata and plain-text conversion records of responses, in DataFrame functions.

A response record has an id, its target, the HTTP header block and the payload with its digest. derive() makes two
records of each: `metadata` (application/warc-fields: title, language, outlinks) and `conversion` (text/plain). Both
name the response they come from (WARC-Refers-To and its date), and carry its content type and payload digest along;
ids are made from the source record's id, so a second run makes the same records.

Defined results: a null html is an empty payload and gives an empty conversion; a null URL gives a record whose target
is empty; equal pages give equal records. One row gives two rows and no shuffle, so sizes and skew don't matter. Of a
script, style, head or comment that is never closed its tag goes and what follows stays as text; a block tag that the page
ends in goes; another < without its > stays. Each start that is never closed takes what follows along, so that a page of
such starts is read once and not once from each of them. The language is that of the first html tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pages table has no fetch time.
DATE = "1970-01-01T00:00:00Z"
SOURCE_TYPE = "text/html; charset=utf-8"

#: What goes; group 1 is what follows the tag of a start that is never closed.
_DROPPED = tuple(
    rf"(?is){start}(?:.*?{end}|[^>]*+>?+(.*+))" for start, end in ((r"<script\b", r"</script\s*>"), (r"<style\b", r"</style\s*>"), ("<!--", "-->"), (r"<head\b", r"</head\s*>"))
)
_TAGS = r"<[^>]*>|(<[^>]*+)"
_BLOCK = r"</?(?:p|div|li|ul|ol|tr|table|h[1-6]|br|hr|section|article|header|footer|nav|aside|main|blockquote|pre|body|html)\b[^>]*+"
_BREAKS = rf"(?i){_BLOCK}(?:>|(\z))"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def _entities(text: Column) -> Column:
    """The text with its entities as characters: what follows each & is looked at once."""

    def decoded(part: Column, i: Column) -> Column:
        out = F.concat(F.lit("&"), part)
        for name, char in _ENTITIES:
            out = F.when(part.startswith(name[1:]), F.concat(F.lit(char), F.substr(part, F.lit(len(name))))).otherwise(out)
        return F.when(i == 0, part).otherwise(out)

    return F.array_join(F.transform(F.split(text, "&", -1), decoded), "")


def plain_text(html: Column) -> Column:
    out = html
    for pattern in _DROPPED:
        out = F.regexp_replace(out, pattern, "$1")
    out = F.regexp_replace(out, _BREAKS, "\n$1")
    out = _entities(F.regexp_replace(out, _TAGS, "$1"))
    for white in "\t\r\f":
        out = F.replace(out, F.lit(white), F.lit(" "))
    some = lambda parts: F.filter(parts, lambda x: x != "")
    out = F.array_join(some(F.split(out, " ")), " ")
    return F.array_join(some(F.transform(F.split(out, "\n"), lambda x: F.trim(x))), "\n")


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, record_id, target_uri, date, content_type, http_headers, payload, payload_digest) of web pages."""
    payload, target = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    digest = F.sha2(payload, 256)
    seed = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), target, digest)
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {SOURCE_TYPE}\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        key,
        _uuid(seed).alias("record_id"),
        target.alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.lit(SOURCE_TYPE).alias("content_type"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        F.concat(F.lit("sha256:"), digest).alias("payload_digest"),
    )


def metadata_fields(html: Column) -> Column:
    """The body of a metadata record: one field a line."""
    squeezed = lambda x: F.regexp_replace(_entities(F.regexp_replace(x, _TAGS, "$1")), r"\s+", " ")
    title = squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title|<title.*+", 1))
    lang = F.regexp_extract(html, r'(?i)<html\b[^>]*\blang="([^"]*)"|<html\b[^>]*+', 1)
    quoted = F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref=("[^"]*")|<a\b[^>]*+'), F.lit(1)), lambda x: x != "")
    links = F.transform(quoted, lambda x: F.concat(F.lit("outlink: "), _entities(F.substring(x, F.lit(2), F.char_length(x) - 2)), F.lit(" L a/@href\r\n")))
    return F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), lang, F.lit("\r\n"), F.array_join(links, ""))


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response: metadata and conversion, with the record's fields and, in `record`, its bytes as text.

    The response's header block stays: whole in source_headers, and line by line in the record, the status line as
    X-Source-Status and each field under its own name after X-Source-. A response without headers adds no such lines.
    """
    of = lambda kind, type_, body: F.struct(F.lit(kind).alias("record_type"), F.lit(type_).alias("content_type"), body.alias("body"))
    both = F.array(
        of("metadata", "application/warc-fields", metadata_fields(F.col("payload"))), of("conversion", "text/plain; charset=utf-8", plain_text(F.col("payload")))
    )
    rows = records.withColumnRenamed("content_type", "source_content_type").withColumn("_made", F.explode(both)).select("*", "_made.*")
    rows = rows.select(
        key,
        "record_type",
        _uuid(F.concat_ws("|", "record_type", "record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "content_type",
        F.octet_length("body").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("block_digest"),
        "source_content_type",
        F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_payload_digest"),
        "body",
    )
    fields = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in fields]
    given = F.filter(F.split(F.coalesce("source_headers", F.lit("")), r"\r?\n"), lambda h: h != "")
    named = F.transform(given, lambda h: F.concat(F.lit("X-Source-"), F.when(h.startswith("HTTP/"), F.concat(F.lit("Status: "), h)).otherwise(h), F.lit("\r\n")))
    return rows.withColumn("record", F.concat(F.lit("WARC/1.1\r\n"), *lines, F.array_join(named, ""), F.lit("\r\n"), F.col("body"), F.lit("\r\n\r\n")))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records; each one's bytes as their digest."""
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumn("record_sha256", F.sha2("record", 256)).drop("record")


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, sha256(payload) AS digest, md5(concat_ws('|', 'response', coalesce(page_id::VARCHAR, ''), target_uri, sha256(payload))) AS m FROM p),
r AS (SELECT *, '<urn:uuid:' || concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) || '>' AS refers_to,
  chr(13) || chr(10) AS crlf, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) AS source_headers FROM h),
l AS (SELECT page_id, digest, target_uri, list_transform(regexp_extract_all(payload, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1), lambda x:
  'outlink: ' || replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') || ' L a/@href' || chr(13) || chr(10)) AS links,
  regexp_extract(payload, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) AS lang, regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '<[^>]*>', '', 'g') AS title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?is)<head\b.*?</head\s*>', '', 'g') AS visible, * EXCLUDE (page_id, digest, target_uri) FROM r),
b AS (SELECT *, regexp_replace(regexp_replace(visible, '(?i)</?(?:p|div|li|ul|ol|tr|table|h[1-6]|br|hr|section|article|header|footer|nav|aside|main|blockquote|pre|body|html)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS bare FROM l),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(bare, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS plain,
  replace(replace(replace(replace(replace(replace(replace(title, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS heading FROM b),
o AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'title: ' || regexp_replace(heading, '\s+', ' ', 'g') || crlf || 'language: ' || lang || crlf || coalesce(array_to_string(links, ''), '') AS body FROM e
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', regexp_replace(regexp_replace(regexp_replace(plain, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') FROM e),
n AS (SELECT *, md5(concat_ws('|', record_type, refers_to)) AS k, 'sha256:' || sha256(body) AS block_digest FROM o),
d AS (SELECT *, '<urn:uuid:' || concat_ws('-', substr(k, 1, 8), substr(k, 9, 4), substr(k, 13, 4), substr(k, 17, 4), substr(k, 21, 12)) || '>' AS record_id FROM n)
SELECT page_id, record_type, record_id, refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, content_type, strlen(body)::BIGINT AS content_length, block_digest, 'text/html; charset=utf-8' AS source_content_type, source_headers,
  'sha256:' || digest AS source_payload_digest, body, sha256('WARC/1.1' || crlf || 'WARC-Type: ' || record_type || crlf || 'WARC-Record-ID: ' || record_id || crlf || 'WARC-Date: 1970-01-01T00:00:00Z' || crlf || 'WARC-Target-URI: ' || target_uri || crlf ||
  'WARC-Refers-To: ' || refers_to || crlf || 'WARC-Refers-To-Target-URI: ' || target_uri || crlf || 'WARC-Refers-To-Date: 1970-01-01T00:00:00Z' || crlf || 'WARC-Block-Digest: ' || block_digest || crlf || 'X-Source-Payload-Digest: sha256:' || digest || crlf ||
  'Content-Type: ' || content_type || crlf || 'Content-Length: ' || strlen(body) || crlf || 'X-Source-Status: HTTP/1.1 200 OK' || crlf || 'X-Source-Content-Type: text/html; charset=utf-8' || crlf || 'X-Source-Content-Length: ' || strlen(payload) || crlf ||
  crlf || body || crlf || crlf) AS record_sha256
FROM d
"""
