"""WARC records and not-modified revisit resolution.

A revisit (a 304 answer) has no body of its own.  It is resolved by an as-of join on the canonical URL to
the latest earlier full response, provided that their validators agree, and takes that response's headers
updated by those of its own that a 304 may change (RFC 9111, section 3.2).  The join is one
window over the union of both kinds: one shuffle, no range join, and bodies never move.  A URL with more captures than
one task should sort is cut into spans of time; the last response of each span is carried into the next ones.
"""

from __future__ import annotations

import io
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fields of a 304 answer that don't update a stored response: they frame or encode the body, or end at a hop.
FIXED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)

#: Captures of one URL that a task sorts, about.
SPAN = 1_000_000
#: Bytes of bodies that the reader hands on at a time.
READ_BYTES = 32 << 20

RECORD = (
    "record_id string, kind string, url string, captured_at long, status int, headers map<string,string>, digest string, body binary"
)


def canonical_url(url: Column) -> Column:
    """Host and path that stay the same however a page is linked: no scheme, user part, leading www,
    default port, fragment, tracking parameters, order of parameters, trailing slash or capitals in the host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^utm_")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _opaque(tag: Column) -> Column:
    """An entity tag without its weakness mark: a 304 compares weakly."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def lowered_headers(headers: Column) -> Column:
    """The map with lower-cased names; of names that differ in case only, the last by code points stands."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("low"), e["key"].alias("key"), e["value"].alias("value")))
    ordered = F.array_sort(entries)
    last = F.filter(ordered, lambda e, i: ~F.get(ordered, i + 1)["low"].eqNullSafe(e["low"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["low"].alias("key"), e["value"].alias("value"))))


def _spans(r: DataFrame, span: int) -> DataFrame | None:
    """(hot_key, bounds): for URLs with more than span captures, the times that part them evenly; None if there are none.

    A row for each span captures at most, so it is broadcast.
    """
    hot = r.groupBy("url_key").agg(F.count("*").alias("n")).where(F.col("n") > span).select(F.col("url_key").alias("hot_key"), "n")
    hot = materialize(hot, "hot-urls")
    most = hot.agg(F.max("n")).first()[0]
    if most is None:
        return None
    cuts = [i / (2 * -(-most // span)) for i in range(1, 2 * -(-most // span))]
    own = r.join(F.broadcast(hot), r["url_key"] == hot["hot_key"])
    return own.groupBy("hot_key").agg(F.array_sort(F.array_distinct(F.percentile_approx("captured_at", cuts, 10_000))).alias("bounds"))


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row a revisit of ``records`` (record_id, kind, url, captured_at, status, headers, digest):
    (revisit_id, url_key, captured_at, response_id, response_at, verdict, status, digest, headers).

    kind is 'response' or 'revisit'; other kinds, and responses whose status isn't 200, take no part.
    The response is that of greatest ``captured_at`` below the revisit's, of equal ones that of greatest record_id.
    verdict is 'etag', 'last-modified' or 'digest' after the first validator that both have, when it
    agrees; 'changed' when it doesn't; 'unverifiable' when they share none; 'orphan' without an earlier
    response.  Only the first three are resolved; the rest have null response_id, status and headers.
    Header names are lower-cased, and of those that differ in case only the last by code points stands; headers come back as sorted 'name: value' lines.  A null url, captured_at or
    record_id makes an orphan of a revisit and takes a response out.  Repeated revisits come back each
    time, repeated responses are one.  Other columns are ignored.
    """
    r = records.select(
        F.col("record_id").cast("string").alias("record_id"), "kind", canonical_url(F.col("url")).alias("url_key"), F.col("captured_at").cast("long").alias("captured_at"),
        F.col("status").cast("int").alias("status"), lowered_headers(F.col("headers")).alias("headers"), "digest",
    ).where("kind = 'revisit' or (kind = 'response' and status = 200 and record_id is not null and url_key is not null and captured_at is not null)")
    revisit = F.col("kind") == "revisit"
    lost = revisit & (F.col("url_key").isNull() | F.col("captured_at").isNull() | F.col("record_id").isNull())
    full = F.when(~revisit, F.struct("record_id", "captured_at", "status", "headers", "digest"))
    kept = r.where(~lost)
    spans = _spans(kept.select("url_key", "captured_at"), span)
    # at an equal time a revisit stands before the responses: only earlier ones count
    order = ("captured_at", F.when(revisit, 0).otherwise(1), "record_id")
    if spans is None:
        line = Window.partitionBy("url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        joined = kept.withColumn("full", F.last(full, ignorenulls=True).over(line)).where(revisit)
    else:
        # captures at one time are in one span, so what earlier spans end with is earlier than all of a span
        kept = kept.join(F.broadcast(spans), kept["url_key"] == spans["hot_key"], "left").drop("hot_key")
        kept = kept.withColumn("span", F.coalesce(F.size(F.filter("bounds", lambda t: t < F.col("captured_at"))), F.lit(0))).withColumn("hot", F.col("bounds").isNotNull()).drop("bounds")
        key = F.struct("captured_at", "record_id")
        ends = kept.where(~revisit & F.col("hot")).groupBy("url_key", "span").agg(F.max_by(full, key).alias("end"))
        ends = kept.where("hot").select("url_key", "span").distinct().join(ends, ["url_key", "span"], "left")
        before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("url_key", "span", F.last("end", ignorenulls=True).over(before).alias("carried"))
        line = Window.partitionBy("url_key", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        joined = kept.withColumn("full", F.last(full, ignorenulls=True).over(line)).where(revisit)
        joined = joined.join(F.broadcast(carried), ["url_key", "span"], "left").withColumn("full", F.coalesce("full", "carried")).drop("carried", "span", "hot")
    joined = joined.unionByName(r.where(lost).withColumn("full", F.lit(None).cast(joined.schema["full"].dataType)))
    tag, old_tag = _opaque(F.col("headers")["etag"]), _opaque(F.col("full.headers")["etag"])
    seen, old_seen = F.col("headers")["last-modified"], F.col("full.headers")["last-modified"]
    verdict = (
        F.when(F.col("full").isNull(), "orphan")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "etag").otherwise("changed"))
        .when(seen.isNotNull() & old_seen.isNotNull(), F.when(seen == old_seen, "last-modified").otherwise("changed"))
        .when(F.col("digest").isNotNull() & F.col("full.digest").isNotNull(), F.when(F.col("digest") == F.col("full.digest"), "digest").otherwise("changed"))
        .otherwise("unverifiable")
    )
    mine = F.map_filter("headers", lambda k, v: ~k.isin(*FIXED_HEADERS))
    kept = F.map_filter(F.col("full.headers"), lambda k, v: ~F.array_contains(F.map_keys("mine"), k))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_concat(kept, F.col("mine"))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    good = F.col("verdict").isin("etag", "last-modified", "digest")
    return joined.withColumn("mine", mine).withColumn("verdict", verdict).select(
        F.col("record_id").alias("revisit_id"),
        "url_key",
        "captured_at",
        F.when(good, F.col("full.record_id")).alias("response_id"),
        F.when(good, F.col("full.captured_at")).alias("response_at"),
        "verdict",
        F.when(good, F.col("full.status")).alias("status"),
        F.when(good, F.col("full.digest")).alias("digest"),
        F.when(good, lines).alias("headers"),
    )


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records of a pages table, which has single captures only.

    Every page has two full responses, at time 1000 * page_id and 250 later, the second under another spelling of its
    URL and with other validators, an error between them, and the revisits that a recrawler would see: before the first
    capture; with the first entity tag; with it marked weak and stale framing headers; with it once the second response
    is there; with the second tag; with the second date only; with the second digest only; with a tag that was never
    captured; with nothing to compare."""
    tag, day = F.concat(F.lit('"'), F.left(F.md5("html"), F.lit(16)), F.lit('"')), F.concat(F.lit("day "), F.col("page_id").cast("string"))
    digest = F.concat(F.lit("sha1:"), F.sha1("html"))
    none = F.lit(None).cast("string")
    text = F.lit

    def one(name: str, kind: str, at: Column, status: int, headers: list[Column], digest: Column, respelt: bool = False) -> Column:
        return F.struct(
            F.concat(F.lit(f"{name}-"), F.col("page_id").cast("string")).alias("record_id"), F.lit(kind).alias("kind"), at.alias("captured_at"), F.col("respelt" if respelt else "url").alias("url"),
            F.lit(status).alias("status"), (F.create_map(*headers) if headers else F.create_map().cast("map<string,string>")).alias("headers"), digest.alias("digest"),
        )

    def full(name: str, at: Column, tag: str, day: str, digest: Column, age: str, status: int = 200, respelt: bool = False) -> Column:
        fields = [text("Content-Type"), text("text/html"), text("Content-Length"), F.length("html").cast("string"), text("ETag"), F.col(tag), text("Last-Modified"), F.col(day), text("Cache-Control"), text(age)]
        return one(name, "response", at, status, fields, digest, respelt)

    at = F.col("page_id").cast("long") * 1000
    records = [
        full("full", at, "tag", "day", F.col("digest"), "max-age=600"),
        full("later", at + 250, "tag2", "day2", F.col("digest2"), "max-age=900", respelt=True),
        full("error", at + 260, "tag", "day", F.col("digest"), "no-store", status=500),
        one("early", "revisit", at - 500, 304, [text("ETag"), F.col("tag")], none),
        one("same", "revisit", at + 100, 304, [text("ETag"), F.col("tag"), text("Cache-Control"), text("max-age=60"), text("Date"), text("now")], none, respelt=True),
        one("weak", "revisit", at + 200, 304, [text("etag"), F.concat(text("W/"), F.col("tag")), text("Content-Length"), text("0"), text("Content-Type"), text("none")], none),
        one("stale", "revisit", at + 300, 304, [text("ETag"), F.col("tag")], none),
        one("again", "revisit", at + 320, 304, [text("ETag"), F.col("tag2"), text("Cache-Control"), text("max-age=60"), text("Date"), text("now")], none),
        one("dated", "revisit", at + 330, 304, [text("Last-Modified"), F.col("day2"), text("Expires"), text("never")], none, respelt=True),
        one("alike", "revisit", at + 340, 304, [], F.col("digest2")),
        one("moved", "revisit", at + 400, 304, [text("ETag"), text('"other"')], F.col("digest")),
        one("bare", "revisit", at + 410, 304, [], none),
    ]
    base = pages.where("page_id is not null and html is not null").select("page_id", "url", "html").withColumns({"tag": tag, "day": day, "digest": digest})
    base = base.withColumns({
        "tag2": F.concat(F.lit('"2'), F.substr("tag", F.lit(2))), "day2": F.concat(F.lit("late "), F.col("day")), "digest2": F.concat(F.col("digest"), F.lit("2")),
        "respelt": F.regexp_replace("url", r"#.*$", ""),
    })
    base = base.withColumn("respelt", F.concat("respelt", F.when(F.contains("respelt", F.lit("?")), F.lit("&utm_source=again#top")).otherwise(F.lit("?utm_source=again#top"))))
    return base.select(F.explode(F.array(*records)).alias("r")).select("r.record_id", "r.kind", "r.url", "r.captured_at", "r.status", "r.headers", "r.digest")


_KEY_SQL = """
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""

ORACLE = f"""
WITH p AS (
  SELECT page_id, url, '"' || left(md5(html), 16) || '"' AS tag, 'day ' || page_id AS day, length(html) AS n, 'sha1:' || sha1(html) AS digest,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^utm_'))) AS kept FROM p),
k AS (SELECT *, {_KEY_SQL} AS url_key, '"2' || substr(tag, 2) AS tag2, 'late ' || day AS day2, digest || '2' AS digest2 FROM q),
full_ AS (
  SELECT 'full-' || page_id AS response_id, url_key, page_id * 1000 AS response_at, tag AS ftag, day AS fday, n, digest AS fdigest, '600' AS age FROM k
  UNION ALL SELECT 'later-' || page_id, url_key, page_id * 1000 + 250, tag2, day2, n, digest2, '900' FROM k),
rev AS (
  SELECT 'early-' || page_id AS revisit_id, url_key, page_id * 1000 - 500 AS captured_at, tag AS rtag, NULL AS rday, 'e' AS what, NULL AS rdigest FROM k
  UNION ALL SELECT 'same-' || page_id, url_key, page_id * 1000 + 100, tag, NULL, 's', NULL FROM k
  UNION ALL SELECT 'weak-' || page_id, url_key, page_id * 1000 + 200, tag, NULL, 'w', NULL FROM k
  UNION ALL SELECT 'stale-' || page_id, url_key, page_id * 1000 + 300, tag, NULL, 't', NULL FROM k
  UNION ALL SELECT 'again-' || page_id, url_key, page_id * 1000 + 320, tag2, NULL, 's', NULL FROM k
  UNION ALL SELECT 'dated-' || page_id, url_key, page_id * 1000 + 330, NULL, day2, 'd', NULL FROM k
  UNION ALL SELECT 'alike-' || page_id, url_key, page_id * 1000 + 340, NULL, NULL, 'a', digest2 FROM k
  UNION ALL SELECT 'moved-' || page_id, url_key, page_id * 1000 + 400, '"other"', NULL, 'm', digest FROM k
  UNION ALL SELECT 'bare-' || page_id, url_key, page_id * 1000 + 410, NULL, NULL, 'b', NULL FROM k),
j AS (SELECT r.*, f.* EXCLUDE (url_key) FROM rev r ASOF LEFT JOIN
      (SELECT url_key, response_at, max_by(response_id, response_id) AS response_id, max_by(ftag, response_id) AS ftag, max_by(fday, response_id) AS fday,
              max_by(n, response_id) AS n, max_by(fdigest, response_id) AS fdigest, max_by(age, response_id) AS age FROM full_ GROUP BY url_key, response_at) f
      ON r.url_key = f.url_key AND r.captured_at > f.response_at),
v AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN rtag IS NOT NULL THEN CASE WHEN rtag = ftag THEN 'etag' ELSE 'changed' END
                     WHEN rday IS NOT NULL THEN CASE WHEN rday = fday THEN 'last-modified' ELSE 'changed' END
                     WHEN rdigest IS NOT NULL THEN CASE WHEN rdigest = fdigest THEN 'digest' ELSE 'changed' END ELSE 'unverifiable' END AS verdict FROM j)
SELECT revisit_id, url_key, captured_at,
       CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN response_id END AS response_id,
       CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN response_at END AS response_at, verdict,
       CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN CAST(200 AS INTEGER) END AS status,
       CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN fdigest END AS digest,
       CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN
         'cache-control: max-age=' || CASE WHEN what = 's' THEN '60' ELSE age END || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html'
         || CASE WHEN what = 's' THEN chr(10) || 'date: now' ELSE '' END
         || chr(10) || 'etag: ' || CASE WHEN what = 'w' THEN 'W/' || rtag ELSE ftag END
         || CASE WHEN what = 'd' THEN chr(10) || 'expires: never' ELSE '' END
         || chr(10) || 'last-modified: ' || fday END AS headers
FROM v"""


def format_record(kind: str, record_id: str, url: str, date: str, status: int | None, headers: dict[str, str], body: bytes, digest: str | None = None) -> bytes:
    """One WARC 1.1 record with an HTTP answer in it."""
    http = b""
    if status is not None:
        lines = [f"HTTP/1.1 {status} -", *(f"{k}: {v}" for k, v in headers.items())]
        http = ("\r\n".join(lines) + "\r\n\r\n").encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}"]
    head += [f"WARC-Payload-Digest: {digest}"] if digest else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + http + body + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            k, v = line.split(b":", 1)
            last = k.strip().lower().decode("utf-8", "replace")
            out[last] = v.strip().decode("utf-8", "replace")
    return out


class _Inflated(io.RawIOBase):
    """What gzip members in a row hold, inflated as it is read.  It ends where a member is cut off or damaged, and before
    bytes that are no member."""

    def __init__(self, raw):
        self.raw, self.rest, self.engine = raw, b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if not self.rest:
                self.rest = self.raw.read(1 << 16)
                if not self.rest:
                    return 0
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            try:
                out = self.engine.decompress(self.rest, len(into))
            except zlib.error:
                self.rest, self.raw = b"", io.BytesIO()
                return 0
            self.rest = self.engine.unconsumed_tail
            if self.engine.eof:
                self.rest, self.engine = self.engine.unused_data, None
            if out:
                into[: len(out)] = out
                return len(out)


def _heads(stream: io.BufferedReader):
    """(header lines, stream after them) of each record, found by the version at the start of a line."""
    while line := stream.readline(1 << 20):
        if not line.startswith(b"WARC/"):
            continue
        lines: list[bytes] = []
        while (line := stream.readline(1 << 20)) and line.strip():
            lines.append(line.rstrip(b"\r\n"))
        if not line:
            return
        yield lines


def parse_warc(data):
    """Tuples of RECORD's columns, in order, of bytes or a binary stream; one record is held at a time.

    Gzip members are inflated as they are read.  A record cut off at the end, or in a damaged member, is left out with what
    follows, and bytes between records are passed over.
    """
    from datetime import datetime

    stream = io.BufferedReader(io.BytesIO(data)) if isinstance(data, (bytes, bytearray, memoryview)) else io.BufferedReader(data)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(_Inflated(stream), 1 << 16)
    for lines in _heads(stream):
        head = _fields(lines)
        size = head.get("content-length", "0")
        if not (size.isascii() and size.isdigit()):
            continue
        block = stream.read(int(size))
        if len(block) < int(size):
            return
        status, headers, body = None, {}, block
        if block[:5] == b"HTTP/":
            top, _, body = block.partition(b"\r\n\r\n")
            lines = top.split(b"\r\n")
            code = lines[0].split()[1:2]
            status = int(code[0]) if code and len(code[0]) < 9 and code[0].isdigit() else None
            headers = _fields(lines[1:])
        try:
            when = int(datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00")).timestamp())
        except (KeyError, ValueError, OverflowError):
            when = None
        yield head.get("warc-record-id", "").strip("<>") or None, head.get("warc-type"), head.get("warc-target-uri"), when, status, headers, head.get("warc-payload-digest"), body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, one task a file or more; ``body`` is that of the record as it is stored.

    A file comes to its task as it lies, at most 2 GB, the most that Spark reads as one value; it is inflated bit by
    bit, and records go on in batches of about READ_BYTES.
    """

    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in RECORD.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"captured_at": "Int64", "status": "Int32"})
        for pdf in frames:
            for data in pdf["content"]:
                rows, held = [], 0
                for record in parse_warc(bytes(data)):
                    rows.append(record)
                    held += len(record[-1])
                    if held > READ_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)
