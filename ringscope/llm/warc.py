"""WARC archives: writing, reading back, and a merged capture index.

Writing is all DataFrame operations. Equal captures (same id, URL and payload) are counted
as one, and payload digests are grouped to find responses and revisits; only ids, URLs
and digests take part in that. Revisits have no payload and are written from that table;
only responses are joined with their pages. No row is known by its place in a scan. Each
task then writes its records in the order of URL key and date as one archive, by Spark's
text writer with the record separator as line separator, so any file system works and a
lost executor's task is simply run again. An archive holds about ARCHIVE_BYTES bytes.
Offsets count bytes of the unpacked archive, as Spark's writer packs whole files.

Reading parses each archive as a stream. Its captures form a locally sorted run. The
index is merged externally: captures are dealt by ranges of (URL key, date, id), where a
run arrives as sorted stretches. A range finds the stretches as they come, without
sorting, and merges them with a loser tree, so that the ranges in order hold the globally
ordered capture histories. The range key holds the id, so one very common URL spreads
over several ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, read, scratch, stored, text_or_empty

#: Bytes of payload in one archive, about, and its records at most.
ARCHIVE_BYTES, RECORDS_PER_FILE = 64 << 20, 10_000
#: Captures that one merging task holds, about.
RANGE_ROWS = 200_000
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Seconds from 1970 to the year 10000, which a WARC date can't name.
LAST_SECOND = 253_402_300_800


def base32_sha1(col) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits as eight digits each."""
    hexed = F.sha1(col)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), BASE32_FROM, BASE32_TO)


def url_key(col) -> Column:
    """Host labels in reverse order without www, then path and query; a URL without a
    host is its own key."""
    lower = F.lower(col)
    host = F.regexp_extract(lower, r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?(?:www\d*\.)?([^/:?#]*)", 1)
    rest = F.regexp_replace(lower, r"^[a-z][a-z0-9+.\-]*://[^/?#]*", "")
    return F.when(host == "", lower).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def classify(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """From _id, url, digest, payload_bytes: one row per different capture, with n, the number
    of equal ones, responses, how many of them are responses, and refers_to of the others.
    Of equal payloads of at least min_bytes bytes the smallest id (null last; then the
    smallest URL) is the response, and of captures that are equal in all of that one."""
    rows = stored(captures.groupBy("_id", "url", "digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n")), "captures")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", F.col("url").isNull().alias("no_url"), "url"))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(first.alias("first")).select("digest", F.col("first._id").alias("first_id"), F.col("first.url").alias("first_url"))
    large = F.col("payload_bytes") >= min_bytes
    leads = F.col("_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    responses = F.when(~large, F.col("n")).when(leads, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return stored(rows.join(groups, "digest", "left").select("_id", "url", "digest", "payload_bytes", "n", responses.alias("responses"), F.when(large, F.col("first_id")).alias("refers_to"), F.when(large, F.col("first_url")).alias("refers_url")), "typed")


def _header(name: str, value) -> Column:
    return F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), F.lit(CRLF))


def first_payloads(source: DataFrame, typed: DataFrame) -> DataFrame:
    """The captures typed(_id, url, digest, payload_bytes, responses) with their html from
    source, once each. Captures meet by one key without nulls, as in record ids, so that
    payloads are shuffled once, for the join and for what makes equal captures one."""
    capture = F.md5(F.to_json(F.struct("_id", "url", "digest"))).alias("capture")
    wanted = typed.select(capture, "digest", "_id", "url", "payload_bytes", "responses")
    return source.select(capture, "html").join(wanted, "capture").dropDuplicates(["capture"])  # equal captures bring equal payloads


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, compression: str = "gzip") -> None:
    """One record per row of pages under path. A null html counts as empty, a null url
    or id is written as an empty header; ids are percent-encoded, so that any text comes
    back as it was. WARC-Date counts seconds from 1970 in UTC by a whole number id (modulo
    the last date there is), since the table has no dates. A revisit refers to the record id
    of its response. Other columns are not read."""
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    source = source.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    typed = classify(source.select("_id", "url", "digest", F.octet_length("html").cast("long").alias("payload_bytes")), min_bytes)
    copies = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    revisits = typed.where("n > responses").select("_id", "url", "digest", "payload_bytes", "refers_to", "refers_url", F.lit("revisit").alias("record_type"), F.lit("").alias("html"), copies(F.col("n") - F.col("responses")).alias("copy"))
    once = first_payloads(source, typed.where("responses > 0"))
    refers = [F.lit(None).cast(typed.schema[c].dataType).alias(c) for c in ("refers_to", "refers_url")]
    responses = once.select("_id", "url", "digest", "payload_bytes", *refers, F.lit("response").alias("record_type"), "html", copies(F.col("responses")).alias("copy"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seconds = F.pmod(F.coalesce(F.col("_id").cast("string").try_cast("long"), F.lit(0)), F.lit(LAST_SECOND))
    clock = F.pmod(seconds, F.lit(86_400))
    date = F.concat(F.date_format(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd"), F.format_string("T%02d:%02d:%02dZ", F.floor(clock / 3600), F.floor(clock % 3600 / 60), clock % 60))
    rows = revisits.unionByName(responses).withColumn("date", date).withColumn("key", F.coalesce(url_key(F.col("url")), F.lit("")))
    urn = lambda page, url, kind, copy: F.concat(F.lit("<urn:ringscope:capture:"), F.md5(F.to_json(F.struct(F.col(page).alias("_id"), F.col(url).alias("url"), "digest"))), F.lit("-"), kind, copy, F.lit(">"))
    name = urn("_id", "url", F.substring("record_type", 1, 3), F.col("copy").cast("string"))
    response = urn("refers_to", "refers_url", F.lit("res"), F.lit("1"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", name),
        _header("WARC-Date", F.col("date")), _header("WARC-Target-URI", text("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _header("WARC-Refers-To", response), _header("X-Refers-To-Page-Id", F.url_encode(text("refers_to"))))).otherwise(F.lit("")),
        _header("X-Page-Id", F.url_encode(text("_id"))), _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF), F.col("block"),
    )
    mean = typed.agg(F.sum(F.col("payload_bytes") * F.col("responses")) / F.sum("n")).first()[0] or 0
    run = rows.withColumn("block", F.concat(http, F.col("html"))).sortWithinPartitions("key", "date", "_id", "copy").select(record.alias("value"))
    run.write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", int(min(RECORDS_PER_FILE, max(100, ARCHIVE_BYTES // (mean + 600))))).text(path)


def parse_archive(stream) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Headers (names lower-cased), place and block of each record of a stream."""
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {start}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        at += len(line)
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record at {start} is cut short")
        at += size
        yield headers, start, block


READ = "archive string, offset long, record_id string, refers_to_record string, url string, date string, id_text string, record_type string, refers_text string, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; refers_text (the id of the page referred to) and refers_to_record
    (its record id) are null for responses. Bytes and digest of responses are taken from the payload as
    read; a digest that differs from the header's is an error. Revisits state theirs."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows = []
                for h, at, block in parse_archive(io.BufferedReader(stream, 1 << 20)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest:
                            raise ValueError(f"payload of {name} at {at} is damaged")
                    else:
                        size = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                    refers = unquote_plus(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None
                    row = (name, at, h["warc-record-id"], h.get("warc-refers-to"), h["warc-target-uri"], h["warc-date"], unquote_plus(h["x-page-id"]), h["warc-type"], refers, size, digest)
                    rows.append((*row, payload.decode("utf-8", "replace")) if with_payload else row)
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    schema = READ + (", payload string" if with_payload else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    return bounded_batches(spark.read.format("binaryFile").load(path)).select("path", "content").mapInPandas(parse, schema)


class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of each match, so that a new
    head replays only the matches on its way to the top. Only heads are held."""

    def __init__(self, runs: Sequence[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.losers = [-1] * max(self.k, 1)
        winners = {self.k + i: i for i in range(self.k)}
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            win, lose = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.losers[node] = win, lose
        self.top = winners.get(1, 0)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; ended runs come last, ties by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.top] is not None:
            yield self.heads[self.top]
            win = self.top
            self.heads[win] = next(self.runs[win], None)
            node = (self.k + win) // 2
            while node:
                if self._before(self.losers[node], win):
                    win, self.losers[node] = self.losers[node], win
                node //= 2
            self.top = win


def stretches(keys: Sequence[tuple]) -> list[tuple[int, int]]:
    """Where the ascending stretches of keys begin and end. Archives are sorted and a
    shuffle keeps the order within a block, so there are about as many as archives."""
    cuts = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1]), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False)) if keys else []


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures in global order of key, date, id_text, archive, offset, by merging the
    archives' sorted runs range by range; range_no and place give that order."""
    n = max(1, -(-captures.count() // range_rows), min(captures.sparkSession.sparkContext.defaultParallelism, 64))
    order = ["key", "date", "id_text", "archive", "offset"]
    ranged = captures.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        keys = list(zip(*(pdf[c] for c in order), range(len(pdf)), strict=True))
        at = [key[-1] for key in LoserTree([map(keys.__getitem__, range(a, b)) for a, b in stretches(keys)])]
        yield pdf.take(at).assign(place=range(len(at)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields)
    return ranged.mapInPandas(merge, fields + ", place long")


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The globally ordered captures of all archives under path."""
    captures = stored(read_warc(spark, path).withColumn("key", F.coalesce(url_key(F.col("url")), F.lit(""))), "runs")
    return merge_runs(captures)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast({c} as {kind})")
    return capture_index(spark, path).select(
        number("id_text").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_text").alias("refers_to"), F.col("key").alias("url_key"), "range_no", "place"
    )
