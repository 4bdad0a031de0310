"""WARC archives with revisit records, and an index of their captures by external merge.

Pages are written as WARC/1.1 records by Spark's text sink, whose line end is set to
the two line ends that close a record, so files land in the shared folder under
Spark's commit protocol. Of pages with equal payloads the one with the largest
page_id is a response with the payload; the others are revisits that carry headers
only and refer to it. Reading back, files are parsed by Content-Length alone, so
payloads may hold anything, and payload digests are computed again.

Archives are bounded by bytes: pages are written by classes of size, each with as many
records a file as fit into FILE_BYTES, or one that is larger by itself.

Each file's captures are sorted where they are read: a run, cut into blocks of BLOCK
captures. Runs are dealt out by ranges of (URL key, timestamp, page_id), cut also inside
a URL that has very many captures, and in each range a loser tree merges the runs' parts,
so that the parts one after another are the captures of all archives in order. A range's
blocks come to its task in the order of their first captures, sorted by Spark, which
spills. What is not after the first capture of the newest block can be given out, since
all that is still to come is after it; so a task holds about a block of each run, not its
range, and equal captures, however many, are given out at once.

Null html is an empty payload. A null url has the empty key and no target header, a
null page_id stays null and is never referred to before others. Repeated rows are
records of their own. Empty input gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, saved, small, table

CRLF = "\r\n"
#: Bytes of records that a file may have, and the largest pages of the classes of size.
FILE_BYTES, CLASSES = 64 << 20, (16 << 10, 1 << 20, None)
#: Bytes that a record's headers may take beside payload and URL.
HEADERS = 1 << 10
#: Captures of a block of a run, and those that a range of the merge should have.
BLOCK, RANGE = 256, 500_000
EPOCH = 1_704_067_200
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.upper(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _BASE32HEX, _BASE32)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, least_bytes: int = 0, keep: Column | None = None) -> DataFrame:
    """(value): a WARC record per page, without the line ends that close it, and kept,
    the value of an expression over the page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    body = html.cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20]", "%20").alias("url"), html.alias("html"),
                        F.octet_length(body).cast("long").alias("bytes"), sha1_base32(body).alias("digest"),
                        (date if date is not None else F.timestamp_seconds(EPOCH + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))).alias("date"),
                        (keep if keep is not None else F.lit(None).cast("int")).alias("kept"))
    several = base.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "last")
    base = base.join(small(saved(several, "several")), F.col("digest") == F.col("d"), "left")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")) & (F.col("bytes") >= least_bytes)

    def urn(x: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), "url"), F.lit("")), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), urn(F.col("last")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return base.select(F.concat(head, block).alias("value"), "kept")


def write(pages: DataFrame, path: str, url_col: str = "url", html_col: str = "html", **columns) -> None:
    """Write the pages' records as archives under path, a folder for each class of size
    that has pages (one for none), none over FILE_BYTES unless it is a single record."""
    size = F.octet_length(F.coalesce(F.col(html_col), F.lit(""))) + 4 * F.octet_length(F.coalesce(F.col(url_col), F.lit("")))
    of = F.lit(len(CLASSES) - 1)
    for i, most in reversed(list(enumerate(CLASSES[:-1]))):
        of = F.when(size <= most, i).otherwise(of)
    made, klass = records(pages, url_col=url_col, html_col=html_col, keep=of, **columns), F.col("kept")
    held = sorted(r[0] for r in pages.select(of.alias("kept")).distinct().collect())
    for i in held or [0]:
        most = CLASSES[i]
        per_file = FILE_BYTES // (most + HEADERS) if most else 1
        made.where(klass == i).select("value").write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).text(f"{path}/size-{i}")


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then path and query: sorts pages of a site together."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return (url or "").lower()
    if not host and not parts.path and not parts.query:
        return ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse(content: bytes):
    """(header fields, offset, length, payload) of the records in an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        block = content[start : start + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        fields["http-length"] = re.search(rb"(?i)content-length: (\d+)", http)[1].decode()
        yield fields, at, start + size - at, payload
        at = start + size + 4


RUN = "urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
#: A run's captures, each with its place and the first capture of its block.
DEALT = f"{RUN}, run long, seq int, first_urlkey string, first_ts string, first_page_id long"
FIRST = ["first_urlkey", "first_ts", "first_page_id"]


def _urn(value: str | None) -> int | None:
    bare = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(bare) if re.fullmatch(r"-?\d+", bare) else None


def _schema(names: str) -> pa.Schema:
    return pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in names.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _runs(batches):
    """The captures of each archive in order: one sorted run per file."""
    schema = _schema(DEALT)
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = []
            for h, at, length, payload in parse(content):
                revisit = h["warc-type"] == "revisit"
                digest = h["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                found.append((url_key(h.get("warc-target-uri")), h["warc-date"], _urn(h["warc-record-id"]), int(h["http-length"]) if revisit else len(payload), digest, h["warc-type"], _urn(h["warc-refers-to"]) if revisit else None, path, at, length))
            found.sort(key=order)
            run = int.from_bytes(hashlib.sha1(path.encode()).digest()[:8], "big", signed=True)
            yield _batch([(*r, run, i, *found[i - i % BLOCK][:3]) for i, r in enumerate(found)], schema)


def order(capture: tuple) -> tuple:
    """Captures sort by URL key, time and page; a null page_id comes first."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0


class LoserTree:
    """Merges k sorted sequences: each inner node remembers the loser of its match, so
    the next smallest item costs one path of log2 k comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.keys = [self._key(i) for i in range(len(runs))]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(len(runs)):
            self._play(i, building=True)

    def _key(self, i: int):
        run = self.runs[i]
        return (0, *order(run[self.at[i]]), i) if self.at[i] < len(run) else (1,)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if other >= 0 and self.keys[other] < self.keys[i]:
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def rest(self) -> list[list[tuple]]:
        """What is left of the runs that have not ended."""
        return [run[at:] for run, at in zip(self.runs, self.at) if at < len(run)]

    def __iter__(self):
        return self.until(None)

    def until(self, bound: tuple | None):
        """The items up to a bound, itself included, in order()'s terms (None: all)."""
        while self.runs and self.keys[self.winner][0] == 0 and (bound is None or self.keys[self.winner][1:-1] <= bound):
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.keys[i] = self._key(i)
            self._play(i)


def merged(batches: Iterator[list[tuple]], place: int, first: int) -> Iterator[tuple]:
    """Rows in order() from lists of rows: run at `place`, first capture of the row's block
    in the three places from `first`, sorted by first capture, run and place in the run."""
    live: dict[int, list[tuple]] = {}
    for rows in batches:
        for row in rows:
            live.setdefault(row[place], []).append(row)
        tree = LoserTree(list(live.values()))
        yield from tree.until(order(rows[-1][first : first + 3]))
        live = {run[0][place]: run for run in tree.rest()}
    yield from LoserTree(list(live.values()))


def _merge(batches):
    schema = _schema(RUN + ", rank long")
    wide = len(schema) - 1
    lists = (list(zip(*(c.to_pylist() for c in batch.columns))) for batch in batches if batch.num_rows)
    out: list[tuple] = []
    for n, row in enumerate(merged(lists, wide, wide + 2)):
        out.append((*row[:wide], n))
        if len(out) == 10_000:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path in order of URL key and time: position,
    urlkey, ts, page_id, payload, record and place in its archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    runs = saved(files.mapInArrow(_runs, DEALT), "runs")
    parts = max(1, min(partitions(spark), -(-(n := runs.count()) // 1000)), -(-n // RANGE))
    dealt = runs.repartitionByRange(parts, "urlkey", "ts", "page_id").sortWithinPartitions(*FIRST, "run", "seq")
    captures = saved(dealt.mapInArrow(_merge, RUN + ", rank long").withColumn("part", F.spark_partition_id()), "captures")
    sizes = captures.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per part
    offsets = sizes.select(F.col("part").alias("p"), before.alias("before"))
    out = captures.join(small(saved(offsets, "offsets")), F.col("part") == F.col("p"))
    return out.select((F.col("before") + F.col("rank")).alias("position"), *[f.split()[0] for f in RUN.split(", ")])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives give it back, with its place in the capture index."""
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position", "urlkey", "ts")
