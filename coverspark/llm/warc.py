"""WARC archives: write captures, read them back, and merge their indexes into capture histories.

Writing is a Spark job whose text writer puts one record after another into files of bounded size; of captures with one
payload of some size, only one carries it and the others refer to it.  Reading parses each file and sorts its index
entries: a run.  Runs are cut at shared bounds of (URL key, timestamp, page) and the pieces of a range are merged by a
loser tree, so that histories come out in order over all ranges, however many captures one URL has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverspark.llm.common import batches_of, cut, shared_dir, text_of, tidy

END = "\r\n\r\n"
#: Bytes of the records of the smallest class.
SMALL = 4096
FIELDS = "page_id string, record_type string, refers_to string, digest string, payload_bytes long, urlkey string, ts string, file string, at long, length long"


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, then path and query, lower case; what can't be read stays as it is."""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url.strip().lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _record(kind: Column, head: list[tuple[str, Column]], http: Column, payload: Column) -> Column:
    """One record as text; the writer's separator ends it.  Its length counts UTF-8 bytes."""
    block = F.concat(http, payload)
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind]
    for name, value in [*head, ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(""))
    return F.concat(*lines, F.lit("\r\n\r\n"), block)


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, file_bytes: int = 8 << 20, broadcast_rows: int = 500_000
) -> str:
    """Write a record for every row and return the folder, a new one under the session's shared folder.

    Of rows with equal payloads of at least ``least`` bytes the one with the greatest id is the response; the others
    are revisits without payload.  Null payloads are empty.  Line breaks in a URL become spaces; a null URL or id is
    written as ``-``.  Very long payloads are written whole, an empty table gives an empty folder, and extra columns
    are not read.  Records are written by size, in classes of a factor of four (a job each), so a file has at most
    ``file_bytes`` bytes or is one record.  Capture times follow the ids, a second each, from the year 2000 on; rows that repeat an id are
    all responses if that id is the greatest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text_of(payload_col).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.col("size") >= least).select("id", "digest")
    kept = large.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    kept = cut(kept)
    # few enough of them: payloads need not move to meet their response
    near = F.broadcast(kept) if kept.count() <= broadcast_rows else kept
    held = F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0)) + 600
    level = F.greatest(F.lit(0), F.ceil(F.log2(held / SMALL) / 2)).cast("int")  # at most SMALL x 4^level bytes
    levels = sorted(r[0] for r in rows.select(level).distinct().collect()) or [0]
    rows = rows.join(near, "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")) & (F.col("size") >= least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    moment = F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(7_000_000_000)))
    head = [
        ("WARC-Record-ID", name(F.col("id"))),
        ("WARC-Date", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("-")), r"[\r\n]+", " ")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(revisit, name(F.col("response")))),
    ]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    kind = F.when(revisit, F.lit("revisit")).otherwise("response")
    record = _record(kind, head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = rows.select(record.alias("value"), level.alias("level"))
    for k in levels:
        most = max(1, file_bytes // (SMALL << 2 * k))
        records.filter(F.col("level") == k).select("value").write.option("lineSep", END).option("maxRecordsPerFile", most).mode("append").text(folder)
    return folder


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        yield head, data[start : start + size], at, start + size - at
        at = start + size + 4


class LoserTree:
    """Merges sorted runs; every inner node keeps the loser of its match, so a new entry climbs one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.n = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.n
        self.winner = self._build(1) if self.n > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) <= (y, b)

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.n) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def read_runs(spark, folder: str) -> DataFrame:
    """An entry for every record, sorted within each file by URL key, time and page; with the payload as read."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha1

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for head, block, at, length in parse(content.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = head["warc-type"]
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = sha1(payload).hexdigest() if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:")
                    name = lambda x: None if (v := x[10:-1]) == "-" else v
                    page, refers = name(head["warc-record-id"]), head.get("warc-refers-to")
                    key, ts = url_key(head["warc-target-uri"]), "".join(c for c in head["warc-date"] if c.isdigit())
                    rows.append((page, kind, name(refers) if refers else None, digest, size, key, ts, path, at, length))
                rows.sort(key=lambda r: (r[5], r[6], int(r[0] or -1)))
                for start in range(0, len(rows), 5000):
                    columns = zip(*rows[start : start + 5000], strict=True)
                    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in FIELDS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, FIELDS)


def histories(entries: DataFrame, range_entries: int = 20_000) -> DataFrame:
    """Entries with ``position``: their place, gapless from 0, in the order of URL key, timestamp and page.

    The ranges' bounds are quantiles of the entries' own keys, page included, so a URL with very many captures is
    spread over ranges; each file's run is cut at them, the exchange keeps the order of its pieces, and the pieces of a
    range are merged by a loser tree.  A piece is sorted again only if it should have arrived out of order.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    page = F.lpad(F.coalesce("page_id", F.lit("")), 20, "0")
    entries = cut(entries.withColumn("order", F.concat_ws("\0", "urlkey", "ts", page)))
    n = entries.count() // range_entries + 1
    ranged = cut(entries.repartitionByRange(n, "order").withColumn("range", F.spark_partition_id().cast("long")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    pieces = ranged.select("range", F.struct("order", *names).alias("e"))

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        index = 0
        for batch in batches:
            for index, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs.setdefault(e["file"], []).append(tuple(e.values()))
        pieces = [r if all(a[0] <= b[0] for a, b in pairwise(r)) else sorted(r, key=lambda x: x[0]) for r in runs.values()]
        rows = [(index, k, *x[1:]) for k, x in enumerate(LoserTree(pieces))] if pieces else []
        for start in range(0, len(rows), 5000):
            kinds = [pa.int64(), pa.int64()] + [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.int64()] * 2
            columns = zip(*rows[start : start + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["range", "rank", *names])

    merged = pieces.mapInArrow(merge, f"range long, rank long, {FIELDS}")
    return merged.join(starts, "range").withColumn("position", F.col("start") + F.col("rank")).drop("range", "rank", "start")


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Write the pages' archives, read them back and merge their indexes; one row per page, as ``histories`` gives them.

    Null payloads are empty, null ids and URLs are read back as null and ``-``, very long payloads are the only records of their
    files, repeated rows are records each, an empty table gives no rows, and extra columns are not read.
    """
    folder = write_archives(pages, id_col, url_col, payload_col, least)
    with batches_of(pages.sparkSession, 1):  # a file each
        runs = cut(read_runs(pages.sparkSession, folder))
    return histories(runs)
