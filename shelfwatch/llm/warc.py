"""WARC archives of pages and the globally ordered index of their captures.

Pages are written as gzip-per-record WARC files: of equal payloads the capture with the smallest
page_id is a response, the others are revisits of it. The archives are then read back record by
record; each gives a run, its captures sorted by (URL key, timestamp, page_id). Runs are merged
with a loser tree: the key space is cut into ranges of about ``RANGE_ROWS`` captures at the keys that
head the runs' blocks, a merge task takes the blocks of at most ``FAN_IN`` runs that touch its range,
holds one block of each, and writes its range in order. More runs than that take further passes. The
histories are the ranges in order. A URL with most captures is cut by timestamp like any other keys.

Files are opened through the file system that the shared folder names (``pyarrow.fs``). A task writes
under a name of its own and reports it, and only reported files are read, so repeated or lost tasks
leave nothing wrong behind.

Results in special cases: a NULL html is an empty payload; payloads of less than ``min_bytes`` are all
responses; repeated rows of the smallest page_id are all responses; a page without id is a revisit
if another page has its payload; a NULL or empty URL has the key "-"; a NULL timestamp counts as 1970;
an empty table gives an empty result; input columns beside the four used are not carried.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm.common import before, pin
from shelfwatch.session import scratch_path

ARCHIVE_BYTES = 64 << 20
BLOCK_ROWS = 256
RANGE_ROWS = 100_000
FAN_IN = 128
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ENTRY = ("url_key", "captured", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length")
_ENTRY_DDL = ("url_key string, captured long, page_id long, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, archive string, offset long, length long")
_BLOCKS_DDL = "run string, first string, last string, offset long, length long, rows long"


def _open(path: str):
    """The file system of ``path`` and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query, in lower case."""
    parts = urlsplit((url or "").strip())
    if not parts.netloc:
        return "-"
    host = re.sub(r"^www\d*\.", "", parts.netloc.rpartition("@")[2].lower())
    host = re.sub(r":(80|443)?$", "", host)
    query = f"?{parts.query.lower()}" if parts.query else ""
    return quote(f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}{query}", safe="!-~,)(/?&=%:;+@$'*")


def _record(kind: str, page: int | None, url: str | None, captured: int, payload: bytes, refers: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    stamp = datetime.fromtimestamp(captured, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {stamp}",
             f"WARC-Target-URI: {quote(url or '', safe='!-~:/?#[]@&()*+,;=%$')}", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count = None, "", 0, 0
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, inner = _open(path)
                    out, size, count = fs.open_output_stream(inner, compression=None), 0, 0
                kind = "response" if row["refers_to"] is None else "revisit"
                size += out.write(_record(kind, row["page_id"], row["url"], row["captured"], (row["html"] or "").encode("utf-8", "surrogatepass"),
                                          row["refers_to"]))
                count += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        cols = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int64())],
                                         names=["archive", "records", "bytes"])
    return write


def write_archives(pages: DataFrame, captured: Column, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, bytes): the files written, one row each."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"),
                        F.coalesce(captured.cast("timestamp").cast("long"), F.lit(0)).alias("captured"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)))
    firsts = (rows.where("same IS NOT NULL").groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 AND first IS NOT NULL").select("same", "first"))
    rows = rows.join(firsts, "same", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    folder = scratch_path(spark, "archives")
    fs, inner = _open(folder)
    fs.create_dir(inner, recursive=True)
    written = rows.select("page_id", "url", "html", "captured", refers.alias("refers_to")).mapInArrow(
        _writer(folder, archive_bytes), "archive string, records long, bytes long")
    return pin(written, "manifest")


def read_archive(path: str) -> Iterator[dict]:
    """The records of one file with place, checked digest and size; one record in memory at a time."""
    fs, inner = _open(path)
    with fs.open_input_stream(inner, compression=None) as source:
        rest, at = b"", 0
        while True:
            member, parts, size = zlib.decompressobj(31), [], 0
            while not member.eof:
                data = rest or source.read(1 << 16)
                rest = b""
                if not data:
                    if size:
                        raise ValueError(f"{path} ends inside a record")
                    return
                parts.append(member.decompress(data))
                size += len(data)
            rest = member.unused_data
            size -= len(rest)
            yield {"archive": path, "offset": at, "length": size, **_parsed(b"".join(parts))}
            at += size


def _parsed(record: bytes) -> dict:
    head, _, tail = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = tail[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    number = lambda x: None if x == "<urn:page:none>" else int(x[len("<urn:page:"):-1])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("a payload does not match its digest")
    return {"url_key": url_key(fields["WARC-Target-URI"]), "page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
            "captured": int(datetime.fromisoformat(fields["WARC-Date"]).timestamp()), "payload_bytes": size, "payload_digest": digest,
            "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None}


# -- runs: lines "key TAB entry", in the order of the key, in blocks ---------------------------

def _key(e: dict) -> str:
    """Text that sorts like (url_key, captured, page_id, place); keys are unique."""
    page = -1 if e["page_id"] is None else e["page_id"] + (1 << 63)
    return f"{e['url_key']}\x01{e['captured'] + (1 << 62):020d}\x01{page + 1:020d}\x01{e['archive'].rpartition('/')[2]}\x01{e['offset']:020d}"


class _Run:
    """Writes sorted lines to a file and notes its blocks."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.run"
        fs, inner = _open(self.path)
        self.out, self.at, self.held, self.blocks = fs.open_output_stream(inner, compression=None), 0, [], []

    def add(self, key: str, entry: str) -> None:
        self.held.append((key, entry))
        if len(self.held) == BLOCK_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            data = zlib.compress("".join(f"{k}\t{e}\n" for k, e in self.held).encode(), 1)
            self.out.write(data)
            self.blocks.append((self.path, self.held[0][0], self.held[-1][0], self.at, len(data), len(self.held)))
            self.at += len(data)
            self.held = []

    def close(self) -> list[tuple]:
        self._flush()
        self.out.close()
        return self.blocks


def _block_frame(blocks: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(blocks, columns=["run", "first", "last", "offset", "length", "rows"])


def capture_runs(manifest: DataFrame) -> DataFrame:
    """Reads every archive back and writes its captures as a sorted run; a row per block."""
    folder = scratch_path(manifest.sparkSession, "runs")
    fs, inner = _open(folder)
    fs.create_dir(inner, recursive=True)

    def sort(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["archive"]:
                run = _Run(folder)
                for key, entry in sorted((_key(e), json.dumps([e[k] for k in _ENTRY])) for e in read_archive(archive)):
                    run.add(key, entry)
                yield _block_frame(run.close())

    parts = max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return pin(manifest.select("archive").repartition(parts, "archive").mapInPandas(sort, _BLOCKS_DDL), "run-blocks")


class LoserTree:
    """Merges sorted iterators of (key, value): each inner node holds the loser of its match."""

    def __init__(self, sources: list[Iterator[tuple[str, str]]]):
        self.sources = sources
        self.size = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [0] * self.size
        self.losers[0] = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[str, str]]:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head
            best = self.losers[0]
            self.heads[best] = next(self.sources[best], None)
            node = (best + self.size) // 2
            while node:
                if self._beats(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.losers[0] = best


def _lines(run: str, blocks: list[tuple[int, int]], low: str, high: str | None) -> Iterator[tuple[str, str]]:
    """The lines of some blocks of a run with low <= key < high, one block at a time."""
    fs, inner = _open(run)
    with fs.open_input_file(inner) as source:
        for offset, length in blocks:
            for line in io.StringIO(zlib.decompress(source.read_at(length, offset)).decode(), newline="\n"):
                key, _, entry = line.rstrip("\n").partition("\t")
                if key >= low and (high is None or key < high):
                    yield key, entry


def _ranges(blocks: DataFrame) -> list[str]:
    """Keys at which the key space is cut: the head of a block for every RANGE_ROWS captures before it."""
    heads = blocks.select(F.lit(0).alias("all"), "first", "rows")
    placed = before(heads, ["all"], ["first"], {"earlier": "rows"}, "heads")
    turn = F.floor(F.col("earlier") / RANGE_ROWS)
    cuts = placed.groupBy(turn.alias("range")).agg(F.min("first").alias("first")).where("range > 0")
    return sorted(r["first"] for r in cuts.select("first").collect())  # a key per RANGE_ROWS captures


def merge_runs(blocks: DataFrame) -> DataFrame:
    """The captures of all runs in global order: range, place in it, and the entry's fields."""
    spark = blocks.sparkSession
    cuts = _ranges(blocks)
    held = spark.sparkContext.broadcast(cuts)
    runs = blocks.select("run").distinct().count()
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(max(1, runs))).cast("int"))
    while runs > FAN_IN:
        blocks = _merged_runs(spark, blocks.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("int")), held)
        runs = -(-runs // FAN_IN)
    fields = "range int, place long, " + _ENTRY_DDL

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["range"].iloc[0])
        out = [(number, i, *json.loads(e)) for i, (_, e) in enumerate(_merge_of(rows, held.value))]
        return pd.DataFrame(out, columns=["range", "place", *_ENTRY], dtype=object).astype({"page_id": "Int64", "refers_to": "Int64"})

    return pin(_dealt(blocks, held).groupBy("range").applyInPandas(final, fields), "histories")


def _dealt(blocks: DataFrame, held) -> DataFrame:
    """A row per block and range it touches."""
    def touched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low = [bisect.bisect_right(held.value, k) for k in frame["first"]]
            high = [bisect.bisect_right(held.value, k) for k in frame["last"]]
            frame["range"] = [list(range(a, b + 1)) for a, b in zip(low, high)]
            yield frame

    return blocks.mapInPandas(touched, _BLOCKS_DDL + ", group int, range array<int>").withColumn("range", F.explode("range"))


def _merge_of(rows: pd.DataFrame, cuts: list[str]) -> LoserTree:
    number = int(rows["range"].iloc[0])
    low, high = cuts[number - 1] if number else "", cuts[number] if number < len(cuts) else None
    return LoserTree([_lines(run, list(zip(own["offset"], own["length"])), low, high)
                      for run, own in rows.sort_values(["run", "offset"]).groupby("run", sort=True)])


def _merged_runs(spark: SparkSession, blocks: DataFrame, held) -> DataFrame:
    """One more pass: in every range the runs of a group become one run."""
    folder = scratch_path(spark, "runs")
    fs, inner = _open(folder)
    fs.create_dir(inner, recursive=True)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        run = _Run(folder)
        for key, entry in _merge_of(rows, held.value):
            run.add(key, entry)
        done = _block_frame(run.close())
        return done.assign(group=rows["group"].iloc[0])

    # The files of a group hold different ranges, so a range meets one run of each group next time.
    return pin(_dealt(blocks, held).groupBy("group", "range").applyInPandas(merge, _BLOCKS_DDL + ", group int"), "run-blocks")


def capture_histories(pages: DataFrame, captured: Column, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives, reads them back, and returns the merged index: a row per capture with the place
    of its record; (range, place) is the global order by URL key and timestamp."""
    return merge_runs(capture_runs(write_archives(pages, captured, min_bytes, archive_bytes)))
