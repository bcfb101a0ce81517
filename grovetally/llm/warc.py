"""WARC archives with revisit records, and their capture index by external merging.

``write_archives`` writes a gzip member for each page into archives of bounded size, each by one
task attempt and under a name of its own; only the files of attempts that succeed are ever
named by the result, so a repeated task does no harm. ``read_archives`` streams them back.
``capture_index`` orders captures by URL key and time: every archive is a locally sorted run,
and inside each key range a loser tree merges the runs that reach into it.

Archives are written and read through ``pyarrow.fs`` at the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, map_arrow, shared_path, written

LEAST_REVISIT, ARCHIVE_BYTES, LEVEL = 1000, 32 << 20, 1
#: Tasks that read archives at most, and captures in a key range of the index.
READERS, RANGE = 100_000, 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Pages have no time of their own: it is the id in seconds after EPOCH, within about 50 years.
YEARS = 1_600_000_000
RECORD = "path string, offset long, url_key string, captured string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ORDER = ["url_key", "captured", "page_id"]


def url_key(url: str) -> str:
    """The sort key of a URL: host parts from the right, then path and sorted query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + query).lower()


def one_line(value: str) -> str:
    """A header value without line breaks; reversible."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def as_written(value: str) -> str:
    """The inverse of :func:`one_line`."""
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, size: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, read in small pieces."""
    at = start = 0
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        piece = rest or stream.read(size)
        if not piece:
            break
        out.append(z.decompress(piece))
        rest = z.unused_data
        at += len(piece) - len(rest)
        if z.eof:
            yield start, b"".join(out)
            start, out, z = at, [], zlib.decompressobj(31)
    if out and any(out):
        raise EOFError("an archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


#: The most payloads that are broadcast to find the pages that repeat them; each takes about 100 bytes.
SENT_PAYLOADS = 500_000


def repeated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(payload, target) of the payloads of ``least`` bytes or more that several rows have: their digest and
    the largest id. Digests are folded before the shuffle; the table is written, so that a join with it can be split."""
    html = F.coalesce("html", F.lit(""))
    light = pages.where(F.octet_length(html) >= least).select("page_id", F.sha1(F.encode(html, "utf-8")).alias("payload"))
    shared = light.groupBy("payload").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null")
    return written(shared.drop("n"), "payloads")


def write_archives(pages: DataFrame, dest: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``dest`` and returns
    the archives (path, records).

    Null html is an empty payload, a null url an empty one. Of pages with equal payloads of at
    least ``least`` bytes that with the largest id is a response and the others revisit it; rows
    that repeat the largest id are responses too. A null id revisits an equal payload whose id is
    not null. Empty tables give no archives. Other columns are not read.
    """
    marked = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marked = marked.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    known = repeated(pages, least)
    # pages stay where they are as long as the repeated payloads are few enough to send
    known = F.broadcast(known) if known.count() <= SENT_PAYLOADS else known
    marked = marked.join(known, marked["digest"] == known["payload"], "left")
    marked = marked.withColumn("target", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")))

    def run(batches):
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(dest)
        store.create_dir(root, recursive=True)
        out, n, size, path, number = None, 0, 0, "", 0
        for b in batches:
            for page_id, url, html, digest, target in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, n, size, number = store.open_output_stream(path, compression=None), 0, 0, number + 1
                payload = html.encode()
                kind = "response" if target is None else "revisit"
                when = EPOCH + timedelta(seconds=(page_id or 0) % YEARS)
                url = url or ""
                broken = "\r" in url or "\n" in url
                headers = [
                    ("WARC-Target-URI", one_line(url) if broken else url), ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
                    ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
                    ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(len(payload))),
                ]
                if broken:
                    headers.append(("X-Target-Escaped", "1"))
                if target is not None:
                    headers += [("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                data = _member(record(kind, headers, payload if target is None else b""))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    rows = marked.select("page_id", "url", "html", "digest", F.col("target"))
    return cut(rows.transform(map_arrow, run, "path string, records long"))


def _id(value: str) -> int | None:
    found = value.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def read_archives(archives: DataFrame, dest: str) -> DataFrame:
    """A row for each record of the archives, with the figures of its full payload, in runs:
    the rows of one archive come sorted by URL key, time and id. Payloads are checked
    against their digests. An archive is read by one task; up to ``READERS`` archives have a task each, more share them."""
    n = max(1, min(archives.count(), READERS))

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(dest)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as f:
                    for offset, data in members(f):
                        h, block = parse(data)
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if h["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != int(h["X-Payload-Length"])):
                            raise ValueError(f"{path} at {offset}: the payload does not fit its digest")
                        url = as_written(h["WARC-Target-URI"]) if "X-Target-Escaped" in h else h["WARC-Target-URI"]
                        when = h["WARC-Date"].translate({ord(c): None for c in "-T:Z"})
                        rows.append((path, offset, url_key(url), when, url, _id(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, h["WARC-Type"], _id(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None))
                rows.sort(key=_place)
                for i in range(0, len(rows), 4096):
                    yield _batch(rows[i : i + 4096])

    return archives.select("path").repartition(n, "path").transform(map_arrow, run, RECORD)


def _place(row: tuple) -> tuple:
    """Key bytes, time, id (null first), place: the order of the index."""
    return (row[2].encode(), row[3], row[5] is not None, row[5] or 0, row[0], row[1])


_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in RECORD.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


class Run:
    """The rows of a sorted run, kept as Arrow batches and taken out a few at a time."""

    def __init__(self, batches: list[pa.RecordBatch], few: int = 64):
        self.batches, self.few = batches, few

    def __iter__(self) -> Iterator[tuple]:
        for b in self.batches:
            for i in range(0, b.num_rows, self.few):
                yield from zip(*(c.to_pylist() for c in b.slice(i, self.few).columns), strict=True)


def merge(runs: list) -> Iterator[tuple]:
    """K-way merge of sorted runs by a loser tree: one comparison a level for each row taken. Only the next row of each run
    is held."""
    k = len(runs)
    if not k:
        return
    runs = [iter(r) for r in runs]
    row = [next(r, None) for r in runs]
    key = [_place(r) if r is not None else None for r in row]

    def beats(a: int, b: int) -> bool:
        """Whether run a's next row comes before run b's; an ended run loses."""
        if key[a] is None or key[b] is None:
            return key[b] is None and (key[a] is not None or a < b)
        return (key[a], a) < (key[b], b)

    losers = [-1] * k
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node > 0 and losers[node] >= 0:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[node if node > 0 else 0] = winner
    while key[top := losers[0]] is not None:
        yield row[top]
        row[top] = next(runs[top], None)
        key[top] = _place(row[top]) if row[top] is not None else None
        winner, node = top, (top + k) // 2
        while node > 0:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def capture_index(records: DataFrame) -> DataFrame:
    """The rows of ``read_archives`` in one global order: partitions are key ranges in order.

    The captures of a range come as the runs they were in, one archive after another, and the loser tree merges
    them. Key ranges are cut by URL key, time and id together and hold about ``RANGE`` captures, so neither a common host nor a page
    captured very often fills one range, and what a task holds does not grow with the input.
    """
    records = cut(records)
    ranges = -(-records.count() // RANGE)
    ranged = records.repartitionByRange(max(1, ranges), *_ORDER, "path", "offset").sortWithinPartitions("path", *_ORDER, "offset")

    def run(batches):
        runs, last = [], None
        for b in batches:
            paths = b.column(0)
            at = 0
            while at < b.num_rows:
                path, to = paths[at].as_py(), at
                while to < b.num_rows and paths[to].as_py() == path:
                    to += 1
                if path != last:
                    runs.append([])
                    last = path
                runs[-1].append(b.slice(at, to - at))
                at = to
        out = []
        for row in merge([Run(r) for r in runs]):
            out.append(row)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return ranged.transform(map_arrow, run, RECORD)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back and merges their index."""
    dest = shared_path(pages.sparkSession, "warc")
    return capture_index(read_archives(write_archives(pages, dest, **options), dest))
