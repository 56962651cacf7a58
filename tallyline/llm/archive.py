"""WARC archives and their merged capture index.

Writing: a task writes one archive (a gzip member per record) in the shared folder and returns index runs, each
sorted by URL key, timestamp and page.  Payloads of at least 1000 bytes are stored once: the largest page id has the
response, others are revisits of it.  Merging: rows are dealt by ranges of (URL key, timestamp, page); in a range the
runs are merged by a loser tree, so the parts in order are the globally ordered capture histories.  Reading: the
merged index is the work list; records are read at their offsets and their digests computed anew.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, base, durable, fresh_dir, open_store

LEAST_BYTES = 1000  # smaller payloads are always stored
RUN_ROWS = 50_000
RANGE_ROWS = 100_000
FIRST = datetime(2020, 1, 1)
INDEX = "url_key string, timestamp string, page_id long, run string, pos long, path string, offset long, length long"
_INDEX = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("run", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and query, in lower case; null and unparsable URLs keep their text."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host = u.hostname or ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def timestamp(page_id: int | None) -> datetime:
    """The capture time: pages have none, so it follows from the id."""
    return FIRST + timedelta(seconds=(page_id or 0) % 100_000_000)


def record_id(page_id: int | None) -> str:
    n = 1 << 64 if page_id is None else page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>")).int
    return None if n >> 64 else n - (n >> 63 << 64)


def write_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP head; a revisit has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {timestamp(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; the digest of a response is computed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = page_of(fields["WARC-Record-ID"])
    if fields["WARC-Type"] == "revisit":
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        return page, size, declared, "revisit", page_of(fields["WARC-Refers-To"])
    digest = hashlib.sha1(payload).hexdigest()
    if digest != declared:
        raise ValueError(f"payload of page {page} does not have its digest")
    return page, len(payload), digest, "response", None


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha1, revisit, refers_to of every page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("bytes"))
    stored = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= LEAST_BYTES)
    stored = stored.groupBy("sha1", "bytes").agg(F.max("page_id").alias("holder"))
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    return rows.join(stored, ["sha1", "bytes"], "left").select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; rows of INDEX in sorted runs.  Only archives named in the result count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        path, sink, at, rows, runs = f"{root}/{name}.warc.gz", None, 0, [], 0

        def run():
            nonlocal rows, runs
            rows.sort(key=lambda r: r[0])
            out = [pa.array([r[0][k] if k < 2 else r[1] for r in rows], _INDEX.field(k).type) for k in range(3)]
            out += [pa.array([f"{name}-{runs}"] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([path] * len(rows)), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())]
            rows, runs = [], runs + 1
            return pa.RecordBatch.from_arrays(out, schema=_INDEX)

        for batch in batches:
            for page, url, html, sha1, revisit, refers in zip(*(batch[c].to_pylist() if c != "html" else (x.as_py() for x in batch[c].cast(pa.binary())) for c in ("page_id", "url", "html", "sha1", "revisit", "refers_to")), strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(write_record(page, url, html, sha1, refers, revisit)) + z.flush()
                sink.write(member)
                rows.append(((url_key(url), f"{timestamp(page):%Y%m%d%H%M%S}", -1 if page is None else page), page, at, len(member)))
                at += len(member)
                if len(rows) >= RUN_ROWS:
                    yield run()
        if sink is not None:
            sink.close()
        if rows:
            yield run()

    return durable(arrow_map(decisions(pages), write, INDEX))


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k-way merge by a loser tree: an inner node holds the loser of its two sides, so a step replays one path."""
    k = len(runs)
    if k == 0:
        return
    heads = [0] * k
    key = [r[0] if r else None for r in runs]

    def beats(a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0
        if key[a] is None or key[b] is None:
            return key[b] is None and (key[a] is not None or a < b)
        return (key[a], a) < (key[b], b)

    tree = [-1] * k  # a virtual run that beats all
    for leaf in range(k):
        _replay(tree, leaf, k, beats)
    while key[tree[0]] is not None:
        w = tree[0]
        yield key[w]
        heads[w] += 1
        key[w] = runs[w][heads[w]] if heads[w] < len(runs[w]) else None
        _replay(tree, w, k, beats)


def _replay(tree: list[int], winner: int, k: int, beats) -> None:
    node = (winner + k) // 2
    while node > 0:
        if beats(tree[node], winner):
            winner, tree[node] = tree[node], winner
        node //= 2
    tree[0] = winner


def merge_index(index: DataFrame) -> DataFrame:
    """The runs' rows in order of URL key, timestamp and page, part by part."""
    names = [f.name for f in _INDEX]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:  # about RANGE_ROWS rows
            for r in zip(*(batch[c].to_pylist() for c in names), strict=True):
                runs.setdefault(r[3], []).append((r[0], r[1], -1 if r[2] is None else r[2], r))
        rows = []
        for m in merge_runs(list(runs.values())):
            rows.append(m[3])
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)

    n = max(1, -(-index.count() // RANGE_ROWS))
    ranged = index.repartitionByRange(n, "url_key", "timestamp", "page_id", "path", "offset").sortWithinPartitions("run", "pos")
    return durable(arrow_map(ranged, merge, INDEX))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder)
        at, f = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(batch["path"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if path != at:
                    if f is not None:
                        f.close()
                    at, f = path, fs.open_input_file(path)
                rows.append(read_record(zlib.decompress(f.read_at(length, offset), 31)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict({
                "page_id": pa.array(cols[0], pa.int64()), "payload_bytes": pa.array(cols[1], pa.int64()), "payload_digest": pa.array(cols[2], pa.string()),
                "record_type": pa.array(cols[3], pa.string()), "refers_to": pa.array(cols[4], pa.int64()),
            })
        if f is not None:
            f.close()

    work = index.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return arrow_map(work, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, merge their index, read the records back through it.

    A null or empty html is an empty payload (always a response); a null URL has the empty key; rows that repeat page and
    payload are responses each; extra columns are not read; an empty table writes nothing and returns no rows.
    """
    base(pages.sparkSession)
    folder = folder or fresh_dir(pages.sparkSession, "archives")
    return read_archives(merge_index(write_archives(pages, folder)), folder)
