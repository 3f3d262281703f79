"""WARC files with a two-level capture index: compressed blocks of sorted keys, and a sparse directory of the blocks."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import new_path, text_slices, written

BLOCK = 300  # captures in a compressed block
SEP = "\t"
PRINTABLE = "".join(map(chr, range(33, 127)))


def url_key(url: str) -> str:
    """Reversed host, port unless usual, path in lower case without last slash, sorted query: 'com,example)/a?b=1&c=2'.

    No scheme, user, fragment or leading 'www.'. A text that is no URL with a host is its own key, in lower case. All but
    printable ASCII is percent-encoded, so that keys have the same order everywhere.
    """
    return quote(_plain_key(url), safe=PRINTABLE)


def _plain_key(url: str) -> str:
    try:
        p = urlsplit(url.strip())
        port = p.port
    except ValueError:
        return url.strip().lower()
    host = (p.hostname or "").rstrip(".")
    if not host:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    where = "" if port in (None, 80, 443) else f":{port}"
    path = p.path.lower()
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path or "/"
    query = "&".join(sorted(p.query.lower().split("&"))) if p.query else ""
    return ",".join(reversed(host.split("."))) + where + ")" + path + ("?" + query if query else "")


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _record(url: str, body: bytes, page_id) -> bytes:
    """One gzip member with one WARC response record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    digest = hashlib.sha1(body).hexdigest()
    warc = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>\r\n"
        f"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(head) + len(body)}\r\n\r\n"
    ).encode()
    return gzip.compress(warc + head + body + b"\r\n\r\n", 4, mtime=0)


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record as written by write_warc()."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, body


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Writes every page as a record, one file a task, and returns the captures (key, page_id, file, offset, length).

    A file gets its name only when it is whole, and a task that runs again writes another one, so that lost executors leave
    nothing half done: only captures of whole files are returned.
    """

    def run(batches):
        disk, root = _open(path)
        disk.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                for part in text_slices(batch, "html"):
                    rows = []
                    for page, url, html in zip(part["page_id"].to_pylist(), part["url"].to_pylist(), part["html"].to_pylist()):
                        raw = _record(re.sub(r"[\r\n]", " ", url), (html or "").encode("utf-8", "surrogatepass"), page)
                        out = out or disk.open_output_stream(f"{root}/{name}.part", buffer_size=1 << 20)
                        out.write(raw)
                        rows.append((url_key(url), page, name, at, len(raw)))
                        at += len(raw)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()))], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()
        if out:
            disk.move(f"{root}/{name}.part", f"{root}/{name}")

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("page_id is not null and url is not null")
    return written(src.mapInArrow(run, "key string, page_id long, file string, offset long, length int"), "captures")


def write_index(captures: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Sorts the captures by (key, page_id) over the cluster, writes them as compressed blocks, and returns the directory:
    (first, last, file, offset, length, captures), one row a block. Beside each file lies its own part of the directory."""

    def run(batches):
        disk, root = _open(path)
        disk.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.cdx.gz"
        out, at, lines, rows = None, 0, [], []

        def flush():
            nonlocal out, at
            raw = gzip.compress("".join(x + "\n" for x in lines).encode(), 6, mtime=0)
            out = out or disk.open_output_stream(f"{root}/{name}.part")
            out.write(raw)
            rows.append((lines[0].split(SEP, 1)[0], lines[-1].split(SEP, 1)[0], name, at, len(raw), len(lines)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")]):
                lines.append(SEP.join(map(str, r)))
                if len(lines) == block:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with disk.open_output_stream(f"{root}/{name}.dir") as d:
                d.write("".join(SEP.join(map(str, r)) + "\n" for r in rows).encode())
            disk.move(f"{root}/{name}.part", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["first", "last", "file", "offset", "length", "captures"])

    return written(captures.orderBy("key", "page_id").mapInArrow(run, "first string, last string, file string, offset long, length int, captures int"), "directory")


class Reader:
    """Looks keys up in one index file: binary search in its directory, then range reads of the blocks that may hold the key.

    Keeps the last block, as sorted lookups hit the same one again, and up to 64 open files.
    """

    def __init__(self, index_path: str, file: str):
        self.disk, self.root = _open(index_path)
        self.files: dict = {}
        with self.disk.open_input_stream(f"{self.root}/{file}.dir") as d:
            rows = [x.split(SEP) for x in d.read().decode().split("\n")[:-1]]
        self.file, self.last = f"{self.root}/{file}", (None, None, None)
        self.firsts, self.lasts = [r[0] for r in rows], [r[1] for r in rows]
        self.places = [(int(r[3]), int(r[4])) for r in rows]

    def read(self, path: str, offset: int, length: int) -> bytes:
        f = self.files.get(path)
        if f is None:
            if len(self.files) >= 64:
                self.files.popitem()[1].close()
            f = self.files[path] = self.disk.open_input_file(path)
        return f.read_at(length, offset)

    def block(self, i: int) -> tuple[list[str], list[list[str]]]:
        if self.last[0] != i:
            lines = [x.split(SEP) for x in zlib.decompress(self.read(self.file, *self.places[i]), 31).decode().split("\n")[:-1]]
            self.last = (i, [x[0] for x in lines], lines)
        return self.last[1:]

    def lookup(self, key: str) -> list[tuple[int, str, int, int]]:
        """(page_id, file, offset, length) of the key's captures; they may go on in the next blocks."""
        out, i = [], bisect.bisect_left(self.lasts, key)
        while i < len(self.places) and self.firsts[i] <= key:
            keys, lines = self.block(i)
            for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                out.append((int(x[1]), x[2], int(x[3]), int(x[4])))
            i += 1
        return out


def lookup(urls: DataFrame, directory: DataFrame, index_path: str, warc_path: str) -> DataFrame:
    """(key, page_id, target, n_bytes, body_md5) of all captures of the keys of urls.url, read from the WARC files.

    The driver holds one key range a file of the index (as many as tasks sorted it); each file's directory is read only by the
    task that gets the lookups of its range, sorted by key.
    """
    files = sorted((r["a"], r["b"], r["file"]) for r in directory.groupBy("file").agg(F.min("first").alias("a"), F.max("last").alias("b")).collect())
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def keyed(batches):
        for b in batches:
            keys = sorted({url_key(u) for u in b["url"].to_pylist()})
            rows = [(k, files[i][2]) for k in keys for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["key", "file"])

    def read(batches):
        _, warcs = _open(warc_path)
        reader, name = None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for key, file in zip(b["key"][at : at + 256].to_pylist(), b["file"][at : at + 256].to_pylist()):
                    if file != name:
                        reader, name = Reader(index_path, file), file
                    for page, warc, offset, length in reader.lookup(key):
                        headers, body = read_record(reader.read(f"{warcs}/{warc}", offset, length))
                        rows.append((key, page, headers["WARC-Target-URI"], len(body), hashlib.md5(body).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()))], ["key", "page_id", "target", "n_bytes", "body_md5"])

    wanted = urls.select(F.col("url").cast("string").alias("url")).where("url is not null").mapInArrow(keyed, "key string, file string").distinct()
    return wanted.repartitionByRange("file", "key").sortWithinPartitions("file", "key").mapInArrow(read, "key string, page_id long, target string, n_bytes int, body_md5 string")


def build_and_look_up(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC files with an index, looks up the keys of all of pages' URLs and returns what lookup() reads.

    Rows without page_id or url aren't captured; a null html is an empty page; repeated rows are captured each, in the order of
    page_id under one key; an empty table gives no rows; other columns aren't looked at.
    """
    spark = pages.sparkSession
    warcs, index = new_path(spark, "warc"), new_path(spark, "cdx")
    directory = write_index(write_warc(pages, warcs), index)
    return lookup(pages.where("page_id is not null"), directory, index, warcs)
