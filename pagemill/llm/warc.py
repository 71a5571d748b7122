"""WARC: archives of one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, shared_dir, slices, stored

#: Smaller payloads are always stored in full.
LEAST_REVISIT = 1000
#: A task starts a new archive after about this many compressed bytes.
ARCHIVE_BYTES = 512 << 20
_READ = 64 << 10
#: Bytes that the head of a record, or of its HTTP block, may have.
MOST_HEAD = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member: a response record, or a revisit record without the payload."""
    digest = _sha1(payload)
    block = _HTTP + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": _DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Headers(dict):
    """A record's named fields, found whatever the case of their names."""

    def __init__(self, lines: list[str]):
        super().__init__()
        name = None
        for line in lines:
            if line[:1] in (" ", "\t") and name:  # a field that goes on
                super().__setitem__(name, f"{self[name]} {line.strip()}")
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            super().__setitem__(name, value.strip())

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


class _Digest:
    """Verifies a labelled digest ("sha1:...", in base 32 or hex); algorithms that aren't known are not verified."""

    def __init__(self, label: str | None):
        name, _, self.value = (label or "").partition(":")
        self.hash = hashlib.new(name.lower()) if name.lower() in ("md5", "sha1", "sha256", "sha512") and self.value else None

    def update(self, part: bytes) -> None:
        if self.hash:
            self.hash.update(part)

    def holds(self) -> bool:
        if not self.hash or self.value.lower() == self.hash.hexdigest():
            return True
        return self.value.upper().rstrip("=") == base64.b32encode(self.hash.digest()).decode().rstrip("=")


def read_records(stream, keep_payload: bool = False):
    """(headers, payload length, payload SHA-1 in hex, payload or None) of each record, of any type, of a stream of gzip members.

    Members are inflated bit by bit and framed by Content-Length; block and
    payload digests are verified where a record has them, a torn or altered
    archive raises ValueError. The payload of an HTTP block is what follows its
    head, else the block is. Memory is bounded by the read size and MOST_HEAD
    unless payloads are kept.
    """
    rest = b""
    while True:
        rest = rest or stream.read(_READ)
        if not rest:
            return
        z, held = zlib.decompressobj(31), b""

        def more(z=z) -> bytes:
            nonlocal rest
            while not z.eof:
                rest = z.unconsumed_tail or rest or stream.read(_READ)
                if not rest:
                    raise ValueError("the archive ends inside a record")
                try:
                    out, rest = z.decompress(rest, _READ), b""
                except zlib.error as e:
                    raise ValueError(f"not a gzip member: {e}") from None
                if z.eof:
                    rest = z.unused_data
                if out:
                    return out
            return b""

        while b"\r\n\r\n" not in held:
            held += (part := more())
            if not part or len(held) > MOST_HEAD:
                raise ValueError("a record without headers")
        head, _, held = held.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        headers = Headers(lines)
        kind, left = headers.get("WARC-Type", ""), int(headers.get("Content-Length", "-1"))
        if left < 0:
            raise ValueError("a record without a Content-Length")
        block, payload = _Digest(headers.get("WARC-Block-Digest")), _Digest(None if kind == "revisit" else headers.get("WARC-Payload-Digest"))
        sha1, size, kept, http = hashlib.sha1(), 0, [], b""
        body = not headers.get("Content-Type", "").lower().startswith("application/http")
        while left:
            held = held or more()
            if not held:
                raise ValueError("a block shorter than its Content-Length")
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if not body:
                http += part
                if b"\r\n\r\n" not in http:
                    if len(http) > MOST_HEAD:
                        raise ValueError("an HTTP head that doesn't end")
                    continue
                body, part = True, http.partition(b"\r\n\r\n")[2]
            payload.update(part)
            sha1.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        while part := more():
            held += part
        if held != b"\r\n\r\n":
            raise ValueError("a record that doesn't end with two line breaks")
        if not block.holds():
            raise ValueError("a block digest that doesn't match")
        if not payload.holds():
            raise ValueError("a payload digest that doesn't match")
        yield headers, size, sha1.hexdigest(), b"".join(kept) if keep_payload else None


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives in ``folder``; returns (path, records).

    Of equal payloads of ``least`` bytes or more, that with the largest page_id
    is stored, the others refer to it. Each attempt of a task writes files of its
    own; only the files of the attempts that succeeded are listed, so a lost
    executor leaves at most unlisted files. A null html is an empty payload, a
    null page_id counts as the smallest, rows that share the largest page_id are
    all stored, an empty table gives no archive.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    equal = p.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("stored_id"), F.count("*").alias("n"))
    # only payloads that occur again are looked up; the list is written first, so its size decides how it is joined
    equal = stored(equal.where("n > 1 and stored_id is not null").select("digest", "stored_id"), "equal")
    p = p.join(equal, "digest", "left")
    p = p.select("html", "page_id", "url", F.when(F.coalesce(F.col("page_id") != F.col("stored_id"), F.col("stored_id").isNotNull()), F.col("stored_id")).alias("refers_to"))

    def run(batches):
        import pyspark

        schema = arrow_schema("path string, records long")
        task = pyspark.TaskContext.get()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, count, held, file = [], None, 0, 0, 0
        sink = None
        for texts, ids, urls, refers in slices(batches, "html", "page_id", "url", "refers_to"):
            for text, page_id, url, refer in zip(texts, ids, urls, refers, strict=True):
                if sink is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{file:03d}.warc.gz"
                    sink, count, held, file = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, file + 1
                member = record(page_id, url, text, refer)
                sink.write(member)
                count, held = count + 1, held + len(member)
                if held >= ARCHIVE_BYTES:
                    sink.close()
                    out.append((f"{folder}/{name}", count))
                    sink = None
        if sink is not None:
            sink.close()
            out.append((f"{folder}/{name}", count))
        yield batch(schema, [o[0] for o in out], [o[1] for o in out])

    return stored(p.mapInArrow(run, "path string, records long"), "manifest")


def _revisited(head: Headers, own: str) -> str:
    """The SHA-1 in hex that a revisit record gives of the payload it refers to; that of its own block if it gives none."""
    name, _, value = head.get("WARC-Payload-Digest", "").partition(":")
    if name.lower() != "sha1":
        return own
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the listed archives: page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, payload.

    Records of any type count; page_id and refers_to are null for those of
    other writers. ``records``, where it isn't null, is how many an archive has.
    payload_bytes and payload_digest are those of the full payload, for revisits
    as their headers say; payload is null unless asked for.
    """
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        schema = arrow_schema(ddl)
        number = lambda x: int(x) if x else None
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = _open(path)
                out, seen, held = [], 0, 0
                with store.open_input_stream(name, compression=None) as stream:
                    for head, size, sha1, payload in read_records(stream, payloads):
                        seen += 1
                        if head.get("WARC-Type") == "revisit":
                            sha1, size = _revisited(head, sha1), int(head.get("X-Payload-Length", size))
                        out.append((number(head.get("X-Page-ID")), head.get("WARC-Target-URI"), size, sha1, head.get("WARC-Type"), number(head.get("X-Refers-To-Page-ID")), payload))
                        held += len(payload or b"") + 200
                        if held > 4 << 20:
                            yield batch(schema, *zip(*out, strict=True))
                            out, held = [], 0
                if records is not None and seen != records:
                    raise ValueError(f"{path}: {seen} records, {records} written")
                if out:
                    yield batch(schema, *zip(*out, strict=True))

    n = max(1, archives.count())
    return archives.select("path", "records").repartition(n).mapInArrow(run, ddl)


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without payloads."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
