"""WARC archives of Zstandard frames: writer and reader.

An archive is one skippable frame that holds the compression dictionary, then one
Zstandard frame per record.  Tasks write archives to a shared folder (any store that
``pyarrow.fs`` opens) under names of their own, so a repeated task leaves an orphan that no
manifest names; the manifest (path, records) is written as a table before reading starts.
The reader loads the dictionary from the leading frame, decodes one frame per record and
checks versions, required headers, block and payload lengths and both digests.

Of records with equal payloads (grouped by SHA-256 and length) of at least
``min_payload_bytes`` the one with the largest id is the response; the others are revisit
records, which keep the HTTP headers, name the response and hold no payload.

Defined results: null html is an empty payload; a null id or url is written as such and read
back as null; rows that repeat the largest id are all responses; empty table -> empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch

MAGIC = 0x184D2A5D  # skippable frame that carries the dictionary
DICT_BYTES = 16 << 10
SAMPLES = 256  # records a dictionary is trained on
ARCHIVE_BYTES = 64 << 20  # uncompressed; a larger archive is closed
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "null"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    return "".join(c if 0x20 < ord(c) < 0x7F and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One response (refers_to None) or revisit record."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{NO_ID if page_id is None else page_id}>"),
        ("WARC-Date", date),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + block + CRLF + CRLF


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; a plain record skeleton where they are too few to train on."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return record(0, "http://", b"", None)


class Writer:
    """Writes one archive to an open binary stream."""

    def __init__(self, out, samples: list[bytes]):
        data = dictionary(samples)
        self.out, self.records, self.size = out, 0, 0
        out.write(struct.pack("<II", MAGIC, len(data)) + data)
        shared = zstd.ZstdCompressionDict(data)
        shared.precompute_compress(level=3)
        self.compress = zstd.ZstdCompressor(dict_data=shared, write_content_size=True, write_checksum=True).compress

    def add(self, raw: bytes) -> None:
        self.out.write(self.compress(raw))
        self.records += 1
        self.size += len(raw)


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; at most a chunk and a record in memory."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != MAGIC:
        raise WarcError("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise WarcError("cut dictionary frame")
    if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        data = zstd.ZstdDecompressor().decompressobj().decompress(data)
    context = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data))
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        one, parts = context.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(rest))
            except zstd.ZstdError as e:
                raise WarcError(f"damaged frame: {e}") from e
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise WarcError("cut frame")
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Headers, block and payload of one record, all lengths and digests checked."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("record headers do not end")
    lines = raw[:end].split(CRLF)
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"version {lines[0][:20]!r}")
    h = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"header line {line[:40]!r}")
        h[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"no {name}")
    if not h["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    size, at = int(h["content-length"]), end + 4
    block = raw[at : at + size]
    if len(raw) != at + size + 4 or raw[at + size :] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the frame")
    if h.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise WarcError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [line.split(b":")[1].strip() for line in http.split(CRLF) if line.lower().startswith(b"content-length:")]
    if len(lengths) != 1 or not lengths[0].isdigit():
        raise WarcError("HTTP Content-Length")
    h["payload_bytes"], h["payload"] = int(lengths[0]), payload
    sha = h.get("warc-payload-digest", "")
    if h["warc-type"] == "response":
        if len(payload) != h["payload_bytes"]:
            raise WarcError("payload length")
        if sha != "sha1:" + digest(payload):
            raise WarcError("payload digest")
    elif h["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in h:
            raise WarcError("revisit record with a payload or without its target")
    else:
        raise WarcError(f"record type {h['warc-type']}")
    return h


def _open_fs(folder: str):
    fs, path = pa.fs.FileSystem.from_uri(folder)
    return fs, path


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == NO_ID else int(name)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload_bytes: int = 0) -> DataFrame:
    """Write one record per row; returns the manifest (path, records), itself a written table."""
    scratch.ready(pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html")})
    heads = rows.filter(F.col("size") >= min_payload_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    marked = rows.join(heads, ["sha", "size"], "left").select("page_id", "url", "html", F.expr("CASE WHEN NOT page_id <=> head THEN head END").alias("refers_to"))

    def run(batches):
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        state: dict = {}
        waiting: list[bytes] = []

        def begin():
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            state["out"] = fs.open_output_stream(name)
            state["path"], state["writer"] = name, Writer(state["out"], waiting)
            for raw in waiting:
                state["writer"].add(raw)
            waiting.clear()

        def close():
            state["out"].close()
            done = pa.record_batch([pa.array([state["path"]]), pa.array([state["writer"].records], pa.int64())], names=["path", "records"])
            state.clear()
            return done

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    raw = record(page_id, url, html.encode("utf-8"), refers_to)
                    if state:
                        state["writer"].add(raw)
                        if state["writer"].size >= ARCHIVE_BYTES:
                            yield close()
                    else:
                        waiting.append(raw)
                        if len(waiting) >= SAMPLES:
                            begin()
        if waiting:
            begin()
        if state:
            yield close()

    return scratch.written(marked.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read every archive that the manifest names, one row per record (with its payload on request)."""
    scratch.ready(manifest)

    def run(batches):
        fs, _ = _open_fs(folder)
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                found, seen = [], 0
                with fs.open_input_stream(path) as stream:
                    for raw in frames(stream):
                        h = parse(raw)
                        seen += 1
                        refers = h.get("warc-refers-to")
                        found.append((_page(h["warc-record-id"]), h["payload_bytes"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page(refers) if refers else None, h["payload"] if payloads else None))
                        if len(found) >= (64 if payloads else 4096):
                            yield _rows(found)
                            found = []
                if seen != records:
                    raise WarcError(f"{path}: {seen} records, the manifest says {records}")
                if found:
                    yield _rows(found)

    return manifest.repartition(scratch.partitions(manifest.sparkSession), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


@functools.lru_cache(maxsize=1)
def _schema() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), _schema().types)], schema=_schema())


