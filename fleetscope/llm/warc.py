"""Zstandard WARC archives: a dictionary in front, one frame per record.

An archive begins with a skippable frame that holds the dictionary all its records
were packed with; each record is a frame of its own, so a reader can start at any
offset. Equal payloads are stored once: later records revisit the first.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored
from .storage import PartFile, create_folder, new_stem, open_part

#: Magic numbers of the Zstandard format: the skippable frame used for dictionaries, a frame, a dictionary.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: An archive is closed once it has so many bytes.
PART_BYTES = 32 << 20
#: A dictionary is trained on the first records of its archive: so many bytes of them at most, to so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: Payloads below this size are always stored.
REVISIT_BYTES = 100
_NAMESPACE = uuid.UUID("6f0b1c52-7a6d-5b3e-9c1f-2d4a8e90c7b1")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: named fields, a blank line, the block, two blank lines."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block; a wrong version, header, length or end is an error."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"damaged header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    n = int(fields["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return fields, rest[:n]


def _train(samples: list[bytes]):
    """A dictionary, or None where there is too little to learn from."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples)
    except zstandard.ZstdError:
        return None


class Archive:
    """An archive being written; the dictionary is fixed when the first records are known."""

    def __init__(self, folder: str):
        self.part, self.waiting, self.bytes_waiting, self.packer, self.records = PartFile(folder, new_stem() + ".warc.zst"), [], 0, None, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer is None:
            self.waiting.append(data)
            self.bytes_waiting += len(data)
            if self.bytes_waiting >= SAMPLE_BYTES:
                self._begin()
        else:
            self.part.write(self.packer.compress(data))

    def _begin(self) -> None:
        import zstandard

        trained = _train([w for w in self.waiting if len(w) <= SAMPLE_BYTES // 8])
        content = b"" if trained is None else trained.as_bytes()
        stored_dictionary = zstandard.ZstdCompressor().compress(content)
        self.part.write(struct.pack("<II", DICTIONARY_FRAME, len(stored_dictionary)) + stored_dictionary)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        for data in self.waiting:
            self.part.write(self.packer.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.packer is None:
            self._begin()
        self.part.close()


def read_archive(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, frame by frame; memory holds one record.

    The dictionary frame may be plain or packed itself. Other skippable frames are passed over.
    """
    import zstandard

    dictionary, first, buffer = None, True, b""

    def more(n: int) -> bytes:
        nonlocal buffer
        while len(buffer) < n and (got := stream.read(max(1 << 20, n - len(buffer)))):
            buffer += got
        return buffer

    while more(8):
        if len(buffer) < 8:
            raise ValueError("archive is cut off")
        magic, n = struct.unpack_from("<II", buffer)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if len(more(8 + n)) < 8 + n:
                raise ValueError("archive is cut off")
            content, buffer = buffer[8 : 8 + n], buffer[8 + n :]
            if first and magic == DICTIONARY_FRAME:
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content) if content else None
            first = False
            continue
        if magic != FRAME:
            raise ValueError("no Zstandard frame")
        first, unpacker, out = False, zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while not unpacker.eof:
            if not more(1):
                raise ValueError("frame is cut off")
            out.append(unpacker.decompress(buffer))
            buffer = unpacker.unused_data
        yield parse_record(b"".join(out))


PARTS = "folder string, part string, records bigint"


def revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, digest, refers_to``: rows whose payload equals that of a smaller page_id.

    Works on digests alone; a payload that is everywhere is one row per task before
    the exchange, and the join has one row per digest on one side.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.filter((F.octet_length(payload) >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha2(payload, 256).alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(firsts, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = REVISIT_BYTES, part_bytes: int = PART_BYTES, date: str | None = None) -> DataFrame:
    """Writes a record per row of ``page_id, url, html``; returns the stored list of archives.

    Null html is an empty payload, null urls are empty, extra columns are dropped. Equal
    rows that share a page_id are all written, all as responses or all as revisits
    of another page. A null page_id is never linked.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    create_folder(folder)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select("page_id", "url", "html")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = keyed.join(revisits(pages, least_bytes), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"] or b""
                archive = archive or Archive(folder)
                archive.add(record(row["page_id"], row["url"], payload, hashlib.sha256(payload).hexdigest(), row["refers_to"], date))
                if archive.part.size >= part_bytes:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_pydict(
            {"folder": [folder] * len(done), "part": [a.part.name for a in done], "records": [a.records for a in done]},
            schema=pa.schema([("folder", pa.string()), ("part", pa.string()), ("records", pa.int64())]),
        )

    return stored(rows.mapInArrow(run, PARTS), "archives")


def read_warc(parts: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload`` of all records.

    Validates frames, headers and lengths, the number of records of each archive, and
    the digest and length of every stored payload. ``payload`` is null for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, size, n = [], 0, 0
                with open_part(row["folder"], row["part"]) as stream:
                    for fields, block in read_archive(stream):
                        head, sep, payload = block.partition(b"\r\n\r\n")
                        digest, length = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                        revisit = fields["warc-type"] == "revisit"
                        if not sep or not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError("payload differs from its header")
                        page, refers = fields["x-page-id"], fields.get("x-refers-to-page-id")
                        found.append((int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"], int(refers) if refers else None, digest, length, None if revisit else payload))
                        size, n = size + len(block), n + 1
                        if size > 8 << 20:
                            yield _rows(found)
                            found, size = [], 0
                if n != row["records"]:
                    raise ValueError(f"archive {row['part']} is incomplete")
                yield _rows(found)

    spread = parts.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism * 2), "part")
    return spread.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])
