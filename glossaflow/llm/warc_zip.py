"""WARC records in ZIP-packaged archives: written with an index, read back by byte ranges.

An archive is a ZIP file with stored members: below ``archive/`` the data, where each record is a gzip
member of its own or plain, and below ``indexes/`` the indexes, a line for each record with its place.
The writer makes one of each.  The reader takes all of them, also packed indexes and lines with a sort
key and a time before their JSON.  It finds the end of the central directory (with its ZIP64 form) from the tail of the file,
parses the directory, finds where the stored members begin, reads the index, and then reads ranges
of records; nothing is extracted, and no file is read as a whole.

Each task writes its own files, named by partition and attempt; the names come back as rows, so
that files of failed attempts are never read.  A file has at most ``ROWS`` records, which bounds
the index.

Records of equal payload and at least ``LEAST`` bytes are stored once, at the smallest number; the
others are revisits of it.

Defined results: a null payload is empty; a null number or URL is left out of the record and null
again when read.  Rows that share the smallest number of a payload are all responses.  An empty
table gives no archives and no records.
"""

from __future__ import annotations

import gzip
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.common import cut
from glossaflow.session import shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST, ROWS = 100, 10_000
#: Records that one row of the plan for reading stands for, and bytes that one read may span.
TOGETHER, SPAN = 256, 4 << 20
#: Packed bytes that one task reads, about.
TASK_BYTES = 64 << 20
_STORED = 0


# -- writing


def record(row: dict) -> bytes:
    """One WARC record; ``row`` has page_id, url, payload, digest, size and refers_to."""
    revisit = row["refers_to"] is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if not revisit:
        body += b"Content-Length: %d\r\n" % row["size"]
    body += b"\r\n" + (b"" if revisit else row["payload"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"WARC-Payload-Length: {row['size']}",
    ]
    if row["page_id"] is not None:
        head.append(f"WARC-Record-ID: <urn:page:{row['page_id']}>")
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe=chr(37) + ':/?#[]@!$&()*+,;=~')}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archive(stream, rows: Iterator[dict]) -> int:
    """Write one archive to a stream; returns the number of records."""
    lines, place = [], 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as archive:
        with archive.open(DATA, "w", force_zip64=True) as data:
            for row in rows:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(row)) + packer.flush()
                data.write(member)
                lines.append(json.dumps({"id": row["page_id"], "offset": place, "length": len(member)}))
                place += len(member)
        archive.writestr(INDEX, "".join(f"{line}\n" for line in lines))
    return len(lines)


def _write(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, (files, base) = TaskContext.get(), pafs.FileSystem.from_uri(root)
    rows = (row for batch in batches for row in batch.to_pylist())
    files.create_dir(base, recursive=True)
    k, first = 0, next(rows, None)
    while first is not None:
        name = f"part-{task.partitionId():06d}-{task.attemptNumber()}-{task.taskAttemptId()}-{k:04d}.zip"

        def some(first=first):
            yield first
            for _ in range(ROWS - 1):
                row = next(rows, None)
                if row is None:
                    return
                yield row

        with files.open_output_stream(f"{base}/{name}") as out:
            count = write_archive(out, some())
        yield pa.RecordBatch.from_pydict({"archive": [f"{root}/{name}"], "records": [count]})
        k, first = k + 1, next(rows, None)


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write every row as a record; returns the archives: archive, records."""
    content = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(page_id).cast("string").alias("page_id"), F.col(page_id).alias("number"), F.col(url).alias("url"),
        content.alias("payload"), F.sha2(content, 256).alias("digest"), F.octet_length(content).alias("size"),
    )
    repeated = cut(
        rows.where(F.col("size") >= LEAST)
        .groupBy("digest")
        .agg(F.min("number").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "payloads",
    )
    refers = F.when(F.col("first") != F.col("number"), F.col("first"))
    refers = F.coalesce(refers, F.when(F.col("number").isNull(), F.col("first"))).cast("string")
    typed = rows.join(repeated, "digest", "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size",
        refers.alias("refers_to"),
    )
    root = shared_folder(pages.sparkSession, "archives")
    return cut(typed.mapInArrow(lambda b: _write(root, b), "archive string, records long"), "archive-names")


# -- reading


def members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Name: (method, where the local header is, stored bytes), from the central directory."""

    def at(place: int, length: int) -> bytes:
        file.seek(place)
        return file.read(length)

    start = max(0, size - (1 << 16) - 22)
    tail = at(start, size - start)
    place = tail.rfind(b"PK\5\6")
    while place >= 0 and place + 22 + struct.unpack_from("<H", tail, place + 20)[0] != len(tail):
        place = tail.rfind(b"PK\5\6", 0, place)
    if place < 0:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, place + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = at(start + place - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of the central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, found, k = at(offset, length), {}, 0
    for _ in range(count):
        if directory[k : k + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, k + 8)
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", directory, k + 20)
        (header,) = struct.unpack_from("<I", directory, k + 42)
        name = directory[k + 46 : k + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[k + 46 + names : k + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # only the fields that did not fit are there, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            e += 4 + n
        found[name] = (method, header, packed)
        k += 46 + names + extras + notes
    return found


def _place(file, name: str, member: tuple[int, int, int]) -> tuple[int, int]:
    method, header, length = member
    if method != _STORED:
        raise ValueError(f"{name} is compressed and cannot be read by ranges")
    file.seek(header)
    local = file.read(30)
    if local[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    names, extras = struct.unpack_from("<HH", local, 26)
    return header + 30 + names + extras, length


def stored(file, size: int, name: str) -> tuple[int, int]:
    """Where the bytes of a stored member begin, and how many there are."""
    return _place(file, name, members(file, size)[name])


def index_entries(lines: Iterator[bytes]) -> Iterator[tuple[str | None, int, int]]:
    """File name, offset and length of each record; what stands before a line's JSON is passed over."""
    for line in lines:
        at = line.find(b"{")
        if at < 0:  # a header or an empty line
            continue
        entry = json.loads(line[at:])
        if "offset" in entry and "length" in entry:
            yield entry.get("filename"), int(entry["offset"]), int(entry["length"])


def located(file, size: int) -> Iterator[tuple[int, int]]:
    """Place and length of each record of all data members, in the order of the indexes.

    A line without a file name, or with one that the archive has no member of, belongs to the only
    data member there is.
    """
    found = members(file, size)
    data = {n.rsplit("/", 1)[1]: _place(file, n, m) for n, m in found.items() if n.startswith("archive/") and n[-1] != "/"}
    for name, member in found.items():
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            continue
        place, length = _place(file, name, member)
        file.seek(place)
        lines = file.read(length)
        lines = gzip.decompress(lines) if name.endswith(".gz") else lines
        for member_name, offset, size_ in index_entries(lines.splitlines()):
            own = data.get((member_name or "").rsplit("/", 1)[-1])
            if own is None:
                if len(data) != 1:
                    raise ValueError(f"{name} has a record of {member_name}, which is not in the archive")
                (own,) = data.values()
            yield own[0] + offset, size_


def _open(uri: str):
    files, path = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch["archive"].to_pylist():
            with _open(uri) as file:
                places = list(located(file, file.size()))
            for k in range(0, len(places), TOGETHER):
                some = places[k : k + TOGETHER]
                yield pa.RecordBatch.from_pydict({
                    "archive": [uri], "block": [k // TOGETHER],
                    "offsets": [[p for p, _ in some]], "lengths": [[n for _, n in some]],
                })


def parse(member: bytes) -> dict:
    """A record from its bytes: its number or else its name, and the payload of a response."""
    plain = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    body = rest[: int(fields["Content-Length"])]
    number = lambda name: fields[name].strip("<>").removeprefix("urn:page:") if name in fields else None
    response = fields["WARC-Type"] == "response"
    payload = body.partition(b"\r\n\r\n")[2] if response else None
    digest = fields.get("WARC-Payload-Digest")
    declared = fields.get("WARC-Payload-Length", None if payload is None else len(payload))
    return {
        "page_id": number("WARC-Record-ID"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "url": fields.get("WARC-Target-URI"),
        "declared_digest": None if digest is None else digest.removeprefix("sha256:"),
        "declared_bytes": None if declared is None else int(declared),
        "payload": payload,
    }


_RECORD = pa.schema([
    ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
    ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload", pa.binary()),
])
_RECORD_SQL = (
    "page_id string, record_type string, refers_to string, url string, declared_digest string, "
    "declared_bytes long, payload binary"
)


def ranges(file, offsets: list[int], lengths: list[int], span: int = SPAN) -> Iterator[bytes]:
    """The bytes of the ranges, in order; neighbours come from one read of at most ``span`` bytes."""
    k = 0
    while k < len(offsets):
        last = k
        while last + 1 < len(offsets) and offsets[last + 1] == offsets[last] + lengths[last] and (
            offsets[last + 1] + lengths[last + 1] - offsets[k] <= span
        ):
            last += 1
        file.seek(offsets[k])
        got = file.read(offsets[last] + lengths[last] - offsets[k])
        for i in range(k, last + 1):
            yield got[offsets[i] - offsets[k] : offsets[i] - offsets[k] + lengths[i]]
        k = last + 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            rows, held = [], 0
            with _open(block["archive"]) as file:
                for member in ranges(file, block["offsets"], block["lengths"]):
                    rows.append(parse(member))
                    held += len(rows[-1]["payload"] or b"")
                    if held > SPAN:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read(archives: DataFrame) -> DataFrame:
    """All records of the archives, read through their indexes.

    The rows to read by are small but stand for many bytes, so the bytes decide about the tasks.
    """
    places = cut(
        archives.select("archive").mapInArrow(
            _locate, "archive string, block long, offsets array<long>, lengths array<long>"
        ),
        "places",
    )
    held = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n)
    total = places.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return places.repartition(tasks, "archive", "block").mapInArrow(_read, _RECORD_SQL)
