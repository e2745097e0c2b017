"""Reading of WARC files, plain or gzipped with any number of members, and the fixity audit of two folders of them.

A task reads a file at a time and gives a row per record: its place in the file as stored (``offset``, ``length``: those of the
gzip member, where a member holds one record), the record's bytes, and the fields of its header. Of a member with several records each
one has the place of the member.

Damage does not end a file. Where a member cannot be inflated or a record has no end that fits its Content-Length, the bytes up to the next
start of a record are one row with ``intact`` false and null fields, and reading goes on there, so every byte of a file belongs to a row.
``digest_ok`` tells whether the block, or the payload behind an HTTP header, fits the digest that the record names (SHA-1 or
SHA-256, base 32 or hex); null if it names none.

``audit_files`` builds the Merkle trees of ``warc`` over two folders and descends only where they differ. Files are matched by their
path below the folder; a file that one side lacks counts as lost or added records.

Cases: an empty file has no records; a file over the size that Spark's binary source reads (2 GB, ``spark.sql.sources.binaryFile.maxLength``)
is an error of Spark and never left out; a record without block has an empty one; header names are matched in any case, and folded header lines are joined;
repeated records are separate rows. A task holds one stored file and one of its records, so volumes should be cut to a fraction
of an executor's memory, as archives are (about 1 GB).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import warc
from grainmill.llm.shared import materialize

SCHEMA = "name string, volume long, seq long, offset long, length long, record binary, intact boolean, type string, record_id string, date string, uri string, content_type string, payload binary, digest_ok boolean"
KINDS = [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.bool_(), *[pa.string()] * 5, pa.binary(), pa.bool_()]
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/\d\.\d\r?\n")
CLOSE = re.compile(rb"(?:\r?\n){2}|\r?\n\Z")
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def record_end(data: bytes, at: int) -> tuple[int, int] | None:
    """Where the block of the record at ``at`` begins and where the record ends, line ends behind it included; None if it is damaged."""
    if not START.match(data, at):
        return None
    ends = [(data.find(mark, at), len(mark)) for mark in (b"\r\n\r\n", b"\n\n")]
    head, size = min((e for e in ends if e[0] >= 0), default=(-1, 0))
    length = LENGTH.search(data, at, head + 1) if head >= 0 else None
    if length is None:
        return None
    block = head + size
    end = block + int(length[1])
    if end > len(data):
        return None
    if closed := CLOSE.match(data, end):
        return block, closed.end()
    return (block, end) if end == len(data) or START.match(data, end) else None


def records_of(data: bytes) -> Iterator[tuple[int, int, int | None]]:
    """Start, end and block start of every record of plain bytes; a damaged stretch has no block start."""
    at = 0
    while at < len(data):
        found = record_end(data, at)
        if found:
            yield at, found[1], found[0]
            at = found[1]
        else:
            after = START.search(data, at + 1)
            while after and record_end(data, after.start()) is None:
                after = START.search(data, after.start() + 1)
            end = after.start() if after else len(data)
            yield at, end, None
            at = end


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and where it ends; None if it is damaged or cut off."""
    z = zlib.decompressobj(31)
    parts, fed = [], at
    try:
        while not z.eof and fed < len(data):
            parts.append(z.decompress(data[fed : fed + (1 << 20)]))
            fed += 1 << 20
    except zlib.error:
        return None
    return (b"".join(parts), min(fed, len(data)) - len(z.unused_data)) if z.eof else None


def stored(data: bytes) -> Iterator[tuple[int, int, bytes, int | None]]:
    """Offset and length as stored, bytes and block start of every record of a file, gzipped or plain."""
    if not data.startswith(MAGIC):
        yield from ((a, b - a, data[a:b], None if block is None else block - a) for a, b, block in records_of(data))
        return
    at = 0
    while at < len(data):
        found = inflate(data, at)
        if found:
            body, end = found
            for a, b, block in records_of(body):
                yield at, end - at, body[a:b], None if block is None else block - a
        else:
            end = data.find(MAGIC, at + 1)
            while end >= 0 and inflate(data, end) is None:
                end = data.find(MAGIC, end + 1)
            end = len(data) if end < 0 else end
            yield at, end - at, data[at:end], None
        at = end


def header_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the last of a repeated one; a line that begins with a blank goes on with the one before it."""
    text = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace"))
    pairs = (line.split(":", 1) for line in text.splitlines()[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def fits(digest: str | None, data: bytes) -> bool | None:
    """Whether bytes have a digest written as ``sha1:`` or ``sha256:`` and base 32 or hex; None for other kinds and none."""
    kind, _, value = (digest or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256"):
        return None
    own = hashlib.new(kind, data).digest()
    return value.strip().lower() in (own.hex(), base64.b32encode(own).decode().lower(), base64.b32encode(own).decode().lower().rstrip("="))


def fields_of(record: bytes, block: int | None) -> tuple:
    """Type, id, date, target, content type, payload and fit of the digests of a record."""
    if block is None:
        return (None,) * 7
    h = header_fields(record[:block])
    body = record[block : block + int(h["content-length"])]
    kind = h.get("content-type")
    payload = body
    if kind and kind.lower().startswith("application/http"):
        cut = re.search(rb"\r?\n\r?\n", body)
        payload = body[cut.end() :] if cut else b""
    checks = [fits(h.get("warc-block-digest"), body), fits(h.get("warc-payload-digest"), payload)]
    named = [c for c in checks if c is not None]
    return h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), kind, payload, all(named) if named else None


def _scan(spark: SparkSession, root: str, pattern: str) -> tuple[DataFrame, str, list[str]]:
    """The files below a folder, the path of the folder as Spark writes it, and their paths below it in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    return files.select("path", "content"), top, sorted(below(unquote(p), top) for p in files.inputFiles())


def below(path: str, top: str) -> str:
    """The part of a file's address that follows its folder."""
    return path[path.index(top) + len(top) :]


def read_files(spark: SparkSession, root: str, pattern: str = "*.warc*", names: list[str] | None = None) -> DataFrame:
    """All records of the WARC files below a folder. ``volume`` is the place of a file's name in ``names``, by default all names in order."""
    files, top, own = _scan(spark, root, pattern)
    number = {name: i for i, name in enumerate(own if names is None else names)}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = below(batch.column(0)[i].as_py(), top)
                rows, size = [], 0
                for seq, (offset, length, record, block) in enumerate(stored(batch.column(1)[i].as_buffer().to_pybytes())):
                    rows.append((name, number[name], seq, offset, length, record, block is not None, *fields_of(record, block)))
                    size += len(record)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), KINDS, strict=True)], COLUMNS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), KINDS, strict=True)], COLUMNS)

    return files.mapInArrow(run, SCHEMA)


COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def leaves(records: DataFrame) -> DataFrame:
    """The leaves of a folder's tree: record hashes with the places where the records are stored."""
    return materialize(records.select("volume", "seq", "offset", "length", F.sha2("record", 256).alias("sha256")), "warc_leaves")


def audit_files(spark: SparkSession, first: str, second: str, pattern: str = "*.warc*", fanout: int = 16) -> tuple[DataFrame, dict]:
    """name, seq, state (changed, lost, added), offset and length of every record that two folders do not share, and the report of ``warc.audit``.

    ``offset`` and ``length`` are those in the first folder, for added records those in the second. A record whose place or
    number has moved counts as changed.
    """
    names = sorted({n for root in (first, second) for n in _scan(spark, root, pattern)[2]})
    a, b = (leaves(read_files(spark, root, pattern, names)) for root in (first, second))
    found, report = warc.audit(a, b, fanout)
    place = lambda leaf, side: leaf.select("volume", F.col("seq").alias("node"), F.col("offset").alias(f"{side}_offset"), F.col("length").alias(f"{side}_length"))
    both = found.join(place(a, "a"), ["volume", "node"], "left").join(place(b, "b"), ["volume", "node"], "left")
    listed = spark.createDataFrame(list(enumerate(names)), "volume long, name string")
    out = both.join(listed, "volume").select("name", F.col("node").alias("seq"), "state", F.coalesce("a_offset", "b_offset").alias("offset"), F.coalesce("a_length", "b_length").alias("length"))
    return out, report
