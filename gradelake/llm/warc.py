"""WARC archives: monolithic gzip files normalised to a member a record, with sidecar offset indexes.

``write_archives`` writes pages as WARC/1.1 records into whole-file gzip streams, a file a task: a response record with the page as its
payload, or a revisit record where an equal payload is held by a page of a larger page_id. ``normalise`` inflates such a stream once,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets. ``read_archives`` reads records through the index.
Archives of others are read too: field names in any case, any record id and type, folded fields, other digests, empty lines between records.

Files lie in a folder of the shared checkpoint folder. Each is written under a name of its own and moved into place when complete, so
a task that runs again (a lost executor, speculation) replaces it by the same; inflating and rewriting hold one record at a time.

Rows: a null html is an empty payload; a null url writes no target. Of rows with an equal payload those of the largest page_id are
responses (repeated rows all), the others revisit it; a null page_id is smaller than every other and is read back as null, and a
payload held by null page_ids only is a response in each. An empty table writes no record. Other columns are ignored. Zero bytes behind a gzip
member are padding; a stream that ends inside a member or a record, or goes on with anything else, is an error, never a shorter result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import cut, filesystem, fresh_dir
from gradelake.llm.textcore import column

#: Compression levels of the whole-file streams and of the normalised members; bytes read at a time.
FAST, MEMBER, PIECE = 1, 3, 1 << 20
#: Repeated payloads (40 bytes each) whose table is broadcast; of more, those of most copies are, and the others are joined by shuffling.
SMALL = 100_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record whose HTTP head states the length of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line of a head, and its fields by lower-case name (of a repeated one the first); a line that starts with a blank goes on with the field before."""
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()
    fields: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return first, fields


def stated_digest(text: str) -> str | None:
    """A SHA-1 digest in upper-case base32, from base32 or base16; null for other digests."""
    name, _, value = text.partition(":")
    if name.strip().lower() != "sha1":
        return None
    return base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch("[0-9A-Fa-f]{40}", value) else value.upper()


def parse(raw: bytes) -> dict:
    """Ids, target, payload length and digest, type and reference of one record. Where a record does not state a digest, a response gets its payload's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, fields = fields_of(head)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    block, kind = rest[: int(fields["content-length"])], fields.get("warc-type", "").lower()
    http, payload, size = {}, block, len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http, size = fields_of(top)[1], len(payload)
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
    told = stated_digest(fields.get("warc-payload-digest", ""))
    page = lambda x: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", x)) else None
    own = fields.get("warc-record-id", "")
    if "<urn:page:" in own and kind == "response" and (http.get("content-length") != str(size) or digest(payload) != told):
        raise ValueError(f"the payload of page {page(own)} does not have its stated length and digest")
    if told is None and kind != "revisit":
        told = digest(payload)
    return {"page_id": page(own), "payload_bytes": size, "payload_digest": told, "record_type": kind, "refers_to": page(fields.get("warc-refers-to", "")), "record_id": own.strip("<>"), "target_uri": fields.get("warc-target-uri")}


class Output:
    """A file of the shared folder that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.source, path = filesystem(folder)
        self.source.create_dir(path, recursive=True)
        self.part, self.path, self.size = f"{path}/.{uuid.uuid4().hex}", f"{path}/{name}", 0
        self.stream = self.source.open_output_stream(self.part, compression=None)

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)

    def done(self) -> None:
        self.stream.close()
        self.source.move(self.part, self.path)


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in pieces of bounded size."""
    engine = None
    try:
        while piece := stream.read(PIECE):
            while piece:
                if engine is None:
                    piece = piece.lstrip(b"\0")
                    if not piece:
                        break
                    engine = zlib.decompressobj(31)
                yield engine.decompress(piece, PIECE)
                piece = engine.unused_data if engine.eof else engine.unconsumed_tail
                if engine.eof:
                    engine = None
        if engine is not None:
            yield engine.flush()
    except zlib.error as e:
        raise ValueError("the archive holds what is no gzip member") from e
    if engine is not None and not engine.eof:
        raise ValueError("the archive ends inside a gzip member")


LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*(\d+)", re.I)


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by their stated lengths."""
    held = bytearray()
    need, searched = None, 0
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                blank = len(held) - len(held.lstrip(b"\r\n"))
                if blank:
                    del held[:blank]
                    searched = 0
                head = held.find(b"\r\n\r\n", max(0, searched - 3))
                searched = len(held)
                if head < 0:
                    break
                length = LENGTH.search(held[:head])
                if length is None:
                    raise ValueError("a record does not state its length")
                need = head + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need, searched = None, 0
    if held.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> list[str]:
    """Names of the monolithic archives made of page_id, url and html. Payloads under min_bytes are never revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("key"))
    repeated = cut(pages.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if repeated.count() <= SMALL:
        rows = pages.join(F.broadcast(repeated), "key", "left").select("page_id", "url", "html", "largest")
    else:  # the payloads of most copies are broadcast, so that none of the others is a hot key of the shuffle
        hot = cut(repeated.orderBy(F.desc("n"), "key").limit(SMALL))
        rows = pages.join(F.broadcast(hot), "key").select("page_id", "url", "html", "largest")
        others = pages.join(F.broadcast(hot.select("key")), "key", "left_anti").join(repeated, "key", "left")
        rows = rows.union(others.select("page_id", "url", "html", "largest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        out, n = None, 0
        engine = zlib.compressobj(FAST, zlib.DEFLATED, 31)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for page_id, url, text, largest in zip(*(column(part, c).to_pylist() for c in ("page_id", "url", "html", "largest")), strict=True):
                    out = out or Output(folder, name)
                    refers = largest if len(text.encode()) >= min_bytes and largest is not None and largest != page_id else None
                    out.write(engine.compress(record(page_id, url, text.encode(), refers)))
                    n += 1
        if out:
            out.write(engine.flush())
            out.done()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    made = cut(rows.mapInArrow(run, "name string, n long"))
    return [x.name for x in made.orderBy("name").select("name").collect()]


def normalise(spark: SparkSession, source: str, names: list[str], folder: str) -> DataFrame:
    """name, n: rewrites each archive of ``source`` into ``folder``, a gzip member a record, with ``name.idx`` (a JSON line a record: offset, length)."""
    tasks = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in column(batch, "name").to_pylist():
                n, out, index = 0, Output(folder, name), Output(folder, f"{name}.idx")
                files, path = filesystem(source)
                with files.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for raw in records(inflate(f)):
                        engine = zlib.compressobj(MEMBER, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        index.write(json.dumps({"offset": out.size, "length": len(member)}).encode() + b"\n")
                        out.write(member)
                        n += 1
                out.done()
                index.done()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    return cut(tasks.mapInArrow(run, "name string, n long"))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row a record of the archives (column name), each read at its offset from the sidecar index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path = filesystem(folder)
        fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])
        for batch in batches:
            for name in column(batch, "name").to_pylist():
                rows: list[dict] = []
                with source.open_input_stream(f"{path}/{name}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with source.open_input_file(f"{path}/{name}") as f:
                    for entry in index:
                        f.seek(entry["offset"])
                        rows.append(parse(zlib.decompress(f.read(entry["length"]), 31)))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, fields)

    return archives.select("name").mapInArrow(run, READ)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages, normalises the archives, drops the monolithic files, and reads the records back."""
    spark = pages.sparkSession
    whole, folder = fresh_dir(spark, "warc-whole"), fresh_dir(spark, "warc")
    names = write_archives(pages, whole, min_bytes)
    if not names:
        return spark.createDataFrame([], READ)
    made = normalise(spark, whole, names, folder)
    files, path = filesystem(whole)
    files.delete_dir(path)
    return read_archives(made.repartition(len(names), "name"), folder)


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), 0).drop("record_id", "target_uri")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS largest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc FROM p),
e AS (SELECT *, [CAST('0x' || substr(hex, 1 + 5 * i, 5) AS INTEGER) FOR i IN range(8)] AS parts FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([abc[1 + (v >> 15)] || abc[1 + ((v >> 10) & 31)] || abc[1 + ((v >> 5) & 31)] || abc[1 + (v & 31)] FOR v IN parts], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM e
"""
