"""Legacy archives to WARC (operator 1).

ARC files are read record by record: the version block names the fields of the header
lines (five in version 1, ten in version 2), the last of which is the declared length of
what follows. Each record becomes a WARC record with a synthesised identifier (a name-based
UUID), the date in WARC's form, a type and SHA-1 digests. Of records with equal payloads of
at least `least_bytes`, the one with the largest page id is a response and the others
revisit it.

Payloads never go through a shuffle: a first pass gives an index (digest, archive, number),
the decisions are made on that, and a second pass writes, for each archive, one WARC file.
Files are written under a temporary name and then moved, with names that only depend on
the input, so a task that runs again replaces its own output. pyarrow's file systems open
the shared folder, local or remote; records are streamed, one in memory at a time.

Defined cases: a null html is an empty payload; a null url gets an address made of the page
id; white space in an address is escaped; a null page_id counts as smallest and comes back
null; of repeated rows one is the response; an empty table gives archives without records;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialize, new_folder

CRAWL_DATE = "20080430204825"
LEAST_BYTES = 1000
ROLL_BYTES = 64 << 20  # uncompressed
#: The field lists of the two versions of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member of its own
    return z.compress(data) + z.flush()


class _Out:
    """A file that gets its name when it is whole."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = _fs(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream, self.size, self.records = self.fs.open_output_stream(self.temp), 0, 0

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        self.stream.write(_gz(data))

    def close(self) -> None:
        self.stream.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:  # some file systems don't replace what a lost task left; a repeated task writes the same
            self.fs.delete_file(self.path)
            self.fs.move(self.temp, self.path)


def _manifest(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": pa.array([r[0] for r in rows], pa.string()), "records": pa.array([r[1] for r in rows], pa.int64())})


def arc_version_block(name: str, version: int, date: str = CRAWL_DATE) -> bytes:
    body = f"{version} 0 talkledger\n{ARC_FIELDS[version]}\n".encode()
    tail = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, name: str, offset: int, date: str = CRAWL_DATE) -> bytes:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{known}\r\n".encode() + payload
    address = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{x:02X}" for x in c.encode()) for c in (url or f"http://page.invalid/{page_id}"))
    more = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} "
    return f"{address} 0.0.0.0 {date} text/html {more}{len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html) as ARC files, of either version in turn. archive, records of each file."""
    bound_batches(pages.sparkSession)
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, done = TaskContext.get().partitionId(), 0, None, []
        version = 1 + part % 2
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):  # noqa: B905
                if out is None:
                    name = f"part-{part:06d}-{number:04d}.arc.gz"
                    out = _Out(f"{folder}/{name}")
                    out.add(arc_version_block(name, version))
                out.add(arc_record(version, page_id, url, html, name, out.size))
                if out.size > ROLL_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", out.records - 1))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", out.records - 1))
        yield _manifest(done)

    return materialize(raw.mapInArrow(run, "archive string, records long"), "arc-manifest")


def _lines(stream: gzip.GzipFile) -> Iterator[bytes]:
    """Header lines; empty lines between records are skipped."""
    while line := stream.readline():
        if line.strip():
            yield line


def read_arc(path: str) -> Iterator[dict]:
    """The records of one ARC file, in order: number, and the fields of the version's header line in lower case, and block."""
    fs, at = _fs(path)
    with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
        fields: list[str] = []
        for number, line in enumerate(_lines(stream)):
            values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
            length = int(values[-1])
            block = stream.read(length)
            if len(block) != length:
                raise ValueError(f"{path}: record {number} is cut off")
            if not fields:
                fields = block.decode("utf-8", "replace").splitlines()[1].lower().split()
                continue
            if len(values) != len(fields):
                raise ValueError(f"{path}: record {number} has {len(values)} fields, not {len(fields)}")
            yield {"number": number, "block": block, **dict(zip(fields, values))}  # noqa: B905


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head, payload and header fields of an HTTP message; a block of another kind is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return head + b"\r\n\r\n", payload, {k.lower(): v for k, v in fields.items()}


def synthesise(record: dict, archive: str) -> dict:
    """What a WARC record needs that an ARC record lacks."""
    head, payload, fields = split_http(record["block"])
    d = record["archive-date"].ljust(14, "0")
    name = f"{record['url']}|{d}|{archive.rpartition('/')[2]}|{record['number']}"
    page = fields.get("x-page-id")
    return {
        "id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "type": "response" if head else "resource", "head": head, "payload": payload, "digest": hashlib.sha1(payload).hexdigest(),
        "page_id": int(page) if page is not None else None, "url": record["url"], "ip": record["ip-address"], "number": record["number"],
    }


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def index_arc(archives: DataFrame) -> DataFrame:
    """archive, number, record_id, url, date, page_id, digest, bytes of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "number", "record_id", "url", "date", "page_id", "digest", "bytes"]
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = [(archive, r["number"], s["id"], s["url"], s["date"], s["page_id"], s["digest"], len(s["payload"])) for r in read_arc(archive) for s in [synthesise(r, archive)]]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)  # noqa: B905

    return archives.select("archive").mapInArrow(run, "archive string, number long, record_id string, url string, date string, page_id long, digest string, bytes long")


def convert(archives: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """ARC files (archive) to one WARC file each in folder. archive, records of each file."""
    spark = archives.sparkSession
    n = max(1, archives.count())
    index = materialize(index_arc(archives.repartition(n)), "arc-index")
    # One row for each payload that occurs again; the first aggregate is made on each task's side.
    keep = index.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("page_id", "archive", "number", "record_id", "url", "date")).alias("keep"))
    keep = materialize(keep.filter("c > 1").drop("c"), "arc-keep")
    again = index.join(keep, "digest").filter((F.col("archive") != F.col("keep.archive")) | (F.col("number") != F.col("keep.number")))
    again = again.groupBy("archive").agg(F.collect_list(F.struct("number", "keep.record_id", "keep.url", "keep.date", "keep.page_id")).alias("revisits"))  # within one archive
    work = archives.select("archive").join(again, "archive", "left").repartition(n, "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, revisits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):  # noqa: B905
                of = {r["number"]: r for r in revisits or []}
                name = archive.rpartition("/")[2].replace(".arc", ".warc")
                out = _Out(f"{folder}/{name}")
                date = f"{CRAWL_DATE[:4]}-{CRAWL_DATE[4:6]}-{CRAWL_DATE[6:8]}T00:00:00Z"
                about = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
                out.add(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": about, "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: talkledger\r\nformat: WARC File Format 1.1\r\n"))
                for r in read_arc(archive):
                    s = synthesise(r, archive)
                    fields = {"WARC-Type": s["type"], "WARC-Record-ID": s["id"], "WARC-Date": s["date"], "WARC-Target-URI": s["url"], "WARC-IP-Address": s["ip"], "WARC-Warcinfo-ID": about, "WARC-Payload-Digest": _b32(s["digest"])}
                    block = r["block"]
                    if k := of.get(r["number"]):
                        block = s["head"]
                        fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": k["record_id"], "WARC-Refers-To-Target-URI": k["url"], "WARC-Refers-To-Date": k["date"], "X-Refers-To-Page": k["page_id"]}
                    fields |= {"WARC-Block-Digest": _b32(hashlib.sha1(block).hexdigest()), "Content-Type": "application/http; msgtype=response" if s["head"] else r["content-type"]}
                    out.add(warc_record(fields, block))
                out.close()
                yield _manifest([(f"{folder}/{name}", out.records - 1)])

    return materialize(work.mapInArrow(run, "archive string, records long"), "warc-manifest")


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file."""
    fs, at = _fs(path)
    with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
        for line in _lines(stream):
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record where one should start")
            fields = {}
            while (row := stream.readline().decode().rstrip("\r\n")):
                k, _, v = row.partition(": ")
                fields[k.lower()] = v
            block = stream.read(int(fields["content-length"]))
            if fields.get("warc-block-digest", _b32(hashlib.sha1(block).hexdigest())) != _b32(hashlib.sha1(block).hexdigest()):
                raise ValueError(f"{path}: a block's digest differs")
            yield fields, block


def warc_records(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date of the records in WARC files (archive)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = []
                for f, block in read_warc(archive):
                    if f["warc-type"] == "warcinfo":
                        continue
                    _, payload, http = split_http(block)
                    again = f["warc-type"] == "revisit"
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if not again and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{archive}: a payload's digest differs")
                    page, refers = http.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append((int(page) if page else None, int(http["content-length"]) if again else len(payload), digest, f["warc-type"], int(refers) if refers else None, f["warc-record-id"], f["warc-target-uri"], f["warc-date"]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])  # noqa: B905

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold."""
    spark = pages.sparkSession
    arcs = write_arc(pages, new_folder(spark, "arc"))
    return warc_records(spark, convert(arcs, new_folder(spark, "warc")))


def oracle_sql(least_bytes: int = LEAST_BYTES) -> str:
    return f"""
    with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
    k as (select digest, max(page_id) as keep from p where n >= {least_bytes} group by digest)
    select page_id, cast(n as bigint) as payload_bytes, p.digest as payload_digest,
           case when keep is not null and keep <> page_id then 'revisit' else 'response' end as record_type,
           case when keep is not null and keep <> page_id then keep end as refers_to
    from p left join k on p.digest = k.digest
    """
