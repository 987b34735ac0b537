"""WARC archives: writing, and normalising monolithic gzip files.

A writer streams the records of each partition into one gzip member, as tools
that compress a whole archive at once do.  The normaliser inflates such a file
once, in bounded pieces, finds the records, writes every record as a gzip member
of its own and, beside the archive, a sidecar index with a JSON line per record
(offset, length, record id, type).  Readers then fetch any record by its offset.

Defined results: a null html is the empty payload; of records with equal
payloads those with the largest page_id are responses (rows that repeat that id
with the same payload are all responses) and the others revisits without a
body; a null page_id is smaller than any other; a null url leaves the header
out, line ends in a url are percent-encoded; records of any length pass in
pieces; an empty table gives no archive and an empty result.  Payloads are equal
if SHA-1, a second 64-bit hash and length are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import filesystem, materialise, scratch

VERSION = b"WARC/1.1"
#: Fixed, so that archives are the same whenever they are written.
DATE = "1970-01-01T00:00:00Z"
PIECE = 1 << 20
#: Tasks over which the rows of one payload are spread when they meet its largest page_id.
SALTS = 16
#: Extension headers: the page's id, the full payload's size, the response's page id.
PAGE, SIZE, REFERS = "Tidewater-Page-ID", "Tidewater-Payload-Length", "Tidewater-Refers-To-Page-ID"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head only."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        (PAGE, page_id),
        (SIZE, len(payload)),
        (REFERS, refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None)
    return VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip stream of one or more members, in bounded pieces."""
    machine = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            if machine.eof:
                machine = zlib.decompressobj(31)
            out = machine.decompress(piece, PIECE)
            if out:
                yield out
            piece = machine.unconsumed_tail or machine.unused_data
    while not machine.eof:
        out = machine.decompress(machine.unconsumed_tail, PIECE)
        if not out:
            break
        yield out


def normalise(pieces: Iterable[bytes], write, level: int = 6) -> Iterator[dict]:
    """Rewrite a gzip stream record by record; *write* gets the compressed bytes.

    Yields the index entry of each record.  Only the head of a record is held
    as a whole; its body passes in pieces.
    """
    source, held, offset = inflate(pieces), bytearray(), 0

    def more() -> bool:
        part = next(source, None)
        if part is None:
            return False
        held.extend(part)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("cut-off record")
                return
        head = parse_head(bytes(held[:end]))
        left = end + 4 + int(head["content-length"]) + 4
        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        while left:
            if not held and not more():
                raise ValueError("cut-off record")
            n = min(left, len(held))
            done = member.compress(bytes(held[:n]))
            write(done)
            length += len(done)
            del held[:n]
            left -= n
        done = member.flush()
        write(done)
        length += len(done)
        yield {"offset": offset, "length": length, "id": head.get("warc-record-id"), "type": head.get("warc-type")}
        offset += length


def write_monolithic(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Archives of *pages* in *folder*, each one gzip member; returns their manifest."""
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = hashed.withColumn("digest", F.concat(F.sha1(F.col("html").cast("binary")), F.hex(F.xxhash64("html")), F.octet_length("html").cast("string")))
    tops = hashed.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "top")
    # the rows of a very common payload are dealt to SALTS tasks
    tops = tops.select("digest", "top", F.lit(True).alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url") + F.spark_partition_id(), F.lit(SALTS)).cast("int")).join(tops, ["digest", "salt"], "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("top"))
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.col("top").cast("long").alias("top"), revisit.alias("revisit"))

    def one_archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, out, machine, count = f"{uuid.uuid4().hex}.warc.gz", None, None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for page_id, url, html, top, again in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns]):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out, machine = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(machine.compress(record(page_id, url, html.encode("utf-8"), top, again)))
                    count += 1
        if out is not None:
            out.write(machine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])

    return materialise(rows.mapInArrow(one_archive, "file string, records long"), "warc-manifest")


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def normalise_archives(spark: SparkSession, manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise every archive that *manifest* names; returns the new manifest."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs_in, root_in = filesystem(source)
        fs, root = filesystem(target)
        fs.create_dir(root, recursive=True)
        for frame in frames:
            for file in frame["file"]:
                name = f"{uuid.uuid4().hex}.warc.gz"
                with fs_in.open_input_stream(f"{root_in}/{file}", compression=None) as f, fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    index = [json.dumps(entry) for entry in normalise(_pieces(f), out.write)]
                with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
                    out.write("".join(f"{line}\n" for line in index).encode())
                yield pd.DataFrame({"file": [name], "records": [len(index)]})

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialise(manifest.select("file").repartition(parts, "file").mapInPandas(one, "file string, records long"), "warc-manifest")


def read_index(fs, path: str) -> list[dict]:
    """The sidecar index of an archive."""
    with fs.open_input_stream(f"{path}.idx", compression=None) as f:
        return [json.loads(line) for line in f.read().decode().splitlines()]


def read_record(handle, entry: dict) -> tuple[dict[str, str], bytes]:
    """Head and HTTP body of the record at an index entry: one seek, one member."""
    handle.seek(entry["offset"])
    raw = zlib.decompress(handle.read(entry["length"]), 31)
    end = raw.find(b"\r\n\r\n")
    head = parse_head(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    return head, block[block.find(b"\r\n\r\n") + 4 :]


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for frame in frames:
            for file in frame["file"]:
                rows = []
                with fs.open_input_file(f"{root}/{file}") as f:
                    for entry in read_index(fs, f"{root}/{file}"):
                        head, payload = read_record(f, entry)
                        kind = head["warc-type"]
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        size = int(head[SIZE.lower()])
                        if kind == "response":
                            size, digest = len(payload), sha1_base32(payload)
                        page, top = head.get(PAGE.lower()), head.get(REFERS.lower())
                        rows.append((page and int(page), size, digest, kind, top and int(top)))
                frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("file").repartition(parts, "file").mapInPandas(one, kinds)


def archive(pages: DataFrame) -> DataFrame:
    """Write *pages* as monolithic archives, normalise these, and return what
    the normalised archives hold."""
    spark = pages.sparkSession
    source, target = scratch(spark, "warc-whole"), scratch(spark, "warc")
    whole = write_monolithic(pages, source)
    normal = normalise_archives(spark, whole, source, target)
    where = spark._jvm.org.apache.hadoop.fs.Path(source)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return read_archives(spark, normal, target)
