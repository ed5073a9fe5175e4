"""WARC archives written and read as a chunked record table.

A payload travels as rows (record id, chunk number, bytes), never as one value beyond its source row:
payloads over ``chunk_bytes`` are written as WARC segments (the first record, then ``continuation``
records), each with its own block digest and the running digest of the payload up to its end, so a
reader continues a digest chunk by chunk and notices damage at the first bad one.

Spark's text writer makes the files: each row is one whole record, the line separator is the blank
line that ends a record, and a file (gzip) rolls over after a fixed number of records. Everything goes
through Spark's own file systems; nothing touches a machine's own disk. The reader inflates an archive
piece by piece and checks each record as it passes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen, scratch_path

CHUNK_BYTES = 64 << 10
#: Records in an archive file: bounds a file to 64 MiB of payload besides headers.
FILE_RECORDS = 1024
#: Bytes of rows that a task hands over at once, and of an archive that it reads at once.
BATCH_BYTES = 1 << 20
END = "\r\n\r\n"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload binary"


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest (SHA-1 in hex; the records name it in base32), record_type and refers_to.

    Of pages with equal payloads of at least ``min_bytes`` the one with the largest page_id is the
    response and the others revisit it. Rows that share that largest page_id are all responses; a null
    page_id revisits if any other is known, else it is a response. Only (digest, page_id) is
    aggregated, map side first; a payload that a third of all pages share then joins as a skewed key.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    last = base.groupBy("digest").agg(F.max("page_id").alias("last"))
    first = F.col("last").isNull() | (F.octet_length("payload") < min_bytes) | F.col("page_id").eqNullSafe(F.col("last"))
    return (base.join(last, "digest")
            .withColumn("record_type", F.when(first, "response").otherwise("revisit"))
            .withColumn("refers_to", F.when(~first, F.col("last"))).drop("last"))


def record_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record_id, chunk, record): each row is the text of one WARC record, without its closing blank line.

    ``records`` has the columns RECORDS. A revisit carries no payload, only its digest and length.
    """

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        def header(fields):
            return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"

        def b32(h):
            return base64.b32encode(h.digest()).decode()

        names, kinds = ["record_id", "chunk", "record"], [pa.string(), pa.int32(), pa.binary()]
        rows, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                rid, page, url, kind, to, data = (b.column(k)[i] for k in range(6))
                rid, view = rid.as_py(), memoryview(data.as_buffer() or b"")
                whole, running = b32(hashlib.sha1(view)), hashlib.sha1()
                shown = view if kind.as_py() == "response" else view[:0]
                n = max(1, -(-len(shown) // chunk_bytes))
                for k in range(n):
                    chunk = shown[k * chunk_bytes:(k + 1) * chunk_bytes]
                    running.update(chunk)
                    head = header([
                        ("WARC-Type", kind.as_py() if k == 0 else "continuation"),
                        ("WARC-Record-ID", f"<urn:strata:{rid}:{k}>"),
                        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "", url.as_py()) if k == 0 and url.is_valid else None),
                        ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("WARC-Payload-Digest", f"sha1:{whole}" if k == 0 else None),
                        ("WARC-Block-Digest", f"sha1:{b32(hashlib.sha1(chunk))}"),
                        ("X-Running-Digest", f"sha1:{b32(running)}"),
                        ("X-Payload-Length", len(view) if k == 0 else None),
                        ("X-Page-ID", page.as_py()),
                        ("WARC-Refers-To", f"<urn:strata:{to.as_py()}>" if k == 0 and to.is_valid else None),
                        ("WARC-Segment-Number", k + 1 if n > 1 else None),
                        ("WARC-Segment-Origin-ID", f"<urn:strata:{rid}:0>" if k else None),
                        ("WARC-Segment-Total-Length", len(view) if n > 1 and k == n - 1 else None),
                        ("Content-Type", "text/html" if k == 0 else None),
                        ("Content-Length", len(chunk)),
                    ])
                    rows.append((rid, k, head.encode() + bytes(chunk)))
                    held += len(rows[-1][2])
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    cols = [x.split()[0] for x in RECORDS.split(", ")]
    return records.select(*cols).mapInArrow(run, "record_id string, chunk int, record binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
                   file_records: int = FILE_RECORDS) -> None:
    """One WARC record per page (more for a payload over ``chunk_bytes``), in files of at most
    ``file_records`` records under ``path``."""
    rows = with_roles(pages, min_bytes).withColumn("record_id", F.expr("uuid()"))
    (record_rows(rows, chunk_bytes).select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path))


class Inflated:
    """A gzip archive read piece by piece."""

    def __init__(self, data: memoryview):
        import zlib

        self.data, self.at, self.unzip, self.held = data, 0, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.at >= len(self.data) and not self.unzip.unconsumed_tail:
            return False
        raw = self.unzip.unconsumed_tail or self.data[self.at:self.at + BATCH_BYTES]
        self.at += 0 if self.unzip.unconsumed_tail else len(raw)
        self.held += self.unzip.decompress(raw, BATCH_BYTES)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to a mark, which is skipped; None at the end of the archive."""
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.held = self.held[:i], self.held[i + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


CHUNKS = ("record_id string, chunk int, last boolean, page_id long, url string, record_type string, refers_to long, "
          "payload_bytes long, payload_digest string, running_digest string, bytes binary")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: a row per WARC record (columns CHUNKS).

    Every block digest is checked where it is read; a record of one chunk is checked whole (length and
    payload digest) and comes without its bytes, chunks of longer records keep theirs. Digest and length
    are as declared, the running digest covers the payload up to the end of the chunk.
    """

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.string(), pa.binary()]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for cell in b.column(0):
                archive = Inflated(memoryview(cell.as_buffer()))
                while (head := archive.until(END.encode())) is not None:
                    first, *fields = head.decode().split("\r\n")
                    if first != "WARC/1.1":
                        raise ValueError("not a WARC record")
                    f = dict(x.split(": ", 1) for x in fields)
                    body = archive.take(int(f["Content-Length"]))
                    if archive.take(len(END)) != END.encode():
                        raise ValueError(f"record {f['WARC-Record-ID']} does not end where it says")
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if digest != f["WARC-Block-Digest"][5:]:
                        raise ValueError(f"record {f['WARC-Record-ID']} is damaged")
                    alone = "WARC-Segment-Number" not in f
                    if alone and f["WARC-Type"] == "response" and (
                            len(body) != int(f["X-Payload-Length"]) or digest != f["WARC-Payload-Digest"][5:]):
                        raise ValueError(f"record {f['WARC-Record-ID']} is not what its header declares")
                    to, n = f.get("WARC-Refers-To"), f.get("X-Payload-Length")
                    rows.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(f.get("WARC-Segment-Number", 1)) - 1,
                                 alone or "WARC-Segment-Total-Length" in f, int(f["X-Page-ID"]) if "X-Page-ID" in f else None,
                                 f.get("WARC-Target-URI"), f["WARC-Type"], int(to.strip("<>").rsplit(":", 1)[1]) if to else None,
                                 int(n) if n else None, f.get("WARC-Payload-Digest", "")[5:] or None, f["X-Running-Digest"][5:],
                                 None if alone else body))
                    held += 256 + (0 if alone else len(body))
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, CHUNKS)


PAGES = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def assembled(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes and payload_digest.

    Only chunks of longer records are brought together: sorted by chunk number they pass one at a time
    through a running digest, so no task holds a whole payload. A missing chunk, or a digest that
    differs from the declared one, raises an error.
    """

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        names = [x.split()[0] for x in PAGES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        head, sha, size, seen = None, None, 0, 0
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["chunk"] == 0 and not head:
                    head, sha, size, seen = x, hashlib.sha1(), 0, 0
                elif not head or x["record_id"] != head["record_id"] or x["chunk"] != seen:
                    raise ValueError(f"chunk {x['chunk']} of record {x['record_id']} is out of place")
                sha.update(x["bytes"])
                size, seen = size + len(x["bytes"]), x["chunk"] + 1
                digest = base64.b32encode(sha.digest()).decode()
                if digest != x["running_digest"]:
                    raise ValueError(f"chunk {x['chunk']} of record {x['record_id']} is damaged")
                if x["last"]:
                    if (size, digest) != (head["payload_bytes"], head["payload_digest"]):
                        raise ValueError(f"record {head['record_id']} is not what its header declares")
                    rows.append((head["page_id"], head["url"], head["record_type"], head["refers_to"], size, digest))
                    head = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        if head:
            raise ValueError(f"record {head['record_id']} has no last chunk")

    short = chunks.filter("bytes IS NULL").select(*[x.split()[0] for x in PAGES.split(", ")])
    long = (chunks.filter("bytes IS NOT NULL").repartition("record_id").sortWithinPartitions("record_id", "chunk")
            .mapInArrow(run, PAGES))
    return short.unionByName(long)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Every page written to archives in the shared folder and read back.

    A null html is an empty payload; url and page_id may be null and page rows may repeat (each row is
    a record). Other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return assembled(frozen(read_chunks(spark, path), "chunks")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
