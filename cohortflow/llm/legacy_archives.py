"""Legacy archives (ARC) to WARC, with revisits for equal payloads.

:func:`convert` reads ARC files of either version, :func:`read_warc` reads WARC files back, :func:`write_arc` makes ARC
files of pages. Files are read whole by Spark (``binaryFile``), so their size must suit a task: those written here hold at
most ``per_file`` records.

* ARC: the first record of a file is ``filedesc://``; its block names the version, and with it the fields of every header
  line: url, address, date, type, length in version 1; url, address, date, type, status, checksum, location, offset, file
  name, length in version 2. A header line is cut from its right end, as urls may hold spaces; the declared length says
  where the block ends. A block shorter than declared becomes a record with ``WARC-Truncated``; a header line that does
  not fit its version stops the job with the file and the place.
* WARC: the record id is a UUID made from the ARC file's name and the record's place in it, so converting again gives the
  same ids; the 14-digit date becomes a timestamp; blocks that start with ``HTTP/`` are responses (or revisits) and others
  resources; digests are SHA-256 of the payload and of the block.
* Equal payloads of at least ``least_bytes``: the record of smallest page id (then file and place; null ids last) is the
  response, the others revisit it and keep only their HTTP header. Which record is first comes from a table of digests,
  aggregated before the shuffle; a digest that many records share is dealt to salts in the join. A file's revisits meet
  its content in a join by file name, at most ``per_file`` of them.

Files are written by Spark's text writer, whose line separator is the end of a record, through the session's file system,
gzipped at ``LEVEL``: its fastest one, as compression at the usual level was most of the job's work.
Null html is the empty payload; a null page id leaves its header field out; a null url is written as ``-``, and blanks in
urls percent-encoded. Repeated rows have a record each. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortflow.operators.joins import join_per_key
from cohortflow.session import Scope, new_path, written

from .textkit import arrow_batch

PER_FILE, LEAST_BYTES, CROWDED = 1000, 100, 100_000
BATCH_BYTES = 1 << 23
LEVEL = "BEST_SPEED"  # a name of Hadoop's zlib.compress.level
# The header fields of each version, as the version block lists them.
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
          2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
PAGE_ID = b"X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "path string, at long, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string"
READ = "record_type string, record_id string, refers_to_id string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string"


def in_batches(records, size=len):
    """Lists of records of about BATCH_BYTES."""
    some, total = [], 0
    for r in records:
        some.append(r)
        total += size(r)
        if total >= BATCH_BYTES:
            yield some
            some, total = [], 0
    if some:
        yield some


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_header(version: int, url: str, date: str, length: int, status: str, offset: int, name: str, kind: str = "text/html") -> bytes:
    middle = f" {status} - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{middle} {length}\n".encode()


def arc_file(pages: list, version: int, name: str, date: str) -> list[bytes]:
    """Records of one file, the version block first; ``pages``: (page_id, url, payload)."""
    from urllib.parse import quote

    block = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n".encode()
    out = [arc_header(version, f"filedesc://{name}", date, len(block), "200", 0, name, "text/plain") + block]
    offset = len(out[0]) + 1
    for page_id, url, payload in pages:
        own = b"" if page_id is None else b"%s: %d\r\n" % (PAGE_ID, page_id)
        doc = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n%s\r\n%s" % (len(payload), own, payload)
        url = quote(url or "-", safe="!#$%&'()*+,/:;=?@[]~|^`{}\"<>\\")
        out.append(arc_header(version, url, date, len(doc), "200", offset, name) + doc)
        offset += len(out[-1]) + 1
    return out


def write_records(records: DataFrame, folder: str, end: str, per_file: int) -> None:
    """The column ``value``, a record each, as gzipped files."""
    texts = records.select(F.col("value").cast("string").alias("value"))
    texts.write.options(lineSep=end, compression="gzip", maxRecordsPerFile=per_file).option("zlib.compress.level", LEVEL).text(folder)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = "20010203040506", per_file: int = PER_FILE) -> None:
    """Pages as gzipped ARC files, files of version 1 and 2 in turn."""

    def run(batches):
        from pyspark import TaskContext

        part, files, held = TaskContext.get().partitionId(), 0, []

        def flushed():
            nonlocal files, held
            records = arc_file(held, 1 + (part + files) % 2, f"pages-{part:06d}-{files:05d}.arc", date)
            files, held = files + 1, []
            for some in in_batches(records):
                yield arrow_batch("value binary", [some])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(row)
                if len(held) == per_file - 1:
                    yield from flushed()
        if held:
            yield from flushed()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    write_records(rows.mapInArrow(run, "value binary"), folder, "\n", per_file)


def arc_records(data: bytes, path: str):
    """(place, url, address, date, type, block, truncated) of each record but the version block."""
    at, version, seen = 0, None, False
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line, start = data[at:end].rstrip(b"\r"), end + 1
        if version is None:  # the version is in the block, whose length is the last field in every version
            version = int(data[start:start + 8].split(b" ")[0]) if line.startswith(b"filedesc://") else 0
            if version not in FIELDS:
                raise ValueError(f"{path}: no version block of a known version")
        parts = line.rsplit(b" ", len(FIELDS[version]) - 1)
        if len(parts) != len(FIELDS[version]) or not parts[-1].isdigit() or not parts[2].isdigit():
            raise ValueError(f"{path}: header at {at} is not of version {version}: {line[:200]!r}")
        length = int(parts[-1])
        block = data[start:start + length]
        if seen:  # a page may have any url
            url, address, date, kind = (x.decode("utf-8", "replace") for x in parts[:4])
            yield at, url, address, date, kind, block, len(block) < length
        seen, at = True, start + length


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); a block without an HTTP header is all payload."""
    cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[:cut + 4], block[cut + 4:]) if cut >= 0 else (b"", block)


def page_id_of(header: bytes) -> int | None:
    for line in header.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == PAGE_ID.lower():
            return int(value)
    return None


def record_id(path: str, at: int) -> str:
    h = hashlib.sha256(f"{path.rsplit('/', 1)[-1]}:{at}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def timestamp(date: str) -> str:
    """2001-02-03T04:05:06Z of 20010203040506; what an early writer left off counts as the first month, day or as zero."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parsed(arcs: DataFrame) -> DataFrame:
    """One row per ARC record, without its block."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for at, url, _, date, _, block, _ in arc_records(plain(content.as_py()), path):
                    header, payload = payload_of(block)
                    rows.append((path, at, record_id(path, at), page_id_of(header), url, timestamp(date), len(payload), hashlib.sha256(payload).hexdigest()))
                if rows:
                    yield arrow_batch(PARSED, zip(*rows))

    return arcs.select("path", "content").mapInArrow(run, PARSED)


def revisits(records: DataFrame, least_bytes: int = LEAST_BYTES, crowded: int = CROWDED) -> DataFrame:
    """(path, at, first): records whose payload an earlier one has, with that one's id, url and date."""
    order = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "path", "at", "record_id", "url", "date")
    firsts = records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rows = records.where(F.col("payload_bytes") >= least_bytes).select("path", "at", "payload_digest")
    found = join_per_key(rows, firsts.where("n > 1").select("payload_digest", "first"), "payload_digest", rows=crowded)
    return found.where("path <> first.path OR at <> first.at").select("path", "at", "first.record_id", "first.url", "first.date")


def warc_record(kind: str, rid: str, date: str, block: bytes, fields: list[tuple[str, str]], content_type: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", date), *fields,
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block


def warc_of(path: str, record: tuple, first: dict | None) -> bytes:
    """The WARC record of an ARC record; ``first``: the one that it revisits."""
    at, url, address, date, kind, block, truncated = record
    header, payload = payload_of(block)
    fields = [("WARC-Target-URI", url), ("WARC-IP-Address", address), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")]
    if truncated:
        fields.append(("WARC-Truncated", "unspecified"))
    if not header:
        return warc_record("resource", record_id(path, at), timestamp(date), block, fields, kind)
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first['record_id']}>"), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"])]
        block = header
    return warc_record("revisit" if first else "response", record_id(path, at), timestamp(date), block, fields, "application/http;msgtype=response")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = LEAST_BYTES, per_file: int = PER_FILE, crowded: int = CROWDED) -> None:
    """All ARC files of a folder as gzipped WARC files in another."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records():
            n = 0
            for batch in batches:
                for path, content, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    firsts = {x["at"]: x for x in again or []}
                    for record in arc_records(plain(content.as_py()), path):
                        if n % (per_file - 1) == 0:  # a file begins
                            info = b"software: cohortflow\r\nformat: WARC File Format 1.1\r\n"
                            yield warc_record("warcinfo", record_id(f"warc-{part}", n), timestamp(record[3]), info, [], "application/warc-fields")
                        yield warc_of(path, record, firsts.get(record[0]))
                        n += 1

        for some in in_batches(records()):
            yield arrow_batch("value binary", [some])

    arcs = archives(spark, arc_folder)
    by_file = revisits(parsed(arcs), least_bytes, crowded).groupBy("path").agg(F.collect_list(F.struct("at", "record_id", "url", "date")).alias("again"))
    rows = arcs.select("path", "content").join(by_file.hint("merge"), "path", "left")
    write_records(rows.mapInArrow(run, "value binary"), warc_folder, "\r\n\r\n", per_file)


def warc_records(data: bytes, path: str):
    """(fields in lower case, block) of each record; digests are verified."""
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8").split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"{path}: no record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[cut + 4:cut + 4 + size]
        at = cut + 4 + size + 4
        if fields.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}" or data[at - 4:at] != b"\r\n\r\n":
            raise ValueError(f"{path}: the record {fields.get('warc-record-id')} is damaged")
        yield fields, block


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row per record but warcinfo. Of revisits ``payload_bytes`` is null, as the record lacks the payload."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for f, block in warc_records(plain(content.as_py()), path):
                    if f["warc-type"] == "warcinfo":
                        continue
                    header, payload = payload_of(block)
                    digest = f["warc-payload-digest"].partition(":")[2]
                    again = f["warc-type"] == "revisit"
                    if not again and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload of {f['warc-record-id']} is damaged")
                    refers = f.get("warc-refers-to", "").strip("<>") or None
                    rows.append((f["warc-type"], f["warc-record-id"].strip("<>"), refers, f["warc-target-uri"], f["warc-date"], page_id_of(header),
                                 None if again else len(payload), digest))
                if rows:
                    yield arrow_batch(READ, zip(*rows))

    return warcs.select("path", "content").mapInArrow(run, READ)


def page_records(records: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri): revisits with the page id and
    the payload size of the response that they name."""
    whole = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    targets = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole_bytes"))
    again = join_per_key(records.where("record_type = 'revisit'"), targets, "refers_to_id", "left", rows=crowded)
    again = again.withColumn("payload_bytes", F.col("whole_bytes")).drop("whole_bytes")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri"]
    return whole.select(*cols).unionByName(again.select(*cols))


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Pages written as ARC files, converted to WARC files and read back. The WARC files stay in the work folder."""
    spark = pages.sparkSession
    warcs = new_path(spark, "warc")
    with Scope(spark) as scope:
        arcs = new_path(spark, "arc")
        write_arc(pages, arcs, **columns)
        convert(spark, arcs, warcs)
        records = written(read_warc(archives(spark, warcs)), "records")
        return scope.keep(page_records(records), "pages")
