"""WARC archives written and read as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

CRLF = "\r\n"
#: Code points per chunk. Larger payloads are cut into WARC segments of this size.
CHUNK = 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 32 digits of 5 bits, no padding."""
    digest = F.sha1(payload)  # 40 hex digits; 5 of them make 4 base32 digits

    def group(i: int):
        number = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*(x for i in range(8) for x in group(i)))


def choose_responses(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, mark, digest, refers_to): ``refers_to`` is the least page_id of an equal
    payload of at least ``least_bytes`` bytes, where that is another record, else null.
    Slim rows only; a payload that very many records share is combined before the shuffle."""
    first = records.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"))
    found = records.join(first, ["digest", "bytes"], "left")
    return found.select("page_id", "mark", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def chunk_table(pages: DataFrame, chunk: int = CHUNK, least_bytes: int = 0) -> DataFrame:
    """The records of ``pages`` (page_id, url, html) as rows (page_id, kind, refers_to,
    digest, bytes, url, chunk_no, chunks, chunk): one row per chunk of at most ``chunk``
    code points, at least one per record; revisits have one empty chunk."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.xxhash64(html).alias("mark"))
    base = base.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    slim = materialize(base.select("page_id", "mark", "digest", "bytes"), "digests")
    chosen = choose_responses(slim, least_bytes).where("refers_to is not null").distinct()
    both = base.join(chosen, ["page_id", "mark"], "left")
    body = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("")
    size = F.char_length(body)
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(size / chunk).cast("int") - 1, F.lit(0)))
    # A payload of one chunk, the usual case, is passed on without cutting.
    chunks = F.when(size <= chunk, F.array(F.struct(F.lit(0).alias("i"), body.alias("c")))).otherwise(
        F.transform(cuts, lambda i: F.struct(i.alias("i"), F.substring(body, i * chunk + 1, F.lit(chunk)).alias("c")))
    )
    return both.select(
        "page_id", "url", "digest", "bytes", "refers_to", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("kind"),
        F.size(cuts).alias("chunks"), F.explode(chunks).alias("x"),
    ).select("page_id", "url", "digest", "bytes", "refers_to", "kind", "chunks", (F.col("x.i") + 1).alias("chunk_no"), F.col("x.c").alias("chunk"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK, least_bytes: int = 0) -> None:
    """Write gzip'd WARC/1.1 files below ``path``, one per task.

    A record is one row of the text sink, whose line separator is the blank lines that end
    a WARC record. Chunks after a record's first are WARC segments (``continuation``
    records with a segment number); they follow it in the same file."""
    rows = chunk_table(pages, chunk, least_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    own, segmented = record_id(F.col("page_id")), F.col("chunks") > 1
    later = F.col("chunk_no") > 1
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(later, "continuation").otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.when(later, F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("chunk_no"), F.lit(">"))).otherwise(own)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.when(segmented, line("WARC-Segment-Number", F.col("chunk_no").cast("string"))).otherwise(""),
        F.when(later, line("WARC-Segment-Origin-ID", own)).otherwise(""),
        F.when(segmented & (F.col("chunk_no") == F.col("chunks")), line("WARC-Segment-Total-Length", F.col("bytes").cast("string"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        line("Content-Length", F.octet_length("chunk").cast("string")),
        F.lit(CRLF),
    )
    rows.select(F.concat(header, "chunk").alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of WARC files: (file, record_id, refers_to, kind, chunk_no, bytes,
    sha1, total, stated, ended).

    Lines are streamed, so neither an archive nor a record is ever whole in memory; ``sha1``
    and ``total`` are the digest and length of the record's payload up to the end of this
    chunk, carried from chunk to chunk. ``ended`` marks a record's last chunk.
    A record that breaks off fails the read."""

    def run(batches):
        names = ["file", "record_id", "refers_to", "kind", "chunk_no", "bytes", "sha1", "total", "stated", "ended"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        out: list[tuple] = []
        header: dict[str, str] | None = None
        need, at, record = 0, None, None  # bytes missing of the block; file; (id, sha1, total, refers_to, kind)

        def finish():
            nonlocal header, record
            number = int(header.get("warc-segment-number", 1))
            last = "warc-segment-number" not in header or "warc-segment-total-length" in header
            rid, sha1, total, refers, kind = record
            if last and int(header.get("warc-segment-total-length", total)) != total:
                raise ValueError(f"record {rid} is incomplete")
            out.append((at, rid, refers, kind, number, int(header["content-length"]), base64.b32encode(sha1.copy().digest()).decode(), total, header.get("warc-payload-digest", "").removeprefix("sha1:"), last))
            header = None

        for b in batches:
            for line, file in zip(b.column(0), b.column(1), strict=True):
                file = file.as_py()
                if file != at:
                    if header is not None:
                        raise ValueError(f"{at} breaks off inside a record")
                    at, record = file, None
                data = line.as_buffer()
                size = data.size + 1  # the line feed that ended the line
                if header is None:
                    text = data.to_pybytes()
                    if not text.strip():
                        continue  # the blank lines between records
                    if not text.startswith(b"WARC/"):
                        raise ValueError(f"{at}: expected a record")
                    header, need = {}, -1
                elif need < 0:
                    text = data.to_pybytes().rstrip(b"\r")
                    if text:
                        name, _, value = text.partition(b":")
                        header[name.decode().lower()] = value.strip().decode()
                        continue
                    need = int(header["content-length"])
                    if header["warc-type"] == "continuation":
                        if record is None or record[0] != header["warc-segment-origin-id"]:
                            raise ValueError(f"{at}: a segment without its record")
                    else:
                        record = (header["warc-record-id"], hashlib.sha1(), 0, header.get("warc-refers-to"), header["warc-type"])
                    if not need:
                        finish()
                else:
                    part = memoryview(data)[: min(need, size - 1)]
                    record[1].update(part)
                    taken = len(part)
                    if need > taken:  # the line feed itself belongs to the block
                        record[1].update(b"\n")
                        taken += 1
                    record = (record[0], record[1], record[2] + taken, record[3], record[4])
                    need -= taken
                    if not need:
                        finish()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if header is not None:
            raise ValueError(f"{at} breaks off inside a record")

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(run, "file string, record_id string, refers_to string, kind string, chunk_no long, bytes long, sha1 string, total long, stated string, ended boolean")


def archive_pages(pages: DataFrame, chunk: int = CHUNK, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them
    back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per record.

    A revisit holds no payload; its length and digest are those read from the response it
    refers to. Null html: empty payload. Empty payloads count as equal. Rows that repeat a
    page_id and payload are all responses if theirs is the least page_id, else revisits.
    Null page_id: a response that nothing refers to. Empty table: no rows."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, chunk=chunk, least_bytes=least_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    chunks = read_archives(spark, path).where("ended")
    records = materialize(chunks.select(number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), "kind", "total", "sha1", "stated"), "records")
    wrong = records.where("kind = 'response' and sha1 <> stated").limit(1).count()
    if wrong:
        raise ValueError("a payload does not have its stated digest")
    held = records.where("kind = 'response'").select(F.col("page_id").alias("refers_to"), F.col("total").alias("t"), F.col("sha1").alias("s"), "stated").withColumnRenamed("stated", "held").dropDuplicates(["refers_to", "held"])
    full = records.join(held, (records.refers_to == held.refers_to) & (records.stated == held.held), "left").drop(held.refers_to)
    return full.select(
        "page_id", F.coalesce("t", "total").alias("payload_bytes"), F.coalesce("s", "sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )
