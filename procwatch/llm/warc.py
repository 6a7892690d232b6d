"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary, as readers of
`.warc.zst` files expect; then follows one frame per record. Spark's text writer puts the
frames into files through its commit protocol, on any file system and safely under lost
tasks; what it writes after each row is an empty skippable frame, which decoders pass over.
A row holds about `ROW_BYTES` of frames. A task starts a new archive, its dictionary first, after
`ARCHIVE_BYTES`: Spark begins a file every `ARCHIVE_ROWS` rows, and empty rows fill up to there.

The dictionary is trained on a bounded sample of payloads (`SAMPLE_ROWS`, each cut to
`SAMPLE_CHARS` characters); it only decides how well records compress. Of equal payloads
that with the smallest id is stored, the others are revisits of it. A payload's digest is
grouped map-side first, and payloads are joined to the small table of repeated digests, a
join whose large groups Spark splits.
"""

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from procwatch.session import materialize, session_dir

SKIPPABLE = 0x184D2A50
DICTIONARY_FRAME = 0x184D2A5D
#: What Spark writes after each row: a skippable frame of length 0, all of it ASCII.
ROW_END = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
MIN_REVISIT_BYTES = 100
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 64 * 1024
ROW_BYTES, ARCHIVE_BYTES, ARCHIVE_ROWS = 1 << 20, 128 << 20, 256
_DEAL = 64  # parts in which the sample is first looked for
LEVEL = 3
_ID = "urn:x-page:"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def train_dictionary(payloads: DataFrame, key: str, text: str) -> bytes:
    """A dictionary from the payloads whose ids have the smallest hashes; empty if too few help.

    The hashes are found without payloads, in parts first; the driver holds the sample alone.
    """
    rows = payloads.where(F.length(text) > 0).select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("t"))
    in_part = Window.partitionBy(F.pmod("h", F.lit(_DEAL))).orderBy("h")
    few = rows.select("h").withColumn("n", F.row_number().over(in_part)).where(F.col("n") <= SAMPLE_ROWS)
    cut = few.orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if cut is None:
        return b""
    sample = (rows.where(F.col("h") <= cut).groupBy("h")
              .agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t"))
              .orderBy("h").collect())  # a repeated id counts once
    texts = [row["t"].encode() for row in sample]
    if sum(map(len, texts)) < 20 * 1024 or len(texts) < 8:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, texts)) // 10)
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # texts without anything in common
        return b""


def _header(fields: dict[str, object]) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields.items() if v is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _record_id(page_id: int | None, mark: str) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}:{mark}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without.

    A response that others may refer to is named by its page and digest; what nothing refers to
    by its page and a mark of its own. So a repeated page id does not repeat a record's id, unless
    page and payload are both the same.
    """
    revisit = refers_to is not None
    block = b"" if revisit else payload
    referable = not revisit and page_id is not None and len(payload) >= MIN_REVISIT_BYTES
    safe_url = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return _header({
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, digest[:32] if referable else uuid.uuid4().hex),
        "WARC-Date": date,
        "WARC-Target-URI": safe_url,
        "WARC-Refers-To": _record_id(refers_to, digest[:32]) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                        if revisit else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": len(payload),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": len(block)}) + block + b"\r\n\r\n"


def _frames(dictionary: bytes):
    """Function from a record to its frame."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True).compress


def _with_references(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= MIN_REVISIT_BYTES
    repeated = (rows.where(long_enough).groupBy("digest")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 AND first IS NOT NULL").drop("n"))
    refers = F.when(long_enough & (F.col("page_id") != F.col("first")), F.col("first"))
    null_id = F.when(long_enough & F.col("page_id").isNull(), F.col("first"))
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.coalesce(refers, null_id).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", date: str | None = None) -> str:
    """Write one record per row of `pages` into archives under `folder`; return the folder.

    A null payload is empty. Payloads under 100 bytes are all stored. Rows that share the
    smallest id of a payload are all stored; a null id is larger than any other, and if all
    ids of a payload are null all are stored. An empty table gives archives without records. A long
    text is one record, and may carry an archive beyond its size. `date` (by default the time of the
    call) is the records' WARC-Date, as the table has none.
    Only the named columns are read, whatever others are called.
    """
    dictionary = train_dictionary(pages, page_id, html)
    first_frame = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    row_bytes, archive_bytes, archive_rows = ROW_BYTES, ARCHIVE_BYTES, ARCHIVE_ROWS

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(*values: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"frame": pa.array(values, pa.binary())})

        frame = _frames(dictionary)
        held, size = [first_frame], len(first_frame)
        written = n_rows = 0  # of the archive at hand
        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if not held and not n_rows:
                    held, size = [first_frame], len(first_frame)
                page, address, payload, digest, refers = [c[i].as_py() for c in columns]
                held.append(frame(record_bytes(page, address, payload, digest, refers, date)))
                size += len(held[-1])
                if size < row_bytes:
                    continue
                yield rows(b"".join(held))
                n_rows, written = n_rows + 1, written + size
                held, size = [], 0
                if written >= archive_bytes or n_rows == archive_rows:
                    if n_rows < archive_rows:
                        yield rows(*[b""] * (archive_rows - n_rows))
                    written = n_rows = 0
        if held:
            yield rows(b"".join(held))

    (_with_references(pages, page_id, url, html).mapInArrow(compress, "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", ROW_END).option("maxRecordsPerFile", ARCHIVE_ROWS).mode("overwrite").text(folder))
    return folder


def split_frames(content: memoryview) -> Iterator[bytes]:
    """The decompressed records of one archive, one at a time."""
    at, end, dictionary = 0, len(content), None
    while at < end:
        magic = struct.unpack_from("<I", content, at)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            size = struct.unpack_from("<I", content, at + 4)[0]
            if magic == DICTIONARY_FRAME and size:
                dictionary = zstandard.ZstdCompressionDict(bytes(content[at + 8:at + 8 + size]))
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, step = [], 1 << 16
        while not reader.eof:
            if at >= end:
                raise ValueError("the archive ends within a record")
            parts.append(reader.decompress(content[at:at + step]))
            at = min(at + step, end)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Header fields (lower-case names) and `block`."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields | {"block": rest[:int(fields["content-length"])]}


def _page(reference: str | None) -> int | None:
    number = reference[len(_ID) + 1:-1].split(":")[0] if reference else ""
    return int(number) if number else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives under `folder`, digest and length checked.

    `payloads=True` adds `payload`, null for revisits. A task holds one archive and one record.
    """
    schema = _RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for record in split_frames(memoryview(content.as_buffer())):
                    found = parse_record(record)
                    digest = found["warc-payload-digest"].removeprefix("sha256:")
                    length = int(found["warc-payload-length"])
                    if found["warc-type"] == "response" and (
                            len(found["block"]) != length
                            or hashlib.sha256(found["block"]).hexdigest() != digest):
                        raise ValueError(f"damaged record {found['warc-record-id']}")
                    row = (_page(found["warc-record-id"]), length, digest, found["warc-type"],
                           _page(found.get("warc-refers-to")))
                    if payloads:
                        row += (found["block"] if found["warc-type"] == "response" else None,)
                        held += len(found["block"])
                    rows.append(row)
                    if len(rows) >= 5000 or held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    # each archive is a row of its own; batches of one keep a task at one archive in memory
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(parse, schema)


def archived(pages: DataFrame, **names: str) -> DataFrame:
    """Write archives into the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    folder = write_archives(pages, f"{session_dir(spark)}/warc-{uuid.uuid4().hex}", **names)
    return read_archives(spark, folder)
