"""Archives: round trip, format, and odd rows."""

import glob
import hashlib

import zstandard
from pyspark.sql import functions as F

from procwatch.llm import warc

LONG = "<p>" + "word " * 40 + "</p>"
ROWS = [(1, "http://a/", None), (2, "http://b/ c\n", ""), (3, None, LONG), (4, "u", LONG), (5, "u", LONG), (3, "u", LONG),
        (6, "u", "short"), (7, "u", "short"), (None, "u", LONG), (None, "u", LONG + "é"), (None, "u", LONG + "é"),
        (8, "u", "ab\r\n\r\nWARC/1.1" * 20 + "P*M\x18\0\0\0\0" * 30), (9, "u", "é" * 500_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_records(spark):
    got = {}
    for r in warc.archived(frame(spark).withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))).collect():
        got.setdefault(r["page_id"], []).append(r)
    for page, _, html in ROWS:
        payload = (html or "").encode()
        assert any(r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
                   for r in got[page])
    kinds = {p: sorted((r["record_type"], r["refers_to"]) for r in rs) for p, rs in got.items() if p is not None}
    assert kinds[3] == [("response", None)] * 2
    assert kinds[4] == kinds[5] == [("revisit", 3)]
    assert kinds[6] == kinds[7] == [("response", None)]
    assert sorted(str(r["refers_to"]) for r in got[None]) == ["3", "None", "None"]


def test_format(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = warc.write_archives(pages.coalesce(2), f"file://{tmp_path}/archives")
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    seen = {}
    for path in glob.glob(f"{tmp_path}/archives/part-*"):
        content = open(path, "rb").read()
        assert content[:4] == b"\x5d\x2a\x4d\x18"  # the dictionary stands first
        size = int.from_bytes(content[4:8], "little")
        assert size > 0
        shared = zstandard.ZstdCompressionDict(content[8:8 + size])
        # a stock decoder reads the rest as one stream of frames
        reader = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(content[8 + size:], read_across_frames=True)
        whole = reader.read()
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ")
        for record in warc.split_frames(memoryview(content)):
            fields = warc.parse_record(record)
            seen[warc._page(fields["warc-record-id"])] = fields
    assert seen.keys() == payloads.keys()
    for page, fields in seen.items():
        stored = fields if fields["warc-type"] == "response" else seen[warc._page(fields["warc-refers-to"])]
        assert stored["block"] == payloads[page]
    read = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, folder, payloads=True).collect()}
    assert all(read[p] in (None, payloads[p]) for p in payloads)


def test_empty_table(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def test_archives_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 300)
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 9)
    pages = spark.range(400).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(f":{i}"))) for i in range(12)]).alias("html")).coalesce(2)
    for name, size, most in (("rows", 1 << 30, 9 * 1200), ("bytes", 2000, 4000)):  # ends by rows, or by bytes
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        folder = warc.write_archives(pages, f"file://{tmp_path}/{name}")
        contents = [open(p, "rb").read() for p in glob.glob(f"{tmp_path}/{name}/part-*")]
        assert len(contents) > 10 and max(map(len, contents)) < most + len(warc.train_dictionary(pages, "page_id", "html"))
        assert all(c[:4] == b"\x5d\x2a\x4d\x18" for c in contents)
        read = warc.read_archives(spark, folder, payloads=True).select("page_id", F.col("payload").cast("string"))
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, pages.select("page_id", "html").collect()))


def test_record_fields(spark, tmp_path):
    warc.write_archives(frame(spark), f"file://{tmp_path}/f", date="2026-01-02T03:04:05Z")
    fields = [warc.parse_record(r) for p in glob.glob(f"{tmp_path}/f/part-*")
              for r in warc.split_frames(memoryview(open(p, "rb").read()))]
    ids = {}
    for f in fields:
        assert f["warc-date"] == "2026-01-02T03:04:05Z"
        ids.setdefault(f["warc-record-id"], set()).add(f["block"])
    assert len(fields) == len(ROWS) and all(len(blocks) == 1 for blocks in ids.values())
    assert len(ids) == len(ROWS) - 1  # page 3 stands twice with one payload
    targets = {f["warc-refers-to"] for f in fields if "warc-refers-to" in f}
    assert targets and all(ids[t] == {LONG.encode()} for t in targets)
