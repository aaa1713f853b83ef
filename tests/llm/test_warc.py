import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from rentatlas.llm import queries, warc

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], PAGES)


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows, least=0):
    by = {}
    for i, h in rows:
        by.setdefault(h or "", []).append(i)
    out = []
    for i, h in rows:
        text = h or ""
        ids = [x for x in by[text] if x is not None]
        top = max(ids) if ids and len(text.encode()) >= least else i
        again = top != i
        out.append((i, len(text.encode()), digest(text), "revisit" if again else "response",
                    top if again else None))
    return sorted(out, key=str)


ROWS = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, None), (4, ""), (5, "é日😀\r\n\r\nWARC/1.1\r\n"),
        (6, "x" * 700_000), (7, "x" * 700_000), (None, "<p>a</p>"), (None, "alone"), (8, "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    df = pages(spark, ROWS).withColumn("payload", F.lit("clash")).withColumn("file", F.lit("c"))
    manifest = warc.write_archives(df, str(tmp_path / "w"), least)
    out = warc.read_archives(manifest).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == expected(ROWS, least)
    html = dict(ROWS)
    for r in out:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == (html[r.page_id] or "")
    assert sum(r.records for r in manifest.collect()) == len(ROWS)


def test_files_are_gzip_members_that_other_readers_open(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, ROWS[:3]), str(tmp_path / "w")).collect()
    for row in manifest:
        with gzip.open(row.file) as file:
            data = file.read()
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") == row.records
        assert row.bytes == len(open(row.file, "rb").read())


def test_reader_needs_no_more_than_a_few_bytes_at_a_time():
    made = [warc.record_bytes(i, "u", bytes([65 + i]) * 5000, None, False) for i in range(3)]
    data = b"".join(map(warc.gzip_member, made))
    for chunk in (1, 7, 1 << 20):
        found = list(warc.records(io.BytesIO(data), chunk))
        assert [r.payload for r in found] == [bytes([65 + i]) * 5000 for i in range(3)]
    sizes = [len(warc.gzip_member(m)) for m in made]
    assert [r.offset for r in found] == [0, sizes[0], sizes[0] + sizes[1]]


def test_broken_archives_are_told():
    good = warc.record_bytes(1, "u", b"payload", None, False)
    with pytest.raises(warc.BrokenArchive, match="digest"):
        warc.read_bytes(warc.gzip_member(good.replace(b"payload", b"PAYLOAD")))
    with pytest.raises(warc.BrokenArchive, match="length"):
        warc.read_bytes(warc.gzip_member(good + b"more"))
    with pytest.raises(warc.BrokenArchive, match="cut off"):
        warc.read_bytes(warc.gzip_member(good)[:-3])
    with pytest.raises(warc.BrokenArchive, match="header"):
        warc.read_bytes(warc.gzip_member(b"no record"))
    with pytest.raises(zlib.error):
        warc.read_bytes(b"no gzip at all")
    assert warc.read_bytes(b"") == []


def test_repeated_rows_ties_and_empty_table(spark, tmp_path):
    rows = [(1, "same"), (3, "same"), (3, "same"), (2, "same")]
    manifest = warc.write_archives(pages(spark, rows), str(tmp_path / "w"))
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()]
    assert sorted(got, key=str) == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None),
                                    (3, "response", None)]
    none = warc.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert none.collect() == [] and warc.read_archives(none).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    out = queries.op7_warc(spark, sf).collect()
    assert sorted(map(tuple, out), key=str) == expected(rows)
