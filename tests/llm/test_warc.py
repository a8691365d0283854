import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymill.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, length int"


def round_trip(spark, tmp_path, rows, range_bytes=warc.RANGE_BYTES):
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(3), folder)
    return folder, sorted(warc.read_archives(spark, f"file://{folder}", range_bytes).collect(), key=repr)


@pytest.mark.parametrize("range_bytes", [64, 1000, 10**7])
def test_every_record_is_read_once_whatever_the_ranges(spark, tmp_path, range_bytes):
    texts = [f"<p>é {i % 17} 100%</p>" * (i % 40) for i in range(200)]
    rows = [(i, f"http://h/{i}?a=%20 b", t) for i, t in enumerate(texts)]
    _, found = round_trip(spark, tmp_path, rows, range_bytes)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == len(by_id) == 200
    for i, t in enumerate(texts):
        data, r = t.encode(), by_id[i]
        revisit = len(data) >= 100 and first[t] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[t]) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data) and r["url"] == f"http://h/{i}?a=%20 b"


def test_archives_are_plain_gzip(spark, tmp_path):
    folder, _ = round_trip(spark, tmp_path, [(i, None, "x" * i) for i in range(5)])
    content = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder).glob("part-*"))
    assert content.count(b"WARC/1.0\r\n") == 5


def test_magic_inside_a_record_starts_none(spark, tmp_path):
    text = "\x1f\u008b\x08" * 3 + "WARC/1.0\r\n\r\n\r\n"
    _, found = round_trip(spark, tmp_path, [(1, "u\r\nv", text)], 50)
    assert [(r["payload"], r["url"]) for r in found] == [(text.encode(), "u\r\nv")]


def test_odd_rows(spark, tmp_path):
    long = "y" * 3_000_000
    rows = [(None, None, None), (1, "a", ""), (1, "a", ""), (None, "b", "z" * 200), (3, "b", "z" * 200), (2, "c", long)]
    rows += [(5, "d", long), (5, "d", long), (2, "c", long)]
    _, found = round_trip(spark, tmp_path, rows, 100)
    kinds = sorted((repr(r["page_id"]), r["record_type"], repr(r["refers_to"])) for r in found)
    assert kinds == sorted(
        [("None", "response", "None"), ("1", "response", "None"), ("1", "response", "None")]
        + [("None", "revisit", "3"), ("3", "response", "None"), ("2", "response", "None"), ("2", "response", "None")]
        + [("5", "revisit", "2")] * 2
    )


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, [])[1] == []


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    folder, _ = round_trip(spark, tmp_path, [(1, "u", "".join(chr(97 + i * i % 26) for i in range(5000)))])
    part = next(p for p in Path(folder).glob("part-*") if p.stat().st_size)
    data = part.read_bytes()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside the record|damaged record"):
        warc.read_archives(spark, f"file://{cut}").agg(F.count("*")).collect()


def test_ranges_are_dealt_out_to_a_task_per_so_many_bytes(spark, tmp_path):
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 20) for i in range(400)]
    folder, found = round_trip(spark, tmp_path, rows)
    total = sum(p.stat().st_size for p in Path(folder).glob("part-*"))
    read = warc.read_archives(spark, f"file://{folder}", 500, 2000).select("page_id", F.spark_partition_id().alias("task"))
    tasks = {r["task"] for r in read.collect()}
    assert read.rdd.getNumPartitions() == -(-total // 2000) and len(tasks) > 0.8 * total / 2000
    assert len(found) == read.count() == 400


def test_a_long_record_is_read_in_one_piece(spark, tmp_path):
    import random

    text = random.Random(1).randbytes(16_000_000).hex()
    _, found = round_trip(spark, tmp_path, [(1, "u", text), (2, "u", "b")])
    assert sorted((r["page_id"], r["payload"]) for r in found) == [(1, text.encode()), (2, b"b")]
