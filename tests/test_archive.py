"""Payload archives: splits at any byte, growing files, offsets, odd lines."""

import gzip
import io
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from meadowlark.operators.storage import scratch
from meadowlark.sources import archive, feeds


def line(feed, source, body, **more):
    return json.dumps({"feed": feed, "source_id": source, "body": body, **more})


def meetings(*names):
    return json.dumps([{"id": k, "name": x, "start_on": "2026-01-02", "venue_country": "GBR"} for k, x in enumerate(names)])


@given(st.lists(st.binary(max_size=6).map(lambda x: x.replace(b"\n", b"")), max_size=8), st.booleans(), st.lists(st.integers(0, 60), max_size=4))
def test_every_line_is_read_once_whatever_the_borders(texts, ended, cuts):
    data = b"\n".join(texts) + (b"\n" if ended else b"")
    borders = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    for last in (True, False):
        got = [x for a, b in zip(borders, borders[1:]) for x in archive.lines_of(io.BytesIO(data), a, b, last and b == len(data))]
        lines = data.split(b"\n")
        assert [x for x in got if x] == [x for x in (lines if last else lines[:-1]) if x]


def test_long_lines_and_small_reads(monkeypatch):
    monkeypatch.setattr(archive, "CHUNK", 7)
    monkeypatch.setattr(archive, "STEP", 5)
    data = b"a" * 100 + b"\n" + b"b" * 3 + b"\n" + b"c" * 50
    for split in (1, 2, 10, 33, 200):
        got = [x for p in archive.ranges_of("f", 0, len(data), split, True) for x in archive.lines_of(io.BytesIO(data), p.start, p.end, p.last)]
        assert [x for x in got if x] == data.split(b"\n")


def test_odd_lines_have_no_rows(spark, tmp_path):
    lines = ["", "no json", "[1]", "7", line("x", 1, None), line("x", 1, 5), line("x", "7", "a"), line(None, 2**70, "b", url=3), line("x", 3, "c\nü\ud800", url="u", extra={"body": 1}), line("x", True, "")]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode() + b"\n\xff\xfe\n")
    (tmp_path / "_hidden").write_text(line("x", 9, "no"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl.gz").write_bytes(gzip.compress((line("y", 4, "d") + "\n" + line("x", 5, "e")).encode()))
    spark.dataSource.register(archive.Payloads)

    def load(path=tmp_path, **options):
        return spark.read.format("payloads").options(**options).load(str(path))

    want = {("x", None, None, "a"), (None, None, None, "b"), ("x", 3, "u", "c\nü?"), ("x", None, None, ""), ("y", 4, None, "d"), ("x", 5, None, "e")}
    for split in (37, 100, 1 << 20):
        got = [tuple(r) for r in load(splitbytes=split).collect()]
        assert len(got) == 6 and set(got) == want
    assert {r.source_id for r in load(feed="x").collect()} == {None, 3, 5}
    assert load(tmp_path / "a.jsonl").count() == 4


def test_empty_archives_and_wrong_options(spark, tmp_path):
    spark.dataSource.register(archive.Payloads)
    df = spark.read.format("payloads")
    assert df.load(str(tmp_path)).count() == 0
    (tmp_path / "a").write_text("")
    assert df.load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        df.load(str(tmp_path / "none")).count()
    with pytest.raises(Exception, match="splitbytes"):
        df.option("splitbytes", "0").load(str(tmp_path)).count()
    with pytest.raises(KeyError):
        feeds.archived(spark, "nothing", str(tmp_path))


def test_batches_of_rows_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "BATCH", 100)
    (tmp_path / "a").write_text("\n".join(line("x", k, "b" * 40) for k in range(10)))
    ranges = archive.ranges_of("a", 0, (tmp_path / "a").stat().st_size, 1 << 20, True)
    assert [b.num_rows for b in archive.read_ranges(str(tmp_path), ranges, None)] == [3, 3, 3, 1]


def test_small_files_share_a_task():
    found = archive.tasks((archive.Range(str(k), 0, n, True) for k, n in enumerate([5, 5, 5, 20, 10, 1])), 10)
    assert [[r.name for r in p.ranges] for p in found] == [["0", "1"], ["2"], ["3"], ["4"], ["5"]]
    assert archive.tasks([], 10) == [archive.Part([])]


def follow(spark, path, base, split=50):
    rows = feeds.archived(spark, "meetings_api", str(path), stream=True, split=split).select("name")
    rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    return sorted(r.name for r in spark.read.schema("name string").parquet(f"{base}/rows").collect())


def test_a_stream_follows_files_that_grow(spark, tmp_path):
    base, first, second = scratch(spark, "follow"), tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    half = line("meetings_api", 1, meetings("C"))
    first.write_text(line("meetings_api", 1, meetings("A", "B")) + "\n" + line("rss", 1, "<item>") + "\n" + half[:20])
    assert follow(spark, tmp_path, base) == ["A", "B"]
    assert follow(spark, tmp_path, base) == ["A", "B"]  # nothing new
    with first.open("a") as f:
        f.write(half[20:] + "\n")
    second.write_text(line("meetings_api", 2, meetings("D")) + "\n")
    assert follow(spark, tmp_path, base) == ["A", "B", "C", "D"]
    second.unlink()  # read and taken away
    with first.open("a") as f:
        f.write(line("meetings_api", 1, meetings("E")) + "\n")
    (tmp_path / "c.gz").write_bytes(gzip.compress(line("meetings_api", 1, meetings("F")).encode()))
    assert follow(spark, tmp_path, base) == ["A", "B", "C", "D", "E", "F"]
    first.write_text("")
    with pytest.raises(Exception, match="written anew"):
        follow(spark, tmp_path, base)


def test_ranges_of_a_batch_don_t_change_as_a_file_grows(tmp_path):
    path = tmp_path / "a"
    path.write_text("".join(line("x", k, "b" * k) + "\n" for k in range(20)))
    stream = archive.ArchiveStream(str(tmp_path), None, 64)
    end = stream.latestOffset()

    def read():
        return [r for p in stream.partitions({"a": 100}, end) for b in stream.read(p) for r in b.to_pylist()]

    before = read()
    with path.open("a") as f:
        f.write(line("x", 99, "new") + "\n")
    assert read() == before and 10 < len(before) < 20
