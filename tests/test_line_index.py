"""Line numbers of text files against a plain reading of the files."""

import os

import pytest
from pyspark.errors import PySparkException

from qlift.sources import line_index as LI


@pytest.fixture
def folder(tmp_path):
    files = {
        "a/one.txt": b"".join(b"one %d%s\n" % (i, b" x" * (i % 40)) for i in range(3000)),
        "a/two.txt": b"\n\n\nlast has no end",
        "b/empty.txt": b"",
        "b/windows.txt": b"first\r\n\r\nthird\r\n" + b"".join(b"%d\r\n" % i for i in range(2000)),
        "b/blank.txt": b"\n" * 500,
        "c/é space%20.txt": "é😀\nzweite".encode(),
        "d/a[1]{x}.txt": b"in brackets\n",
    }
    for name, data in files.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = []
    for name in sorted(files, key=lambda n: n.replace(" ", "%20").encode("utf-8")):
        lines = files[name].decode().replace("\r\n", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want += [(os.path.basename(name), i, t) for i, t in enumerate(lines)]
    return str(tmp_path), want


@pytest.fixture(params=[300, 4096, 1 << 27])
def split_bytes(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _name(path):
    from urllib.parse import unquote

    return os.path.basename(unquote(path))


def test_every_line_has_its_number(spark, folder, split_bytes):
    root, want = folder
    got = LI.number_lines(spark, root)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "ShuffleExchange" not in plan.replace("BroadcastExchange", "")
    assert sorted((_name(r.file), r.line_no, r.line) for r in got.collect()) == sorted(want)
    if split_bytes == 300:
        assert LI.split_index(LI._scan(spark, root)).count() > 100


@pytest.mark.parametrize("start,limit", [(0, -1), (0, 10), (2990, 3010), (3003, 3004), (6000, 5), (100_000, -1)])
def test_ranges(spark, folder, start, limit):
    root, want = folder
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        index = LI.file_index(spark, root).checkpoint()
        expected = [(i, *w) for i, w in enumerate(want) if start <= i and (limit <= 0 or i < limit)]
        for given in (index, None):
            got = LI.line_range(spark, root, start, limit, given)
            assert sorted((r.idx, _name(r.file), r.line_no, r.line) for r in got.collect()) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_index_beyond_the_broadcast_bound_is_joined_by_shuffle(spark, folder, monkeypatch):
    root, want = folder
    monkeypatch.setattr(LI, "BROADCAST_SPLITS", 0)
    monkeypatch.setattr(LI, "MOST_FILES", 0)
    got = LI.line_range(spark, root, 5, 2000, LI.file_index(spark, root))
    assert sorted((r.idx, r.line) for r in got.collect()) == [(i, w[2]) for i, w in enumerate(want) if 5 <= i < 2000]


def test_changed_splits_are_loud(spark, folder):
    root, _ = folder
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        splits = LI.split_index(LI._scan(spark, root))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        with pytest.raises(PySparkException, match="SplitsChanged"):
            LI._numbered(LI._scan(spark, root), splits).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
