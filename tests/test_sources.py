"""Indexes in buckets and versions: who wins, what is rewritten, what readers see."""

import threading

import pytest
from weftline.sources import files
from weftline.sources.manifest import BucketIndex
from weftline.sources.versions import VersionedTable

ROW = "id long, hash string, text string"


def content(df):
    return sorted(tuple(r) for r in df.select("id", "hash").collect())


def test_only_one_of_many_creates(spark, tmp_path):
    for n in range(15):
        won: list = []
        go = threading.Barrier(6)

        def run(i, n=n, won=won, go=go):
            go.wait()
            if files.create_once(spark, str(tmp_path / f"m/{n}"), f"writer {i} " * 500):
                won.append(i)

        threads = [threading.Thread(target=run, args=(i,)) for i in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and files.read_text(spark, str(tmp_path / f"m/{n}")) == f"writer {won[0]} " * 500
    assert files.names(spark, str(tmp_path / "m")) == sorted(str(n) for n in range(15))
    assert files.names(spark, str(tmp_path / "absent")) == []


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    index = BucketIndex(spark, str(tmp_path / "i"), buckets=128)
    base = [(i, f"h{i}", "t") for i in range(2000)]
    assert index.merge(spark.createDataFrame(base, ROW)) == 1
    changes = [(i, "new", "u", False) for i in range(0, 2000, 200)] + [(7, "", "", True), (99_999, "", "", True), (5000, "h", "t", None), (3, "h3", "t", False)]
    assert index.merge(spark.createDataFrame(changes, ROW + ", gone boolean"), deleted="gone") == 2
    expected = {i: h for i, h, _ in base} | {i: "new" for i in range(0, 2000, 200)} | {5000: "h"}
    del expected[7]
    assert dict(content(index.read())) == expected and content(index.read(1)) == sorted((i, h) for i, h, _ in base)
    one, two = index.manifest(1)["buckets"], index.manifest(2)["buckets"]
    moved = {b for b in two if two[b] != one.get(b)}
    real = spark.createDataFrame([(i,) for i in [*range(0, 2000, 200), 7, 5000]], "id long")
    assert moved == {str(r[0]) for r in real.select(index.bucket()).distinct().collect()} and len(moved) <= 12
    assert all(two[b]["since"] == 2 for b in moved) and all(own["since"] == 1 for b, own in two.items() if b not in moved)
    # what changes nothing makes no version
    assert index.merge(spark.createDataFrame(changes[:3], ROW + ", gone boolean"), deleted="gone") == 2
    assert {(r["id"], r["action"]) for r in index.diff(1, 2).collect()} == {(i, "update") for i in range(0, 2000, 200)} | {(7, "delete"), (5000, "insert")}
    assert content(index.lookup([5000, 7, 1, 400])) == [(1, "h1"), (400, "new"), (5000, "h")]
    assert index.rollback(1) == 3 and content(index.read()) == content(index.read(1))
    assert index.vacuum(keep_last=1) == 1 and index.versions() == [3] and content(index.read()) == sorted((i, h) for i, h, _ in base)


def test_two_writers_lose_nothing(spark, tmp_path):
    index = BucketIndex(spark, str(tmp_path / "i"), buckets=4)
    index.merge(spark.createDataFrame([(i, "a", "t") for i in range(20)], ROW))
    got: list = []

    def write(k):
        own = BucketIndex(spark, str(tmp_path / "i"), buckets=4)
        got.append(own.merge(spark.createDataFrame([(i, f"w{k}", "t") for i in range(k, 20, 3)], ROW)))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [2, 3, 4] and content(index.read()) == [(i, f"w{i % 3}") for i in range(20)]
    assert [index.manifest(v)["parent"] for v in (2, 3, 4)] == [1, 2, 3]


def test_a_stale_manifest_is_refused(spark, tmp_path):
    index = BucketIndex(spark, str(tmp_path / "i"))
    index.merge(spark.createDataFrame([(1, "a", "t")], ROW))
    stale = index.manifest() | {"version": 2}
    index.merge(spark.createDataFrame([(2, "b", "t")], ROW))
    assert not index._publish(stale) and content(index.read()) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_small_indexes(spark, tmp_path, rows):
    index = BucketIndex(spark, str(tmp_path / "i"))
    assert not index.exists() and index.merge(spark.createDataFrame(rows, ROW)) == 1
    assert content(index.read()) == [r[:2] for r in rows] and index.merge(spark.createDataFrame(rows, ROW)) == 1


def test_versions_never_share_a_number(spark, tmp_path):
    got: list = []
    threads = [threading.Thread(target=lambda k=k: got.append((VersionedTable(spark, str(tmp_path / "v")).write(spark.createDataFrame([(k,)], "k int")), k))) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = VersionedTable(spark, str(tmp_path / "v"))
    assert sorted(v for v, _ in got) == [1, 2, 3] and all(table.read(v).first()[0] == k for v, k in got)
    table.point(2)
    assert table.current() == 2 and table.latest() == 3
