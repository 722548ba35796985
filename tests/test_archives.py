"""Archive index: chunks, restart, change, damage, against one plain pass over the archives."""

import io
import os
import tarfile

import pytest

from affinityloom.sources import archives as AR


def tar(path, members):
    with tarfile.open(path, "w") as out:
        for name, size in members:
            info = tarfile.TarInfo(name)
            info.size = size
            out.addfile(info, io.BytesIO(b"x" * size))


def model(k, size=700):
    return f"models/AF-p{k}-F1-model_v{k % 3}.pdb.gz", size


LONG = ("d" * 140 + "/AF-q1-F1-model_v6.cif", 5)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    root.mkdir()
    tar(root / "a.tar", [model(1), ("notes.txt", 3), model(2, 0), model(3, 512), LONG, ("AF-model_v1", 4), ("AF--model_v1", 4)])
    tar(root / "b.tar", [model(k) for k in range(10, 15)])
    tar(root / "none.tar", [])
    return root


def rows(spark, target):
    return sorted((os.path.basename(r.archive), r.member, r.key, r.header, r.size_bytes) for r in AR.archive_members(spark, target).collect())


def plain(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        with tarfile.open(folder / name) as archive:
            out += [(name, m.name, AR.model_accession(m.name), m.offset, m.size) for m in archive if m.isfile() and AR.model_accession(m.name)]
    return sorted(out)


def states(progress):
    return {os.path.basename(r.archive): (r.status, r.chunks, r.indexed, r.total) for r in progress.collect()}


def test_chunks_and_restart_give_the_index_of_one_run(spark, folder, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert AR.archive_progress(spark, parts) is None
    AR.index_archives(spark, str(folder), whole)
    assert rows(spark, whole) == plain(folder)
    first = AR.index_archives(spark, str(folder), parts, chunk=2)
    assert states(first) == {"a.tar": ("partial", 1, 2, 2), "b.tar": ("partial", 1, 2, 2), "none.tar": ("completed", 1, 0, 0)}
    assert all(r.next_byte > 0 for r in first.filter("status = 'partial'").collect())
    second = states(AR.index_archives(spark, str(folder), parts, chunk=2))
    assert second["b.tar"] == ("partial", 2, 2, 4) and second["none.tar"] == ("completed", 1, 0, 0)
    AR.index_archives(spark, str(folder), parts, chunk=2)
    last = states(AR.index_archives(spark, str(folder), parts, chunk=2))
    assert {s[0] for s in last.values()} == {"completed"} and last["a.tar"][3] == 4 and last["b.tar"][3] == 5
    assert rows(spark, parts) == rows(spark, whole)


def test_finished_archives_are_skipped_changed_ones_start_again(spark, folder, tmp_path):
    target = str(tmp_path / "log")
    AR.index_archives(spark, str(folder), target)
    before = states(AR.index_archives(spark, str(folder), target))
    assert before["b.tar"] == ("completed", 1, 5, 5)
    tar(folder / "b.tar", [model(20)])
    tar(folder / "c.tar", [model(30)])
    after = states(AR.index_archives(spark, str(folder), target))
    assert after["b.tar"] == ("completed", 1, 1, 1) and after["c.tar"] == ("completed", 1, 1, 1) and after["a.tar"] == before["a.tar"]
    assert rows(spark, target) == plain(folder)
    AR.index_archives(spark, str(folder), target, force=True)
    assert rows(spark, target) == plain(folder)


def test_a_run_that_lost_a_file_is_taken_up(spark, folder, tmp_path):
    target = str(tmp_path / "log")
    AR.index_archives(spark, str(folder), target, tasks=50)
    lost = [r.f for r in spark.read.parquet(target).filter("archive LIKE '%b.tar'").selectExpr("_metadata.file_path AS f").distinct().collect()]
    for f in lost:
        os.remove(f.replace("file://", "").replace("file:", "").replace("%20", " "))
    AR.index_archives(spark, str(folder), target)
    assert rows(spark, target) == plain(folder)


def test_damaged_archives_say_so_and_keep_what_is_whole(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    tar(root / "cut.tar", [model(1), model(2, 5000)])
    os.truncate(root / "cut.tar", 4000)
    (root / "noise.tar").write_bytes(b"no archive at all" * 100)
    tar(root / "mid.tar", [model(1), model(2)])
    with open(root / "mid.tar", "r+b") as f:
        f.seek(1536)
        f.write(b"z" * 512)
    target = str(tmp_path / "log")
    got = states(AR.index_archives(spark, str(root), target))
    assert {k: (v[0], v[3]) for k, v in got.items()} == {"cut.tar": ("damaged", 1), "noise.tar": ("damaged", 0), "mid.tar": ("damaged", 1)}
    assert [r[1] for r in rows(spark, target)] == [model(1)[0]] * 2


def test_lookup_keeps_the_last_member_of_a_name(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    tar(root / "a.tar", [model(1, 10), model(1, 20), LONG])
    AR.index_archives(spark, str(root), str(tmp_path / "log"))
    got = sorted(tuple(r) for r in AR.model_lookup(AR.archive_members(spark, str(tmp_path / "log"))).collect())
    assert got == [("P1", "AF-p1-F1-model_v1", model(1)[0], 20, "v1"), ("Q1", "AF-q1-F1-model_v6", LONG[0], 5, "v6")]


def test_member_names():
    assert [AR.model_accession(n) for n in ("x/AF-a1-F1-model_v4.pdb", "AF-a1-model_v1", "AF-a1-F1.pdb", "af-a1-F1-model_v1", "AF-model_v1-x")] == [
        "A1", "A1", None, None, "MODEL_V1"]


def test_stale_inputs(spark):
    from affinityloom.sources.scans import stale_inputs
    inputs = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5), ("e", None), (None, 1)], "id string, t int")
    outputs = spark.createDataFrame([("a", 5, True), ("a", 1, True), ("b", 4, True), ("c", 9, False), ("d", 9, None), ("e", 9, True), (None, 9, True)], "id string, t int, ok boolean")
    assert sorted(r.id or "" for r in stale_inputs(inputs, outputs, ["id"], "t", "ok").collect()) == ["", "b", "c", "d", "e"]
    assert stale_inputs(inputs, outputs.limit(0), ["id"], "t", "ok").count() == 6
