"""Snapshots of real directories: hard links, reuse, archives, removal, verification, changes."""

import io
import os
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from snaptide import catalog
from snaptide.functions import digests
from snaptide.plans import compare, transfer
from snaptide.plans.pipeline import Engine, stages, tokens
from snaptide.sources import scan
from snaptide.sources.ingest import snapshot


def put(path, data, at=1_500_000_000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (at, at))


def jpeg(date=b"2018:07:22 08:14:41\0"):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x132, 2, len(date), 26) + struct.pack("<I", 0) + date
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 48, 64, 0) + b"\xff\xda\0\2data\xff\xd9"


def counts(spark, cat):
    return {r.table_name: r.n for r in catalog.report(catalog.load(spark, cat)).collect()}


def test_hard_links_share_content_and_inode(spark, tmp_path):
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    put(root / "a.txt", b"hello")
    os.link(root / "a.txt", root / "aa.txt")
    put(root / "empty.txt", b"")
    snapshot(spark, str(root), cat)
    rows = {r.filename: r for r in catalog.wide(catalog.load(spark, cat)).collect()}
    assert {r.reference_inode for n, r in rows.items() if n != "empty.txt"} == {1}
    assert rows["empty.txt"].content_id is None and rows["empty.txt"].reference_inode is None
    assert counts(spark, cat)["file_content"] == 1 and rows["a.txt"].file_size == 5


def test_second_run_reuses_and_removal_restores(spark, tmp_path):
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    put(root / "image1.jpg", jpeg())
    one = snapshot(spark, str(root), cat)
    before = counts(spark, cat)
    put(root / "sub" / "image2.jpg", jpeg())
    two = snapshot(spark, str(root), cat)
    after = counts(spark, cat)
    assert (one, two) == (1, 2) and after["file_content"] == 1 and after["file_meta"] == 1
    assert after["file_location"] == before["file_location"] + 2 and after["file_path"] == before["file_path"] + 1
    t = catalog.load(spark, cat)
    left = {r.table_name: r.n for r in catalog.report(catalog.removed(t, two)).collect()}
    assert left == before
    gone = {r.table_name: r.n for r in catalog.report(catalog.removed(t, 1, 2)).collect()}
    assert set(gone.values()) == {0}
    w = catalog.wide(t).filter("run_id = 2 and filename = 'image2.jpg'").first()
    assert (w.img_width, w.img_height) == (64, 48) and str(w.img_exif_original_date) == "2018-07-22 08:14:41"
    plan = compare.exif_plan(catalog.wide(t).filter("run_id = 2")).collect()
    assert len(plan) == 2


def test_verify(spark, tmp_path):
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    for name in ("ok", "date", "size", "hash", "gone"):
        put(root / name, name.encode() + b"x" * 5000)
    put(root / "void", b"")
    snapshot(spark, str(root), cat)
    os.utime(root / "date", (1_500_000_010, 1_500_000_010))
    put(root / "size", b"x" * 4000)
    put(root / "hash", b"\0" * 5004)
    (root / "gone").unlink()
    live = scan.listed(spark, str(root)).filter("filename is not null")
    live = live.join(scan.stream_digests(live, str(root)), ["rel", "filename"])
    live = live.select("rel", "filename", F.col("size").alias("live_size"), F.timestamp_millis(F.floor(F.col("modified_ns") / 1_000_000)).alias("live_modified"), F.col("hash").alias("live_hash"), F.col("hash_begin").alias("live_begin"))
    names = catalog.wide(catalog.load(spark, cat)).select("id", "filename")
    want = {"ok": "ok", "void": "ok", "date": "date differs", "size": "size differs", "hash": "hash differs", "gone": "missing"}
    for mode in ("full", "begin"):
        got = compare.verified(catalog.wide(catalog.load(spark, cat)), live, mode).join(names, "id")
        assert {r.filename: r.outcome for r in got.collect()} == want


def test_backup_and_sync_evolution(spark, tmp_path):
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    for name, data in (("file1", b"content1"), ("file2", b"content2"), ("file2Copy", b"content2"), ("file3", b"content3")):
        put(root / name, data)
    snapshot(spark, str(root), cat)
    put(root / "file1", b"content11", 1_500_000_100)
    (root / "subdir").mkdir()
    (root / "file2").rename(root / "subdir" / "file2_.txt")
    (root / "file3").unlink()
    snapshot(spark, str(root), cat)
    w = catalog.wide(catalog.load(spark, cat))
    new, old = w.filter("run_id = 2"), w.filter("run_id = 1")
    got = {r.filename: r.change for r in transfer.changes(new, old).collect()}
    assert got == {"file1": "changed", "file2_.txt": "renamed+moved", "file3": "deleted", "file2Copy": "unchanged"}
    sync = sorted(r.change for r in transfer.sync_plan(new, old).collect())
    assert sync == ["changed", "deleted", "deleted", "new"]
    plan = {r.path: r.action for r in transfer.backup_plan(new, [old]).collect()}
    assert plan == {"/file1": "copy", "/subdir/file2_.txt": "link", "/file2Copy": "link"}


def test_archives_are_read_and_damage_is_reported(spark, tmp_path):
    root = tmp_path / "d"
    root.mkdir()
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("in/one.txt", "one")
        z.writestr("two.txt", "two!")
    buffer = io.BytesIO(b"three")
    with tarfile.open(root / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("deep/three.txt")
        info.size = 5
        t.addfile(info, buffer)
    put(root / "c.7z", b"not read here")
    put(root / "d.txt", b"plain")
    found = scan.contents(spark, str(root))
    members = scan.archive_members(found)
    rows = {(r.rel, r.filename): r for r in members.collect()}
    assert rows[("/a.zip/in/", "one.txt")].content == b"one" and rows[("/b.tar.gz/deep/", "three.txt")].size == 5
    assert rows[("/", "c.7z")].failure
    total = scan.scan_totals(found, members).first()
    assert total.files == 5 and total.bytes == 3 + 4 + 5 + 13 + 5
    cat = str(tmp_path / "cat")
    snapshot(spark, str(root), cat)
    assert catalog.wide(catalog.load(spark, cat)).filter("in_archive").count() == 3


def test_only_what_is_selected_and_new_is_read(spark, tmp_path, monkeypatch):
    """Archives outside the includes, or excluded, give no members; hidden names do; known archives keep theirs."""
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    for where in ("keep/a.zip", "skipme/b.zip", "keep/_under/c.zip", "keep/.dot/d.zip"):
        (root / where).parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(root / where, "w") as z:
            z.writestr("in.txt", where)
    put(root / "keep" / "_pic.jpg", jpeg())
    run = snapshot(spark, str(root), cat, includes=("keep",))
    w = catalog.wide(catalog.load(spark, cat))
    inside = lambda n: sorted(r.rel for r in w.filter(f"in_archive and run_id = {n}").collect())
    assert inside(run) == ["/keep/.dot/d.zip/", "/keep/_under/c.zip/", "/keep/a.zip/"]
    assert w.filter("filename = '_pic.jpg' and img_width = 64").count() == 1
    opened = []
    real = scan.archive_members
    monkeypatch.setattr(scan, "archive_members", lambda archives, path: opened.append(archives.count()) or real(archives, path))
    again = snapshot(spark, str(root), cat, includes=("keep",))
    w = catalog.wide(catalog.load(spark, cat))
    assert opened == [0] and inside(again) == inside(run) and counts(spark, cat)["file_content"] == 7 + 0
    with pytest.raises(ValueError, match="nowhere"):
        snapshot(spark, str(root), cat, includes=("keep", "nowhere"))


def test_what_cannot_be_read_is_left_out_and_marks_the_run(spark, tmp_path, monkeypatch):
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    put(root / "a.txt", b"one")
    put(root / "gone.txt", b"two")
    real = scan.listed

    def vanishing(*args):
        out = real(*args).persist()
        out.count()
        (root / "gone.txt").unlink(missing_ok=True)
        return out

    monkeypatch.setattr(scan, "listed", vanishing)
    snapshot(spark, str(root), cat)
    t = catalog.load(spark, cat)
    assert [r.filename for r in catalog.wide(t).collect()] == ["a.txt"] and t["index_run"].first().failure_occurred
    live = spark.createDataFrame([("/", "gone.txt"), ("/", "a.txt")], "rel string, filename string")
    assert {r.filename: bool(r.failure) for r in scan.stream_digests(live, str(root)).collect()} == {"gone.txt": True, "a.txt": False}
    assert {r.filename: r.first_begin is None for r in scan.stream_begins(live, str(root)).collect()} == {"gone.txt": True, "a.txt": False}


def test_renames_go_round_names_that_are_taken(spark):
    names = ["a.jpg", "b.jpg", "c.jpg", "20240101_100000_2.jpg", "20240101_100000_4.jpg", "20240101_100000.png"]
    rows = [(i, 1, "/", n, n[-3:]) for i, n in enumerate(names)]
    at = F.to_timestamp(F.lit("2024-01-01 10:00:00"))
    files = spark.createDataFrame(rows, "id bigint, run_id bigint, rel string, filename string, extension string").withColumns({"modified": at, "img_exif_original_date": at})
    assert {r.id: r.new_name for r in compare.rename_plan(files).collect()} == {0: "20240101_100000.jpg", 1: "20240101_100000_3.jpg", 2: "20240101_100000_5.jpg"}


def test_the_largest_picture_is_taken_whole():
    small, large = jpeg(), jpeg()[:-2] + b"\xff\xd9"
    thumb = small + b"\0\0"
    app = b"\xff\xe1" + struct.pack(">H", len(thumb) + 2) + thumb
    pad = b"\xff\xe2" + struct.pack(">H", 65_002) + b"\0" * 65_000
    picture = b"\xff\xd8" + app + pad * 5 + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 400, 600, 0) + b"\xff\xda\0\2data\xff\xd9"
    assert scan.largest_jpeg(b"raw" + large + picture + b"tail") == picture and scan.largest_jpeg(b"raw\xff\xd8\xff\xe1") is None


@pytest.mark.parametrize("size", [0, 1, 511, 512, 1023, 1024, 3071, 3072, (1 << 20) - 1, 1 << 20, (1 << 20) + 1])
def test_digests_of_bytes_and_streams_agree(spark, tmp_path, size):
    data = bytes(i * 7 % 251 for i in range(size))
    f = tmp_path / "f"
    f.write_bytes(data)
    df = spark.createDataFrame([(data,)], "content binary")
    r = scan.digested(df).first()
    assert scan.stream_digest(str(f)) == (r["hash"], r["hash_begin"], r["hash_end"])
    if size >= 1024:
        n, skip = 0, 0
        while skip + 512 * 2**n <= size // 2:
            skip, n = skip + 512 * 2**n, n + 1
        assert len(r["hash_begin"].split(",")) == n
        few = scan.stream_digest(str(f), begin_only=True)[1]
        assert r["hash_begin"].startswith(few) and few.count(",") <= 10
    assert digests.FIRST_CHUNK == 512


def test_pipeline_runs_as_one_plan(spark, tmp_path):
    root, cat = tmp_path / "d", str(tmp_path / "cat")
    put(root / "ref" / "a.jpg", b"same")
    put(root / "more" / "b.jpg", b"same")
    put(root / "more" / "c.txt", b"same")
    put(root / "more" / "d.jpg", b"other")
    snapshot(spark, str(root), cat)
    e = Engine(catalog.load(spark, cat))
    got = e.run(f'findDuplicates {root}/ref {root}/more | filter "**.jpg" | print --folderOnly=no | delete')
    assert [r.filename for r in got.collect()] == ["b.jpg"]
    assert [r.file for r in e.plans["print"].collect()] == [f"{root}/more/b.jpg"]
    assert [r.action for r in e.plans["delete"].collect()] == ["delete"] and e.plans["deleteDirs"].count() == 0
    assert [r.filename for r in e.run(f"findFilesWithNoCopy {root}/more {root}/ref").collect()] == ["d.jpg"]
    assert e.run("filter x") is None
    assert [r.rel for r in e.run(f"listPaths {root}").collect()] == ["/more/", "/ref/"]
    listed = e.run("list").first()
    assert listed.files == 4 and listed.description.startswith("No. 1: ") and listed.description.endswith(f"{root}/  (files: 4)")
    moved = e.run(f"findFilesWithNoCopy {root}/more {root}/ref | move /MORE/ /kept/")
    assert moved.count() == 1 and e.plans["move"].first().destination == "/kept/d.jpg"
    e.run(f"findFilesWithNoCopy {root}/more {root}/ref | move /elsewhere/ /kept/")
    with pytest.raises(Exception, match="not below the base"):
        e.plans["move"].count()
    assert e.run("removeIndex 1").filter("n > 0").count() == 0


def test_backup_command_looks_at_all_backups(spark, tmp_path):
    src, dst, cat = tmp_path / "src", tmp_path / "dst", str(tmp_path / "cat")
    put(src / "a", b"one")
    put(src / "b", b"two")
    put(dst / "2024" / "a", b"one")
    put(dst / "2025" / "b", b"changed")
    for d, backup in ((src, False), (dst / "2024", True), (dst / "2025", True)):
        snapshot(spark, str(d), cat, is_backup=backup)
    e = Engine(catalog.load(spark, cat))
    assert {r.filename: r.change for r in e.run(f"backup {src} {dst}").collect()} == {"a": "new", "b": "changed"}
    assert {r.path: r.action for r in e.plans["backup"].collect()} == {"/a": "link", "/b": "copy"}
    assert e.plans["backupSpace"].first().needed_bytes == 3 and not e.plans["backupGate"].first().too_many
    assert e.plans["backupSpaceGate"].first().blocked in (True, False)
    assert [r.change for r in e.run(f"sync {src} {dst}/2025").orderBy("change").collect()] == ["changed", "new"]
    assert {r.change: r.files for r in e.plans["syncTotals"].collect()} == {"changed": 1, "new": 1} and e.plans["syncGate"].first().changed == 1


def test_words_and_stages():
    assert tokens('a "b c"  d | e') == ["a", '"b c"', "d", "|", "e"]
    assert stages(tokens("a b | c | d e")) == [["a", "b"], ["c"], ["d", "e"]]
    with pytest.raises(ValueError):
        stages(["a", "|"])


def test_failed_runs_lie_over_the_last_good_one(spark):
    run = spark.createDataFrame([(1, False, 10), (2, False, 20), (3, True, 30), (4, True, 40)], "id bigint, failure_occurred boolean, d int").select("id", "failure_occurred", F.timestamp_seconds("d").alias("run_date"))
    rows = [(10 * r + i, r, "/", f"f{i}") for r in (1, 2, 3, 4) for i in range(r)]
    files = spark.createDataFrame(rows, "id bigint, run_id bigint, rel string, filename string")
    got = {r.filename: r.run_id for r in catalog.previous_state(run, files).collect()}
    assert got == {"f0": 4, "f1": 4, "f2": 4, "f3": 4}
    got = {r.filename: r.run_id for r in catalog.previous_state(run.filter("id < 3"), files).collect()}
    assert got == {"f0": 2, "f1": 2}


def test_dropped_files_stream(spark, tmp_path):
    from snaptide.streaming.file_drop import collect_digests, dropped

    put(tmp_path / "in" / "a.txt", b"one")
    out = str(tmp_path / "out")
    for n in (1, 2):
        collect_digests(dropped(spark, str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == n
        put(tmp_path / "in" / "b.txt", b"two")


def test_an_old_catalogue_is_taken_over_once(spark, tmp_path):
    from snaptide.sources import legacy

    root, cat = tmp_path / "d", str(tmp_path / "cat")
    put(root / "a.txt", b"hello")
    snapshot(spark, str(root), cat)
    sha = "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d"  # of hello
    old = {
        "BackupRun": spark.createDataFrame([(1, "2000-01-02", 946_771_200), (2, "2000-01-03", 946_857_600)], "id bigint, pathPrefix string, backupDate bigint"),
        "BackupPath": spark.createDataFrame([(1, bytearray(b"docs")), (2, bytearray("\u00e4".encode("latin-1")))], "id bigint, path binary"),
        "FileContent": spark.createDataFrame([(1, 5, 946_684_800, sha), (2, 7, 946_684_800, "b" * 40), (3, 0, 946_684_800, "c" * 40)], "id bigint, fileSize bigint, modified bigint, sha1 string"),
        "FileLocation": spark.createDataFrame([(1, 1, 1, 1, bytearray(b"h.txt")), (2, 2, 1, 1, bytearray(b"b.bin")), (3, 2, 2, 1, bytearray(b"b2.bin")), (4, 3, 1, 2, bytearray(b"void")), (5, 1, 1, 1, bytearray(b"h.txt"))], "id bigint, fileContent_id bigint, backupPath_id bigint, backupRun_id bigint, filename binary"),
    }
    assert sorted(r.path for r in legacy.import_into(spark, cat, old).collect()) == ["/2000-01-02/", "/2000-01-03/"]
    assert legacy.import_into(spark, cat, old).count() == 0
    t = catalog.load(spark, cat)
    rows = {(r.rel, r.filename): r for r in catalog.wide(t).filter("is_backup").collect()}
    assert sorted(rows) == [("/docs/", "b.bin"), ("/docs/", "h.txt"), ("/docs/", "void"), ("/\u00e4/", "b2.bin")]
    assert t["file_content"].count() == 2 and rows[("/docs/", "void")].content_id is None
    assert rows[("/docs/", "h.txt")].content_id == catalog.wide(t).filter("filename = 'a.txt'").first().content_id
    assert rows[("/docs/", "b.bin")].reference_inode == rows[("/\u00e4/", "b2.bin")].reference_inode == 1
