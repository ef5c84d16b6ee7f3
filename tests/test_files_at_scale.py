"""Files written one per row, containers read range by range, and ends of logs."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwright.sources import container, filewriter, files, logends, sinks


def texts_below(folder):
    return {name: (folder / name).read_text() for name in sorted(os.listdir(folder))}


def outputs(spark, rows, folder, whole_name=False):
    return sinks.text_outputs(spark.createDataFrame(rows, "path string, text string"), str(folder), whole_name)


def test_inputs_of_one_stem_keep_both_texts(spark, tmp_path):
    sinks.write_texts(outputs(spark, [("/in/a.png", "one"), ("/in/a.jpg", "two"), ("/other/a.jpg", "three"), ("/in/b.png", None)], tmp_path), str(tmp_path))
    found = texts_below(tmp_path)
    assert sorted(found.values()) == ["", "one", "three", "two"] and found["a.txt"] == "two"
    assert all(name.startswith("a.") and name.endswith(".txt") for name in found if name not in ("b.txt",))


def test_older_files_are_replaced_and_others_stay(spark, tmp_path):
    (tmp_path / "a.txt").write_text("older")
    (tmp_path / "z.txt").write_text("stays")
    for _ in range(2):
        sinks.write_texts(outputs(spark, [("/in/a.wav", "new\nlines é"), ("/in/a.wav", "new\nlines é")], tmp_path), str(tmp_path))
    assert texts_below(tmp_path) == {"a.txt": "new\nlines é", "z.txt": "stays"}


def test_a_failed_job_leaves_no_temporary_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/ok.txt", b"x"), (f"{tmp_path}/ok.txt/below.txt", b"y")], "output_path string, content binary").coalesce(1)
    with pytest.raises(Exception):
        filewriter.write_files(rows, str(tmp_path))
    assert texts_below(tmp_path) in ({"ok.txt": "x"}, {})
    with pytest.raises(Exception):
        rows.select("content").write.format(filewriter.NAME).mode("append").option("path", str(tmp_path)).save()


def test_documents_of_jobs(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", '{"x":1}'), ("c", '{"y":2}')], "uid string, jsonld string")
    sinks.jsonld(rows, f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ['{"x":1}', '{"y":2}']
    sinks.jsonld_files(rows, f"{tmp_path}/files")
    assert texts_below(tmp_path / "files") == {"a_b.jsonld": '{"x":1}', "c.jsonld": '{"y":2}'}


def archive(path, contents, prefix=b"<meta/>", wide=False):
    """A container; with ``wide`` its directory is in the ZIP64 form."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", allowZip64=True) as z:
        for k, (name, data) in enumerate(contents.items()):
            if wide:
                info = zipfile.ZipInfo(name)
                with z.open(info, "w", force_zip64=True) as out:
                    out.write(data)
            else:
                z.writestr(name, data, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    path.write_bytes(prefix + held.getvalue())


def contents_of(n):
    rnd = random.Random(n)
    return {f"a/{k % 3}/f{k}.bin": rnd.randbytes(k * 37) * (k % 4) for k in range(n)} | {"empty/": b"", "top é.txt": b"x" * 3_000_000}


@pytest.mark.parametrize("wide", [False, True])
def test_containers_in_many_ranges(spark, tmp_path, monkeypatch, wide):
    contents = contents_of(23)
    if wide:
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)  # so that the archive has the wide end record
    archive(tmp_path / "one.ufdr", contents, wide=wide)
    archive(tmp_path / "two.UFDR", {"z.txt": b"zz"}, prefix=b"")
    (tmp_path / "other.zip").write_bytes(b"no container")
    tree = container.read(spark, str(tmp_path), range_entries=4)
    rows = {(os.path.basename(r.container), r.path): r for r in tree.collect()}
    files = {p: bytes(r.content) for (c, p), r in rows.items() if c == "one.ufdr" and not r.is_dir}
    assert files == {"/metadata.xml": b"<meta/>"} | {"/" + n: d for n, d in contents.items() if not n.endswith("/")}
    assert {p for (c, p), r in rows.items() if c == "one.ufdr" and r.is_dir} == {"/", "/a", "/a/0", "/a/1", "/a/2", "/empty"}
    assert all(r.size == len(r.content) for r in rows.values() if not r.is_dir)
    assert bytes(rows["two.UFDR", "/z.txt"].content) == b"zz" and rows["two.UFDR", "/metadata.xml"].size == 0
    assert container._scan(spark, str(tmp_path), range_entries=4).rdd.getNumPartitions() == 8  # seven ranges and one
    assert {(r.name, r.is_dir) for r in container.children(tree.where(F.col("container").endswith("one.ufdr")), "/").collect()} == {("a", True), ("empty", True), ("metadata.xml", False), ("top é.txt", False)}


def test_many_small_containers_share_tasks(spark, tmp_path, monkeypatch):
    """Directories are read by tasks and ranges share them; before, the driver opened every container, and each had a task."""
    for k in range(30):
        archive(tmp_path / f"_c{k}.ufdr", {"a.txt": b"a" * k, "b/c.txt": b"b"})
    monkeypatch.setattr(container, "SPREAD", 4)
    monkeypatch.setattr(container, "TASK_CONTAINERS", 10)
    ranges = container._planned(spark, str(tmp_path))
    assert ranges.count() == 30 and ranges.rdd.getNumPartitions() == 4
    tree = container.read(spark, str(tmp_path))
    assert tree.where("NOT is_dir").count() == 90 and tree.where("is_dir").count() == 60
    assert tree.where("path = '/a.txt'").agg(F.sum("size")).first()[0] == sum(range(30))
    assert container._planned(spark, str(tmp_path), entry="/b/c.txt").agg(F.sum("count")).first()[0] == 30
    assert container.read_range(spark, str(tmp_path), "/metadata.xml", 1, 4).where("data = X'6D657461'").count() == 30
    assert container.read_range(spark, str(tmp_path), "/none", 1, 4).count() == 0


def test_one_entry_costs_its_own_bytes(tmp_path):
    contents = contents_of(40) | {"large.bin": random.Random(1).randbytes(4_000_000)}
    archive(tmp_path / "one.ufdr", contents)

    class Counted(io.FileIO):
        read_bytes = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.read_bytes += len(data)
            return data

    with Counted(tmp_path / "one.ufdr") as file:
        at, count, base = container._directory(file, os.path.getsize(tmp_path / "one.ufdr"))
        entries = [e for _, e in container._entries(file, at, count, base)]
        Counted.read_bytes = 0
        small = next(e for e in entries if e.path == "/a/1/f13.bin")
        assert container._bytes(file, small) == contents["a/1/f13.bin"]
        assert Counted.read_bytes < 2000
        for path, begin, length in (("/large.bin", 1_000_000, 50), ("/top é.txt", 2_999_990, 100), ("/a/1/f13.bin", 5, 3)):
            entry = next(e for e in entries if e.path == path)
            assert container._bytes(file, entry, begin, length) == contents[path[1:]][begin : begin + length]


def test_broken_containers(spark, tmp_path):
    assert container.read(spark, f"{tmp_path}/none").collect() == []
    archive(tmp_path / "one.ufdr", {"a.txt": b"abc" * 100, "b.txt": b"def" * 100})
    data = bytearray((tmp_path / "one.ufdr").read_bytes())
    data[data.index(b"abcabc") + 4] ^= 1  # a stored entry whose checksum no longer fits
    (tmp_path / "one.ufdr").write_bytes(data)
    rows = {r.path: r.content for r in container.read(spark, str(tmp_path)).where("NOT is_dir").collect()}
    assert rows["/a.txt"] is None and bytes(rows["/b.txt"]) == b"def" * 100
    assert bytes(container.read_range(spark, str(tmp_path), "/b.txt", 1, 4).first().data) == b"efde"
    (tmp_path / "two.ufdr").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="no archive"):
        container.read(spark, str(tmp_path)).collect()


def test_ends_of_logs_read_few_bytes(spark, tmp_path):
    lines = [f"line {i} é" for i in range(200_000)]
    (tmp_path / "large.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "open.log").write_text("a\r\nb")
    (tmp_path / "empty.log").write_text("")
    first, last = logends.head(spark, str(tmp_path), 3).collect(), logends.tail(spark, str(tmp_path), 1000).collect()
    of = lambda rows, name: [r.line for r in sorted(rows, key=lambda r: r.n) if r.path.endswith(name)]
    assert of(first, "large.log") == lines[:3] and of(last, "large.log") == lines[-1000:]
    assert of(first, "open.log") == of(last, "open.log") == ["a", "b"] and not of(last, "empty.log")
    assert max(r.bytes_read for r in first + last) <= 2 * logends.BLOCK < os.path.getsize(tmp_path / "large.log") / 10
    assert [r.line for r in logends.tail(spark, str(tmp_path), 1).collect() if r.path.endswith("large.log")] == lines[-1:]


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver knows no file of a listing; hidden files are left out at any depth, and contents come in several tasks."""
    monkeypatch.setattr(files, "TASK_FILES", 3)
    for k in range(10):
        (tmp_path / f"d{k % 2}" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{k % 2}" / "deep" / f"f{k}.txt").write_text("x" * k)
        (tmp_path / f"t {k}%.txt").write_text("é" * k)
    for name in (".hidden.txt", "_hidden.txt"):
        (tmp_path / name).write_text("no")
    top, deep = files.listing(spark, str(tmp_path)), files.listing(spark, str(tmp_path), (".txt",), recursive=True, content=True)
    assert top.inputFiles() == deep.inputFiles() == []
    assert sorted(r.name for r in top.collect()) == [f"t {k}%.txt" for k in range(10)]
    rows = deep.collect()
    assert deep.rdd.getNumPartitions() == 7 and len(rows) == 20 and len({r.path for r in rows}) == 20
    assert all(r.length == len(r.content) == os.path.getsize(r.path) and abs(r.modified.timestamp() - os.path.getmtime(r.path)) < 86400 for r in rows)


def test_folders_of_a_level_are_listed_by_several_tasks(spark, tmp_path, monkeypatch):
    """Folders of a level are dealt to tasks; before, the task that listed the top listed all of them."""
    for k in range(9):
        (tmp_path / f"part_{k}").mkdir()
        (tmp_path / f"part_{k}" / f"f{k}.txt").write_text("x")
    seen = []
    monkeypatch.setattr(files, "materialise", lambda df, f=files.materialise: seen.append(df.rdd.getNumPartitions()) or f(df))
    found = files.listing(spark, str(tmp_path), recursive=True)
    assert sorted(r.name for r in found.collect()) == [f"f{k}.txt" for k in range(9)]
    assert seen == [1, 9]


def test_short_texts_are_written_by_tasks_of_bounded_numbers(spark, tmp_path, monkeypatch):
    """Texts are dealt to tasks by number, whatever their bytes, and to folders below the chosen one."""
    monkeypatch.setattr(filewriter, "TASK_FILES", 10)
    seen = []
    monkeypatch.setattr(filewriter, "write_files", lambda rows, folder, f=filewriter.write_files: seen.append(rows.rdd.getNumPartitions()) or f(rows, folder))
    rows = spark.range(95).select(F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".png")).alias("path"), F.lit("x").alias("text"))
    below = F.concat(F.lit("d"), F.regexp_extract("path", r"(\d)\.png", 1))
    sinks.write_texts(sinks.text_outputs(rows, str(tmp_path), whole_name=False, below=below), str(tmp_path))
    assert seen == [10]
    assert sorted(os.listdir(tmp_path)) == [f"d{k}" for k in range(10)]
    assert sum(len(os.listdir(tmp_path / f"d{k}")) for k in range(10)) == 95 and (tmp_path / "d4" / "94.txt").read_text() == "x"
