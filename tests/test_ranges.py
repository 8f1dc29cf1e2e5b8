"""Reading by ranges of bytes, messages over edges of blocks, staged loads and the stream of a landing folder."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from threadloom.operators import ingest
from threadloom.schema import MESSAGES, RUNS
from threadloom.sources import export
from threadloom.sources.store import Conflict, Store

HEAD = "1/2/2024, 10:{:02d} - Ugo: {}"


def made(n, seed, ends=("\n",)):
    """n lines, some of them stray, empty or with accents."""
    rng = random.Random(seed)
    body = lambda: "".join(rng.choice("abcé è日😀 ") for _ in range(rng.randrange(30)))
    lines = [HEAD.format(k % 60, body()) if rng.random() < 0.3 else body().strip() for k in range(n)]
    return lines, "".join(x + rng.choice(ends) for x in lines)


@pytest.mark.parametrize("size", [101])
def test_lines_are_numbered_whatever_the_ranges(spark, tmp_path, size):
    for k, ends in enumerate((("\n",), ("\r\n",), ("\n", "\r\n"))):
        lines, text = made(40, k, ends)
        (tmp_path / f"f{k} 50%+.txt").write_bytes((b"\xef\xbb\xbf" if k else b"") + text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    whole = {(r.source_file, r.line_no): r for r in export.read_lines(spark, str(tmp_path)).collect()}
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = export.read_lines(spark, str(tmp_path)).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {(r.source_file, r.line_no): r for r in rows} == whole and len(rows) == len(whole)
    for k, ends in enumerate((("\n",), ("\r\n",), ("\n", "\r\n"))):
        own = sorted((r.line_no, r.value) for r in rows if r.source_file.endswith(f"/f{k} 50%+.txt"))
        assert own == list(enumerate(made(40, k, ends)[0], 1))
    assert len({r.file_hash for r in rows}) == 3


def test_bad_bytes_and_changed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\xff y\nz")
    (tmp_path / "b.txt").write_bytes(b"z\nx\xff y\n")
    rows = export.read_lines(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in rows) == ["x� y", "x� y", "z", "z"]
    assert len({r.file_hash for r in rows}) == 2  # the order counts


def plain(lines):
    """Messages by a loop: (first line, lines, text)."""
    out = []
    for n, line in enumerate(lines, 1):
        if line.startswith("1/2/2024, ") or not out:
            out.append([n, 0, []])
        out[-1][1] += 1
        out[-1][2].append(line)
    return sorted((n, c, "\n".join(t)) for n, c, t in out)


@pytest.mark.parametrize("block, stray", [(1, 0), (3, 25), (10, 25), (1000, 0)])
def test_messages_over_edges_of_blocks(spark, monkeypatch, block, stray):
    monkeypatch.setattr(export, "BLOCK", block)
    files = {}
    for f in ("one", "two"):
        files[f] = ["stray"] * stray + made(50, len(f) + ord(f[0]))[0] + ["long"] * 35 + [HEAD.format(1, "last")]
    files["none"] = ["no header"] * 12
    rows = [(f, "h", n, v) for f, lines in files.items() for n, v in enumerate(lines, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "source_file string, file_hash string, line_no long, value string")
    found = export.parse(df).select("source_file", "line_no", "n_lines", "raw_line").collect()
    for f, lines in files.items():
        assert sorted((r.line_no, r.n_lines, r.raw_line) for r in found if r.source_file == f) == plain(lines)
    assert export.parse(df.limit(0)).count() == 0


def test_a_chat_spreads_over_tasks(spark):
    """One shuffle of all lines, by file and block; the second is of lines on edges."""
    df = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 1).alias("source_file"), F.lit("h").alias("file_hash"), (F.col("id") + 1).alias("line_no"), F.lit("x").alias("value"))
    plan = export.parse(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_file" in plan and ", block" in plan
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("start" not in k for k in keys) and sum("block" in k for k in keys) >= 1


def write_chat(folder, name, minutes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(HEAD.format(m, f"m{m}") + "\n" for m in minutes), encoding="utf-8")


def said(archive):
    return sorted(r.text for r in archive.messages().collect())


def test_a_load_that_dies_between_its_writes_leaves_nothing(spark, tmp_path, monkeypatch):
    files, store = tmp_path / "files", str(tmp_path / "store")
    write_chat(files, "a.txt", range(5))
    archive, commit = ingest.Archive(spark, store), Store.commit

    def dies(self, version, content):
        if content.get("messages"):
            raise RuntimeError("lost")
        return commit(self, version, content)

    monkeypatch.setattr(Store, "commit", dies)
    with pytest.raises(RuntimeError):
        ingest.ingest(spark, str(files), store)
    assert archive.messages().count() == 0 and archive.runs().count() == 0
    assert [(x["status"], x["error"]) for x in archive.unfinished().values()] == [("failed", "RuntimeError: lost")]
    monkeypatch.setattr(Store, "commit", commit)
    done = ingest.ingest(spark, str(files), store).collect()
    assert [(r.inserted, r.skipped) for r in done] == [(5, 0)] and said(archive) == [f"m{m}" for m in range(5)]
    assert archive.tidy() == 3 and said(archive) == [f"m{m}" for m in range(5)]  # staged, messages and runs of the lost one
    assert ingest.ingest(spark, str(files), store).collect() == []


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    """The one that ends last must repeat: its messages might be in twice."""
    files, store = tmp_path / "files", str(tmp_path / "store")
    write_chat(files, "a.txt", range(5))
    ledger_of, inner = ingest.ledger_of, []

    def meanwhile(rows):
        if not inner:
            inner.append(1)
            ingest.ingest(spark, str(files), store)
        return ledger_of(rows)

    monkeypatch.setattr(ingest, "ledger_of", meanwhile)
    with pytest.raises(Conflict):
        ingest.ingest(spark, str(files), store)
    assert len(said(ingest.Archive(spark, store))) == 5
    assert ingest.ingest(spark, str(files), store).collect() == []


def test_stream_of_a_landing_folder(spark, tmp_path, monkeypatch):
    landing, store, point = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "point")
    archive, commit = ingest.Archive(spark, store), Store.commit
    run = lambda: ingest.follow(spark, str(landing), store, point, chat_id="c").awaitTermination()
    write_chat(landing, "a.txt", range(3))
    run()
    assert len(said(archive)) == 3
    write_chat(landing, "b.txt", range(2, 6))
    # Dies after its commit: the batch comes again and adds nothing.
    monkeypatch.setattr(Store, "delete", lambda self, name: 1 / 0)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.undo()
    assert len(said(archive)) == 6
    run()
    assert said(archive) == [f"m{m}" for m in range(6)] and archive.runs().count() == 2
    write_chat(landing, "c.txt", range(6, 8))
    monkeypatch.setattr(Store, "commit", lambda self, version, content: 1 / 0 if len(content.get("messages", [])) == 3 else commit(self, version, content))
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.undo()
    assert len(said(archive)) == 6
    run()
    assert said(archive) == [f"m{m}" for m in range(8)]
    assert archive.messages().schema == MESSAGES and archive.runs().schema == RUNS
