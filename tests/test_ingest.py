from __future__ import annotations

import json
import os
import socket
import subprocess
import sys
import time
from datetime import datetime, timezone

import pytest

from corpusloom.cli import main
from corpusloom.config import Config
from corpusloom.lock import LockHeld, WriterLock
from corpusloom.operators.embed import HashEmbedder
from corpusloom.operators.ingest import ingest
from corpusloom.operators.store import ChunkStore
from corpusloom.sources.files import corpus_files




def _write(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def _ids(store, *columns):
    return sorted(tuple(r) for r in store.table().select("id", *columns).collect())


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    return root


@pytest.fixture
def open_store(spark, tmp_path):
    return lambda **k: ChunkStore(spark, str(tmp_path / "db"), "knowledge", HashEmbedder(**({"dim": 16} | k)), buckets=4)


def test_source_reads_names_that_spark_would_leave_out(spark, corpus):
    _write(corpus, {"_a.md": "x", ".b.md": "x", "_d/c.MARKDOWN": "x", "x[1].md": "x", "sp ace%20.md": "x", ".md": "x", "n.txt": "x", "Routines/Wikilink Scanner.md": "x", "k/é.md": b"\xff"})
    got = {r["rel"]: r["content"] for r in corpus_files(spark, str(corpus)).collect()}
    assert set(got) == {"_a.md", ".b.md", "_d/c.MARKDOWN", "x[1].md", "sp ace%20.md", "k/é.md"} and got["k/é.md"] == b"\xff"
    assert corpus_files(spark, str(corpus), exclude=()).count() == 7


def test_incremental_life(spark, corpus, open_store):
    _write(corpus, {"cats.md": "# Cats\nCats purr.", "dogs.md": "# Dogs\n## Behaviour\n" + "Dogs bark. " * 300, "empty.md": "\n \n", "bad.md": b"\xff\xfe", "head.md": "# only\n## heads"})
    first = ingest(spark, str(corpus), open_store())
    assert (first.files_seen, first.files_ingested, first.files_skipped, first.incremental) == (5, 2, 3, False)
    before = _ids(open_store(), "text")
    assert len(before) == first.chunks_added == 5

    again = ingest(spark, str(corpus), open_store())
    assert (again.files_unchanged, again.files_ingested, again.chunks_added, again.chunks_deleted, again.incremental) == (2, 0, 0, 0, True)
    assert _ids(open_store(), "text") == before

    _write(corpus, {"cats.md": "# Cats\r\nCats purr.", "dogs.md": "# Dogs\nshort now", "new.md": "fresh"})
    third = ingest(spark, str(corpus), open_store())
    assert (third.files_unchanged, third.files_ingested, third.chunks_added, third.chunks_deleted) == (1, 2, 2, 3)
    os.rename(corpus / "new.md", corpus / "moved.md")
    (corpus / "cats.md").unlink()
    fourth = ingest(spark, str(corpus), open_store())
    assert (fourth.chunks_added, fourth.chunks_deleted) == (1, 2)
    assert [i for i, in _ids(open_store())] == ["dogs.md::0", "moved.md::0"]


def test_untrusted_manifests_mean_a_rebuild_without_leftovers(spark, corpus, open_store, tmp_path):
    _write(corpus, {"a.md": "one two", "b.md": "three"})
    ingest(spark, str(corpus), open_store())
    (corpus / "b.md").unlink()
    assert ingest(spark, str(corpus), open_store(), max_chars=500).incremental is False
    assert [i for i, in _ids(open_store())] == ["a.md::0"]  # nothing of b.md is left behind
    assert ingest(spark, str(corpus), open_store(), max_chars=500).incremental is True
    assert ingest(spark, str(corpus), open_store(), max_chars=500, incremental=False).chunks_added == 1
    (tmp_path / "db" / "knowledge" / "CURRENT").write_text("{ not json")
    assert ingest(spark, str(corpus), open_store()).chunks_added == 1
    with pytest.raises(NotADirectoryError):
        ingest(spark, str(corpus / "nowhere"), open_store())
    assert len(_ids(open_store())) == 1


def test_unreadable_files_can_be_kept(spark, corpus, open_store):
    _write(corpus, {"a.md": "one", "b.md": "two"})
    ingest(spark, str(corpus), open_store())
    _write(corpus, {"b.md": b"\xff"})
    ingest(spark, str(corpus), open_store(), keep_unreadable=True)
    assert len(_ids(open_store())) == 2
    assert ingest(spark, str(corpus), open_store()).chunks_deleted == 1


def _day(n, state):
    return f"---\ndate: {n}\n---\n# Fleet\n\n## RED\n\n{state}\n\n## Notes\n\nnothing\n"


def test_snapshot_series_collapse_and_stay_citable(spark, corpus, open_store):
    days = [f"2026-07-{d}" for d in range(17, 22)]
    _write(corpus, {f"Bots/fleet-{d}.md": _day(d, "alpha is red") for d in days})
    report = ingest(spark, str(corpus), open_store())
    assert report.chunks_deduped == 8
    red = [r for r in open_store().table().collect() if r["heading"] == "RED"]
    assert [(r["source"], r["snapshot_date"], r["repeat_count"], r["repeat_dates"]) for r in red] == [("Bots/fleet-2026-07-17.md", days[0], 5, ",".join(days[1:]))]

    _write(corpus, {"Bots/fleet-2026-07-22.md": _day("2026-07-22", "alpha is red")})
    grown = ingest(spark, str(corpus), open_store())
    assert (grown.chunks_added, grown.files_unchanged) == (1, 5)
    red = [r["repeat_count"] for r in open_store().table().collect() if r["heading"] == "RED"]
    assert red == [6]  # metadata alone was rewritten

    back = ingest(spark, str(corpus), open_store(), dedupe_snapshots=False)
    assert back.chunks_deduped == 0 and back.chunks_added == 10
    assert {r["repeat_dates"] for r in open_store().table().collect()} == {None}  # no stale dates
    assert ingest(spark, str(corpus), open_store(), dedupe_snapshots=False).chunks_added == 0


def test_a_series_below_three_files_loses_its_dates(spark, corpus, open_store):
    for d in ("01", "02", "03"):
        _write(corpus, {f"r-2026-01-{d}.md": f"day {d}"})
    ingest(spark, str(corpus), open_store())
    (corpus / "r-2026-01-03.md").unlink()
    ingest(spark, str(corpus), open_store())
    assert _ids(open_store(), "snapshot_date") == [("r-2026-01-01.md::0", None), ("r-2026-01-02.md::0", None)]


def test_lock(tmp_path):
    path = str(tmp_path / "db")
    with WriterLock(path) as lock:
        assert lock.live_holder()["pid"] == os.getpid()
        code = f"from corpusloom.lock import *\ntry: WriterLock({path!r}).acquire()\nexcept LockHeld: print('held')"
        assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__))).stdout.strip() == "held"
    assert not os.path.exists(path + ".lock")

    def left(**changes):
        base = {"pid": os.getppid(), "acquired": datetime.now(timezone.utc).isoformat(), "host": socket.gethostname()}
        with open(path + ".lock", "w") as f:
            json.dump(base | changes, f)

    left()
    with pytest.raises(LockHeld):
        WriterLock(path).acquire()
    left(host="elsewhere", pid=2**22 + 1)  # a dead number here says nothing about another host
    with pytest.raises(LockHeld):
        WriterLock(path).acquire()
    for stale in ({"pid": 2**22 + 1}, {"acquired": "2020-01-01T00:00:00+00:00"}, {"acquired": None}, {"pid": "x"}):
        left(**stale)
        WriterLock(path).acquire().release()
    open(path + ".lock", "w").write("")
    lock = WriterLock(path).acquire()
    left()
    lock.release()
    assert os.path.exists(path + ".lock")  # another's lock stays


def test_cli(spark, corpus, tmp_path, capsys):
    _write(corpus, {"dogs.md": "# Dogs\nDogs bark loudly.", "skip/x.md": "left out"})
    db = str(tmp_path / "clidb")
    assert main(["ingest", str(corpus), "--db", db, "--quiet", "--exclude", "skip/"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["files_seen"], report["chunks_added"], report["store_count"]) == (1, 1, 1)
    assert main(["ingest", str(corpus), "--db", db, "--clean", "--quiet"], spark) == 0
    assert json.loads(capsys.readouterr().out)["store_count"] == 2
    assert main(["query", "bark", "--db", db, "--corpus", str(corpus)], spark) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["citation"]["heading"] == "Dogs"
    with open(db + ".lock", "w") as f:
        json.dump({"pid": os.getppid(), "acquired": datetime.now(timezone.utc).isoformat(), "host": socket.gethostname()}, f)
    assert main(["ingest", str(corpus), "--db", db, "--clean"], spark) == 3
    assert os.path.isdir(db)
    with pytest.raises(SystemExit) as e:
        main(["ingest"], spark)
    assert e.value.code == 2


def test_config():
    with pytest.raises(ValueError, match="CORPUS_ROOT"):
        Config.from_env({})
    with pytest.raises(ValueError, match="no such"):
        Config.from_env({"CORPUSLOOM_CORPUS_ROOT": "/a", "CORPUSLOOM_DB_PATH": "/b", "CORPUSLOOM_EMBEDDER": "no such"})
    assert Config.from_env({"CORPUSLOOM_CORPUS_ROOT": "/a", "CORPUSLOOM_DB_PATH": "/b"}).collection == "knowledge"


def test_ticks(spark, corpus, open_store, tmp_path):
    from corpusloom.streaming.ticks import ingest_on_ticks

    _write(corpus, {"a.md": "one"})
    seen = []
    query = ingest_on_ticks(spark, str(corpus), open_store(), every="1 second", checkpoint=str(tmp_path / "ticks"), report=seen.append)
    end = time.time() + 90
    while not seen and time.time() < end and query.isActive:
        time.sleep(0.5)
    query.stop()
    assert seen and seen[0].chunks_added == 1
