from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators.snapshot_diff import SnapshotIndex, snapshot_changes, snapshot_records
from corpusloom.operators.snapshots import parse_series, series_files, shown_dates, snapshot_plan, span_signatures


def plain_plan(files: dict[str, list[str] | None]):
    """rel -> keys in date order -> {(rel, i): (owner, [dates] or None)}; a None file has no chunks."""
    out, before = {}, {}
    for rel, keys in sorted(files.items()):
        date = rel[-13:-3]
        if not keys:
            before = {}
            continue
        free = {k: list(v) for k, v in before.items()}
        before = {}
        for i, k in enumerate(keys):
            if free.get(k):
                owner = free[k].pop(0)
                out[owner][1].append(date)
                out[(rel, i)] = (owner, None)
            else:
                owner = (rel, i)
                out[owner] = (owner, [])
            before.setdefault(k, []).append(owner)
    return out


def test_plan_equals_the_queue_rules(spark):
    rnd = random.Random(3)
    want, chunks, rels = {}, [], []
    for s in range(60):
        files = {}
        for d in range(rnd.randrange(3, 9)):
            rel = f"dir/s{s}-2026-01-{d + 10:02d}.md"
            files[rel] = [rnd.choice("abc") for _ in range(rnd.randrange(0, 5))]
            rels.append((rel,))
            chunks += [(rel, i, k) for i, k in enumerate(files[rel])]
        want |= plain_plan(files)
    series = series_files(spark.createDataFrame(rels, "rel string"))
    got = {}
    for r in snapshot_plan(series, spark.createDataFrame(chunks, "rel string, chunk_index int, key string")).collect():
        got[(r["rel"], r["chunk_index"])] = ((r["owner_rel"], r["owner_index"]), r["repeat_dates"])
        assert r["is_kept"] == (r["repeat_dates"] is not None)
    assert got == want


def test_series_names(spark):
    names = {
        "Bots/fleet-2026-07-23.md": ("Bots/fleet", "2026-07-23"), "fleet-2026-99-99": ("fleet", "2026-99-99"), "2026-07-23 note.md": (None, None),
        "a-2026-01-01.tar.md": (None, None), "a-b-2026-01-01-2026-01-02.md": ("a-b-2026-01-01", "2026-01-02"), "x.y/b-2026-01-01": ("x.y/b", "2026-01-01"), "-2026-01-01.md": (None, None),
    }
    df = spark.createDataFrame([(n,) for n in names], "rel string")
    s, d = parse_series(F.col("rel"))
    assert {r[0]: (r[1], r[2]) for r in df.select("rel", s, d).collect()} == names
    two = spark.createDataFrame([("a-2026-01-01.md",), ("a-2026-01-02.md",)], "rel string")
    assert series_files(two).count() == 0


def test_shown_dates(spark):
    df = spark.createDataFrame([(None,), ([],), (["a", "b"],), ([f"d{i:03d}" for i in range(200)],)], "d array<string>")
    assert [r[0] for r in df.select(shown_dates(F.col("d"))).collect()] == ["", "", "a,b", "d000..d199 (200 snapshots)"]


def test_signatures_only_for_repeats(spark):
    plan = spark.createDataFrame([("r", 2, ["x"]), ("r", 10, ["y", "z"]), ("s", 0, []), ("s", 1, None)], "rel string, chunk_index int, repeat_dates array<string>")
    import hashlib

    assert [tuple(r) for r in span_signatures(plan).collect()] == [("r", hashlib.sha256(b"2:x|10:y,z").hexdigest()[:16])]


DDL = "rel string, snapshot_date string, heading string, chunk_index int, text string, delivered_at timestamp_ntz, series int"


def plain_changes(snapshots: dict[str, dict[str, dict[str, str]]]):
    out = set()
    for s, days in snapshots.items():
        order = sorted(days)
        for a, b in zip(order, order[1:]):
            for k in days[a].keys() | days[b].keys():
                if k not in days[a]:
                    out.add((s, b, k, "added"))
                elif k not in days[b]:
                    out.add((s, b, k, "removed"))
                elif days[a][k] != days[b][k]:
                    out.add((s, b, k, "changed"))
    return out


def _table(spark, snapshots):
    import datetime as dt

    at = dt.datetime(2026, 1, 1)
    rows = [(f"{s}-{d}.md", d, k or None, i, t, at, 7) for s, days in snapshots.items() for d, keys in days.items() for i, (k, t) in enumerate(keys.items())]
    return spark.createDataFrame(rows, DDL)


@settings(max_examples=4, deadline=None)
@given(st.dictionaries(st.sampled_from(["d/x", "y"]), st.dictionaries(st.sampled_from(["2026-01-01", "2026-01-09", "2026-99-99", "2027-01-01"]), st.dictionaries(st.sampled_from(["", "A", "B", "C"]), st.sampled_from(["1", "2"]), min_size=1)), min_size=1))
def test_changes_equal_plain_comparison(spark, snapshots):
    got = {tuple(r) for r in snapshot_changes(_table(spark, snapshots)).collect()}
    assert got == plain_changes(snapshots)


def test_changes_on_dirty_rows(spark, rows):
    import datetime as dt

    early, late = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    data = [
        ("s-2026-01-01.md", "2026-01-01", None, 0, "a\r\nb", early, 1),
        ("s-2026-01-02.md", "2026-01-02", "", 5, "a\nb", late, 1),
        ("s-2026-01-02.md", "2026-01-02", "", 5, "a\nb", late, 1),
        ("s-2026-01-02.md", "2026-01-02", "X", 1, "old delivery", early, 1),
        ("s-2026-01-03.md", "2026-01-03", "", 0, None, None, 1),
        ("n.md", None, "H", 0, "no snapshot", early, 1),
        (None, "2026-01-01", "H", 0, "no rel", early, 1),
    ]
    got = rows(snapshot_changes(spark.createDataFrame(data, DDL)))
    assert got == [("s", "2026-01-03", "", "changed")]
    assert snapshot_changes(spark.createDataFrame([], DDL)).count() == 0


def test_index_goes_on_from_what_it_holds(spark, rows, tmp_path):
    one = {"s": {"2026-01-01": {"A": "1", "B": "1"}}}
    two = {"s": {"2026-01-02": {"A": "2", "C": "3"}, "2026-01-01": {"A": "9"}}}
    path = f"file://{tmp_path}/index"
    assert rows(SnapshotIndex(spark, path).apply(snapshot_records(_table(spark, one)))) == []
    index = SnapshotIndex(spark, path)
    got = rows(index.apply(snapshot_records(_table(spark, two)), with_values=True))
    assert got == [
        ("s", "2026-01-02", "A", "changed", "1", "2"), ("s", "2026-01-02", "B", "removed", "1", None), ("s", "2026-01-02", "C", "added", None, "3"),
    ]
    assert rows(index.late.select("snapshot_date", "key")) == [("2026-01-01", "A")]
    assert rows(index.index().select("key", "snapshot_date")) == [("A", "2026-01-02"), ("C", "2026-01-02")]


def test_deliveries_one_by_one_give_what_all_at_once_give(spark, rows, tmp_path):
    """Also where a series is spread over several buckets; after the first delivery all changes come from the stored index."""
    days = {f"2026-01-0{d}": {f"k{i}": str(i * d % 3) for i in range(12) if (i + d) % 4} for d in range(1, 5)}
    days["2026-01-03"] = {"k1": "z"}
    snapshots = {"a": days, "b": {"2026-01-02": {"A": "1"}}}
    at_once = SnapshotIndex(spark, f"file://{tmp_path}/once", buckets=6, bucket_records=3)
    assert {tuple(r) for r in at_once.apply(snapshot_records(_table(spark, snapshots))).collect()} == plain_changes(snapshots)
    got = set()
    for d in sorted(days):
        index = SnapshotIndex(spark, f"file://{tmp_path}/steps", buckets=6, bucket_records=3)
        before = dict(index._state["buckets"])
        one = {s: {d: x[d]} for s, x in snapshots.items() if d in x}
        got |= {tuple(r) for r in index.apply(snapshot_records(_table(spark, one))).collect()}
        assert index.changes.where("not stored and change_kind <> 'added'").isEmpty()
        touched = {b for b, p in index._state["buckets"].items() if before.get(b) != p}
        assert d != "2026-01-01" or touched  # later deliveries of one series leave other buckets where they are
    assert got == plain_changes(snapshots)
    assert rows(at_once.index().select("series", "key", "hash")) == rows(index.index().select("series", "key", "hash"))
