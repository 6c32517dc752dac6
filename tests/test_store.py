"""The store on disk: what is written is read, after every kind of maintenance, reopening and copying."""

import os
import pathlib
import random
import re
import threading
import time

import pyarrow.parquet as pq
import pytest

from tidelog import admin, errors, txn
from tidelog import store as store_module
from tidelog.operators import merge
from tidelog.stats import COUNTERS, Statistics
from tidelog.store import Store, StoreOptions, WriteBatch
from tidelog.streaming import tail


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def contents(store, cf=None):
    return dict(iter(store.iterator(cf)))


def test_put_get_delete_reopen(spark, path):
    s = Store.open(spark, path)
    s.put("a", "1")
    s.delete("a")
    s.put("b", "2")
    s.put(b"special\x00\x7f\x01", "z" * 70_000)
    s.put("e", "")
    assert s.get("a") is None and s.get("b") == b"2" and s.get("e") == b"" and s.get("nothing") is None
    before = s.snapshot()
    s.put("b", "3")
    assert (s.get("b"), s.get("b", snapshot=before)) == (b"3", b"2")
    s.flush()
    assert s.get("b") == b"3" and s.get_property("any.num-files-at-level0") == "1" and int(s.get_property("total-size")) > 0
    again = Store.open(spark, path)
    assert contents(again) == {b"b": b"3", b"e": b"", b"special\x00\x7f\x01": b"z" * 70_000}
    with pytest.raises(errors.InvalidArgument):
        Store.open(spark, path, StoreOptions(error_if_exists=True))
    with pytest.raises(errors.NotFound):
        Store.open(spark, path + "2", StoreOptions(create_if_missing=False))


def test_cursor_moves(spark, path):
    s = Store.open(spark, path)
    s.write(WriteBatch().put("a", "1").put("c", "3").put("e", "5").put("d", "4").delete("d"))
    s.flush()
    s.put("b", "2")
    it = s.iterator()
    seen = []
    it.seek_to_first()
    while it.valid():
        seen.append(it.key())
        it.next()
    assert seen == [b"a", b"b", b"c", b"e"]
    assert it.seek_to_last() and it.key() == b"e" and it.prev() and it.key() == b"c"
    assert it.seek("d") and it.key() == b"e" and it.seek_for_prev("d") and it.key() == b"c" and not it.seek("f") and not it.seek_for_prev("A")
    assert [bytes(r["user_key"]) for r in s.scan(start="b", end="e").collect()] == [b"b", b"c"]
    assert [bytes(r["user_key"]) for r in s.scan(prefix="c").collect()] == [b"c"]
    assert {bytes(r["user_key"]) for r in s.multi_get(["a", "d", "x", "e"]).collect()} == {b"a", b"e"}


def test_random_operations_equal_a_dict(spark, path):
    r, model = random.Random(4), {}
    s = Store.open(spark, path, StoreOptions(write_buffer_bytes=300))
    for step in range(8):
        batch = WriteBatch()
        for _ in range(25):
            k = f"k{r.randrange(40)}".encode()
            if r.random() < 0.3:
                batch.delete(k)
                model.pop(k, None)
            else:
                model[k] = str(r.random()).encode()
                batch.put(k, model[k])
        s.write(batch)
        if step == 5:
            s.compact_range()
            assert [len(s.level_files(n)) for n in range(7)] == [0] * 6 + [1]
            assert s.vacuum() > 0
    assert contents(s) == model == contents(Store.open(spark, path))


def test_cache(spark, path):
    s = Store.open(spark, path)
    s.put("a", "1")
    s.cache()
    assert contents(s) == {b"a": b"1"} and s.cache_stats()["hits"] == 1
    s.put("a", "2")
    assert contents(s) == {b"a": b"2"} and s.cache_stats()["reads"] == 2 and s.cache_stats()["hit_rate"] == 0.5
    assert contents(s) == {b"a": b"2"} and s.cache_stats()["reads"] == 2


def test_cache_bound(spark, path):
    """The least recently read family leaves; one that alone is too large is not kept."""
    s = Store.open(spark, path, StoreOptions(cache_bytes=2500), families=["one", "two", "big"])
    families = [s.column_family(n) for n in ("default", "one", "two", "big")]
    for f, size in zip(families, (1000, 1000, 1000, 9000), strict=True):
        s.put("k", "v" * size, f)
    for f in families[:2]:
        s.cache(f)
    contents(s)
    s.cache(families[2])
    assert [f.cf_id in s._cached for f in families] == [True, False, True, False] and s.cache_stats()["evictions"] == 1
    s.cache(families[3])
    assert [f.cf_id in s._cached for f in families] == [True, False, True, False] and s.cache_stats()["bytes"] <= 2500
    assert contents(s, families[3]) == {b"k": b"v" * 9000}
    s.clear_caches()
    assert s.cache_stats()["bytes"] == 0 == s.cache_stats()["readers"]


def test_opened_readers_are_kept(spark, path):
    s = Store.open(spark, path, StoreOptions(kept_readers=1))
    s.put("a", "1")
    s.flush()
    assert s.get("a") == s.get("a") == b"1" and s.cache_stats()["reader_rate"] == 0.5
    other = s.create_column_family("x")
    s.put("a", "2", other)
    s.flush()
    assert (s.get("a", other), s.get("a"), s.cache_stats()["readers"]) == (b"2", b"1", 1)


def test_snapshot_after_flush_and_compaction(spark, path):
    s = Store.open(spark, path, StoreOptions(merge_operator=merge.CounterMerge()))
    s.put("k", "1")
    s.merge("k", "4")
    s.put("gone", "9")
    first = s.snapshot()
    s.put("k", "20")
    s.delete("gone")
    second = s.snapshot()
    for change in (s.flush, lambda: s.put("k", "300"), s.compact_range, s.vacuum, lambda: s.delete("k"), s.compact_range, s.vacuum):
        change()
        assert (s.get("k", snapshot=first), s.get("gone", snapshot=first)) == (b"5", b"9")
        assert (s.get("k", snapshot=second), s.get("gone", snapshot=second)) == (b"20", None)
    assert {bytes(r["user_key"]) for r in s.scan(snapshot=first).collect()} == {b"k", b"gone"} and {bytes(r["user_key"]) for r in s.multi_get(["k", "gone"], snapshot=second).collect()} == {b"k"}
    assert contents(s) == {}
    del first, second
    s.vacuum()
    assert s.files.names(f"{path}/runs/cf_id=0") == [] or all(s.files.names(f"{path}/runs/cf_id=0/{n}") == [] for n in s.files.names(f"{path}/runs/cf_id=0"))


def test_old_commits_are_dropped(spark, path, monkeypatch):
    """A state is written every few commits; vacuum drops what lies before the last but one, and all go on from there."""
    monkeypatch.setattr(store_module, "STATE_EVERY", 3)
    s, slow = Store.open(spark, path), Store.open(spark, path)
    old = txn.OptimisticTransaction(slow)
    old.put("own", "1")
    for i in range(11):
        s.put(f"k{i}", str(i))
    s.vacuum()
    names = s.files.names(f"{path}/commits")
    assert sorted(n for n in names if n.startswith("s")) == [f"s{n:012d}.json" for n in (6, 9)] and min(n for n in names if n.startswith("c")) == f"c{7:012d}.json"
    assert len(contents(Store.open(spark, path))) == 11
    with pytest.raises(errors.Busy):
        old.commit()
    slow.refresh()
    slow.put("more", "1")
    assert len(contents(slow)) == 12


def test_damaged_commits_are_told(spark, path):
    s = Store.open(spark, path)
    s.put("a", "1")
    name = f"{path}/commits/c{1:012d}.json"
    with open(name) as f:
        text = f.read()
    with open(name, "w") as f:
        f.write(text[:-3] + "x" + text[-2:])
    crc = f"{path}/commits/.c{1:012d}.json.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(errors.Corruption):
        Store.open(spark, path)
    assert s.statistics.commit_syncs == s.statistics.commits == 1


@pytest.mark.parametrize("codec", ["none", "snappy", "lz4", "zstd"])
def test_codecs(spark, path, codec):
    s = Store.open(spark, path, StoreOptions(compression=codec))
    model = {f"k{i:04}".encode(): (b"AAAA" * 50 if i % 2 else f"Pattern_{i}_".encode() * 100) for i in range(60)}
    batch = WriteBatch()
    for k, v in model.items():
        batch.put(k, v)
    s.write(batch)
    s.compact_range()
    assert contents(Store.open(spark, path)) == model
    run = next(iter(s._state.runs.values()))
    found = pq.read_metadata(f"{run['path']}/{run['files'][0][0]}").row_group(0).column(0).compression.lower()
    assert found.startswith({"none": "uncompressed", "lz4": "lz4"}.get(codec, codec))


def test_unknown_codec(spark, path):
    with pytest.raises(errors.InvalidArgument):
        Store.open(spark, path, StoreOptions(compression="rot13"))


def test_write_stall(spark, path):
    """A full level 0 is compacted by the write that finds it, or the write waits and gives up."""
    s = Store.open(spark, path, StoreOptions(l0_stop=2, l0_trigger=99))
    for i in range(4):
        s.put(f"k{i}", "v")
        s.flush()
    assert s.statistics.waits >= 1 and len(s.level_files(0)) <= 2 and len(contents(s)) == 4
    idle = Store.open(spark, path, StoreOptions(l0_stop=1, auto_compact=False, stall_timeout_s=0.1))
    if not idle.stalled():
        idle.put("k9", "v")
        idle.flush()
    with pytest.raises(errors.Stalled):
        idle.put("x", "1")
    t = txn.OptimisticTransaction(idle)
    t.put("y", "1")
    with pytest.raises(errors.Stalled):
        t.commit()


def test_files_of_a_run_outside_a_range_are_left_out(spark, path):
    s = Store.open(spark, path)
    s.write_frame(spark.range(4000).selectExpr("concat('k', lpad(id, 6, '0')) AS user_key", "cast(id AS string) AS value").repartitionByRange(4, "user_key"))
    run = s.level_files(0)[0]
    assert len(run["files"]) == 4 and run["rows"] == 4000
    files = s._run_frame([run], b"k000010", b"k000020").inputFiles()
    assert len(files) == 1 and len(s._run_frame([run]).inputFiles()) == 4 and s.get("k003999") == b"3999"
    assert s.get("z") is None and s.statistics.rates()["left_out"] > 0
    scans = {"k0035": 100, "k": 4000, "k003999": 1, "z": 0, b"\xff": 0, "": 4000}
    assert all(s.scan(prefix=p).count() == n for p, n in scans.items()) and len(s.scan(prefix="k0035").inputFiles()) == 1


def test_column_families(spark, path):
    s = Store.open(spark, path, families=["one"])
    one, two = s.column_family("one"), s.create_column_family("two")
    s.put("k", "d")
    s.put("k", "1", one)
    s.put("k", "2", two)
    assert (s.get("k"), s.get("k", one), s.get("k", two)) == (b"d", b"1", b"2")
    s.flush()
    s.drop_column_family(one)
    three = s.create_column_family("three")
    assert three.cf_id == 3
    with pytest.raises(errors.InvalidArgument):
        s.put("k", "x", one)
    with pytest.raises(errors.InvalidArgument):
        s.create_column_family("two")
    with pytest.raises(errors.InvalidArgument):
        s.drop_column_family(s.column_family())
    with pytest.raises(errors.NotFound):
        s.drop_column_family(one)
    again = Store.open(spark, path)
    assert [c.name for c in again.column_families()] == ["default", "two", "three"] and again.get("k", two) == b"2"


def test_merge_store(spark, path):
    s = Store.open(spark, path, StoreOptions(merge_operator=merge.CounterMerge()))
    s.put("a", "10")
    s.merge("a", "5")
    s.flush()
    s.merge("a", "-2")
    assert s.get("a") == b"13"
    s.delete("a")
    s.merge("a", "5")
    s.flush()
    s.compact_range()
    assert s.get("a") == b"5"
    s.merge("a", "1")
    assert contents(s) == {b"a": b"6"}


def test_bulk_writes_and_compaction(spark, path):
    s = Store.open(spark, path, StoreOptions(compression="lz4"))
    for n in range(6):
        s.write_frame(spark.range(100).selectExpr("concat('k', lpad(id, 4, '0')) AS user_key", f"concat(id, '_{n}') AS value", "IF(id % 10 = 9, 0, 1) AS op", "id + 1 AS ordinal"))
    got = contents(s)
    assert len(got) == 90 and got[b"k0000"] == b"0_5"
    assert s.statistics.compactions >= 1 and len(s.level_files(0)) < 6 and s.manifest().count() == len(s._state.runs)


def test_two_writers(spark, path):
    a, b = Store.open(spark, path), Store.open(spark, path)
    a.put("k", "a")
    b.put("k", "b")
    a.refresh()
    assert a.get("k") == b"b"
    stores = [Store.open(spark, path) for _ in range(3)]
    threads = [threading.Thread(target=lambda s=s, i=i: [s.put(f"t{i}_{j}", "v") for j in range(4)]) for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    a.refresh()
    assert len(contents(a)) == 13


def test_checkpoint_backup_ingest(spark, path, tmp_path):
    s = Store.open(spark, path)
    s.put("a", "1")
    cf = s.create_column_family("x")
    s.put("a", "x", cf)
    admin.checkpoint(s, f"{path}-cp")
    s.put("a", "2")
    copy = Store.open(spark, f"{path}-cp")
    assert copy.get("a") == b"1" and copy.get("a", cf) == b"x"
    with pytest.raises(errors.InvalidArgument):
        admin.checkpoint(s, f"{path}-cp")
    engine = admin.BackupEngine(spark, f"{path}-bk")
    assert [engine.create(s), engine.create(s)] == [1, 2]
    restored = engine.restore(1, f"{path}-rs")
    assert restored.get("a") == b"2" and engine.catalog().count() == 2
    engine.delete(1)
    assert [b.backup_id for b in engine.list()] == [2]
    with pytest.raises(errors.NotFound):
        engine.info(1)
    ext = str(tmp_path / "ext")
    spark.createDataFrame([("a", "9"), ("b", "8")], "user_key string, value string").write.parquet(ext)
    info = admin.ingest(s, ext, move=True)
    assert s.vacuum() >= 0 and copy.get("a") == b"1"
    assert (info.n_entries, info.smallest, info.largest) == (2, b"a", b"b") and s.get("a") == b"9" and not s.files.exists(ext)
    spark.createDataFrame([("a", "1"), ("a", "2")], "user_key string, value string").write.parquet(ext)
    with pytest.raises(errors.Corruption):
        admin.ingest(s, ext)
    admin.export(s, f"{path}-ex")
    assert admin.ingest(copy, f"{path}-ex").n_entries == 2 and copy.get("a") == b"9"


def test_checkpoints_move_nothing_and_outlive_compactions(spark, path):
    s = Store.open(spark, path, StoreOptions(merge_operator=merge.CounterMerge()))
    s.put("a", "1")
    s.merge("a", "1")
    admin.checkpoint(s, f"{path}-one")
    one = Store.open(spark, f"{path}-one", StoreOptions(merge_operator=merge.CounterMerge()))
    assert s.files.names(f"{path}-one/runs") == [] and [r["path"] for r in one._state.runs.values()] == [r["path"] for r in s._state.runs.values()]
    admin.checkpoint(one, f"{path}-two")
    s.put("a", "50")
    s.compact_range()
    s.vacuum()
    one.merge("a", "7")
    two = Store.open(spark, f"{path}-two", StoreOptions(merge_operator=merge.CounterMerge()))
    assert (s.get("a"), one.get("a"), two.get("a")) == (b"50", b"9", b"2")
    backup = admin.BackupEngine(spark, f"{path}-bk")
    backup.create(s)
    one.files.delete(path)
    assert backup.restore(1, f"{path}-again", StoreOptions(merge_operator=merge.CounterMerge())).get("a") == b"50"


def test_copies_by_tasks(spark, path, monkeypatch):
    """Where files can't be linked, runs are copied by Spark."""
    s = Store.open(spark, path)
    s.write_frame(spark.range(300).selectExpr("concat('k', lpad(id, 4, '0')) AS user_key", "cast(id AS string) AS value").repartitionByRange(3, "user_key"))
    monkeypatch.setattr(type(s.files), "same", lambda *_: False)
    admin.copy_store(s, f"{path}-copy")
    s.files.delete(path)
    copied = Store.open(spark, f"{path}-copy")
    assert len(contents(copied)) == 300 and copied.get("k0299") == b"299" and len(list(copied.scan(start="k0100", end="k0110").collect())) == 10


def test_transactions_read_their_own_merges(spark, path):
    s = Store.open(spark, path, StoreOptions(merge_operator=merge.CounterMerge()))
    s.put("k", "5")
    s.merge("k", "1")
    t = txn.OptimisticTransaction(s)

    def seen(x):
        return {bytes(r["user_key"]): bytes(r["value"]) for r in x.read().collect()}

    assert t.get("k") == b"6" and seen(t) == {b"k": b"6"}
    t.merge("k", "3")
    t.merge("new", "2")
    assert (t.get("k"), t.get("new")) == (b"9", b"2") and seen(t) == {b"k": b"9", b"new": b"2"}
    t.delete("k")
    t.merge("k", "1")
    assert t.get("k") == b"1" and seen(t) == {b"k": b"1", b"new": b"2"}
    s.flush()
    s.compact_range()
    t.commit()
    assert contents(s) == {b"k": b"1", b"new": b"2"}
    u = txn.TransactionDB(s).begin()
    u.merge("k", "4")
    assert u.get_for_update("k") == b"5"
    u.commit()
    assert s.get("k") == b"5"


def test_conflicts_survive_compaction(spark, path):
    """A write of someone else counts, also a deletion that was compacted away and a bulk write whose run is gone."""
    s, other = Store.open(spark, path), Store.open(spark, path)
    for n, change in enumerate((lambda: other.delete("k"), lambda: other.write_frame(spark.createDataFrame([("k", "bulk"), ("z", "1")], "user_key string, value string")))):
        s.put("k", str(n))
        other.refresh()
        a, b, free = (txn.OptimisticTransaction(s) for _ in range(3))
        a.put("k", "a")
        b.put("k", "b")
        free.put(f"own{n}", "1")
        change()
        if n:
            s.refresh()
            assert a.conflicts() == [(0, b"k")]
        other.compact_range()
        other.vacuum()
        with pytest.raises(errors.Busy):
            a.commit()
        assert b.conflicts() == [(0, b"k")]
        if not n:
            free.commit()
            assert s.get("own0") == b"1" and s.get("k") is None


def test_optimistic_transactions(spark, path):
    s = Store.open(spark, path)
    s.put("k", "0")
    a, b, c = (txn.OptimisticTransaction(s) for _ in range(3))
    a.put("k", "a")
    b.put("k", "b")
    c.put("other", "c")
    assert a.get("k") == b"a" and b.get("k") == b"b" and c.get("k") == b"0"
    a.commit()
    with pytest.raises(errors.Busy):
        b.commit()
    c.commit()
    assert contents(s) == {b"k": b"a", b"other": b"c"}
    d = txn.OptimisticTransaction(s)
    d.delete("k")
    assert d.get("k") is None and {bytes(r["user_key"]) for r in d.read().collect()} == {b"other"}
    d.rollback()
    assert s.get("k") == b"a"
    with pytest.raises(errors.InvalidArgument):
        d.put("x", "y")
    e = txn.OptimisticTransaction(s)
    e.track("k")
    e.put("z", "1")
    s.put("k", "late")
    with pytest.raises(errors.Busy):
        e.commit()


def test_locks(spark, path):
    s = Store.open(spark, path)
    db = txn.TransactionDB(s, timeout_s=0.1)
    a, b = db.begin(), db.begin()
    a.put("k", "1")
    with pytest.raises(errors.Busy):
        b.put("k", "2")
    assert db.lock_table().count() == 1
    a.commit()
    b.put("k", "2")
    b.commit()
    assert s.get("k") == b"2"
    x, y = db.begin(), db.begin()
    assert x.get_for_update("k", exclusive=False) == b"2" == y.get_for_update("k", exclusive=False)
    with pytest.raises(errors.Busy):
        x.put("k", "3")
    y.rollback()
    x.put("k", "3")
    with x:
        x.delete("gone")
    assert s.get("k") == b"3"


def test_streams(spark, tmp_path, path):
    log, s = str(tmp_path / "log"), Store.open(spark, path)
    rows = [("a", 1, 1, "1"), ("b", 2, 1, "2"), ("a", 4, 0, None), ("a", 3, 1, "late"), ("c", 5, 1, "5")]
    for part, want in ((rows[:3], {b"b": b"2"}), (rows[3:], {b"b": b"2", b"c": b"5"})):
        spark.createDataFrame(part, tail.LOG).coalesce(1).write.mode("append").parquet(log)
        tail.into_store(tail.read_log(spark, log), s, f"{path}-ck").awaitTermination()
        assert contents(s) == want and s.get("a") is None
    s.compact_range()
    assert s.level_files(6)[0]["tombstones"] == 1
    older = spark.createDataFrame([("a", 2, 1, "older"), ("b", 1, 1, "older")], "user_key string, seq long, op int, value string")
    assert not s.write_versions(older, stream=f"{path}-ck", batch=1) and s.statistics.batches_skipped == 1
    assert s.write_versions(older, stream=f"{path}-ck", batch=2) and contents(s) == {b"b": b"2", b"c": b"5"}
    assert not Store.open(spark, path).write_versions(older, stream=f"{path}-ck", batch=2)
    s.put("b", "new")
    assert s.get("b") == b"new" and s.snapshot().seq() == 6
    for name, make, trigger in (("agg", tail.latest, {"availableNow": True}), ("ttl", lambda x: tail.latest_with_ttl(x, 60_000), {"processingTime": "1 second"})):
        q = make(tail.read_log(spark, log)).writeStream.format("memory").queryName(f"latest_{name}").outputMode("update").trigger(**trigger).start()
        end = time.monotonic() + 40
        while spark.table(f"latest_{name}").select("user_key").distinct().count() < 3 and time.monotonic() < end:
            time.sleep(0.5)
        q.stop()
        got = {}
        for r in spark.table(f"latest_{name}").collect():
            if r["seq"] > got.get(r["user_key"], (-1,))[0]:
                got[r["user_key"]] = (r["seq"], r["op"], r["value"])
        assert got == {"a": (4, 0, None), "b": (2, 1, "2"), "c": (5, 1, "5")}


def test_windowed_counts(spark, tmp_path):
    """A window is given once the watermark has passed it; rows that come later than that are left out."""
    log = str(tmp_path / "log")
    for n, part in enumerate(([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 00:20:00", 0)], [("2024-01-01 09:00:00", 1)], [("2024-01-01 00:30:00", 1), ("2024-01-01 12:30:00", 1)])):
        spark.createDataFrame(part, "t string, op int").selectExpr("cast(t AS timestamp) AS ts", "op").coalesce(1).write.mode("append").parquet(log)
        q = tail.windowed_counts(spark.readStream.schema("ts timestamp, op int").parquet(log)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(str(r["start"]), r["op"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01 00:00:00", 1): 2, ("2024-01-01 00:00:00", 0): 1, ("2024-01-01 09:00:00", 1): 1}


def test_statistics(spark, path):
    s = Statistics()
    assert set(s.rates().values()) == {0.0}
    s.add(compactions=4, split_compactions=1, compaction_micros=8000, lookups=4, lookups_found=3)
    assert s.rates()["split"] == 0.25 and s.rates()["found"] == 0.75 and s.rates()["micros_per_compaction"] == 2000.0 and "4  compactions" in s.report()
    s.reset()
    assert s.compactions == 0
    store = Store.open(spark, path)
    store.put("a", "1")
    store.delete("b")
    assert store.get("a") == b"1" and store.get("b") is None
    store.flush()
    assert store.get("a") == b"1" and store.get("b") is None
    store.compact_range()
    n = store.statistics
    assert (n.operations, n.deletions, n.lookups, n.lookups_from_buffer, n.lookups_found, n.flushes) == (2, 1, 4, 2, 2, 1)
    assert n.compactions == 6 and n.compacted_runs == 6 and n.runs_written == 7 and n.compaction_written_bytes < n.compaction_read_bytes * 2 and n.run_bytes > 0
    assert n.commits == 2 + 1 + 6 and n.commit_syncs == n.commits and n.commit_bytes > 0


def test_every_counter_is_counted():
    """No counter is declared that nothing adds to."""
    root = pathlib.Path(__file__).resolve().parent.parent / "tidelog"
    text = (root / "store.py").read_text()
    assert [n for n in COUNTERS if not re.search(rf"\b{n}=", text)] == []
