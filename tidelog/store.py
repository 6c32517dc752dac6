"""A store on disk: a log of commits, and runs of Parquet files.

A commit is a file, numbered without gaps, that only one writer can create; it holds operations (the log), edits of the set
of runs, and events of column families. The state is the fold of all commits. Small writes are operations in a commit;
bulk writes and flushes are runs that a commit adds. Readers take the state they have; a DataFrame once made stays as it is.

A commit file begins with a checksum of what follows. A snapshot holds the state that it was taken in, so it reads the runs and
the buffer of that state, whatever is flushed or compacted later; vacuum() leaves runs alone that a live snapshot, a checkpoint
or a backup names.
"""

from __future__ import annotations

import base64
import copy
import json
import threading
import time
import uuid
import weakref
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import schema
from .errors import Busy, Corruption, InvalidArgument, NotFound, Stalled
from .operators import compaction, cursor, merge, resolve
from .operators.bloom import BloomPolicy, FilterPolicy
from .schema import DEFAULT_CF, DEFAULT_CF_ID, DELETE, MERGE, N_LEVELS, PUT
from .sources.files import Files
from .stats import Statistics

CODECS = {"none": "uncompressed", "snappy": "snappy", "lz4": "lz4_raw", "zstd": "zstd"}
#: Commits after which the folded state is written next to them.
STATE_EVERY = 50


@dataclass
class StoreOptions:
    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_bytes: int = 4 << 20
    compression: str = "snappy"
    filter_policy: FilterPolicy = field(default_factory=BloomPolicy)
    l0_trigger: int = compaction.L0_TRIGGER
    l0_stop: int = compaction.L0_STOP
    auto_compact: bool = True
    #: Without auto_compact a write that finds level 0 full waits so long for another process to compact.
    stall_timeout_s: float = 5.0
    #: Commit files are on the disk before a write returns.
    sync: bool = True
    #: Stored bytes of the families that cache() may keep; the least recently read leave.
    cache_bytes: int = 1 << 30
    #: Opened sets of run files that are kept.
    kept_readers: int = 64
    merge_operator: merge.MergeOperator | merge.ExpressionMerge | None = None
    families: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnFamily:
    cf_id: int
    name: str


@dataclass(frozen=True, eq=False)
class Snapshot:
    """What a read may see: the state of the store after a commit, with the newest seq of each column family."""

    commit: int
    seqs: dict[int, int]
    state: _State | None = field(default=None, repr=False)

    def seq(self, cf_id: int = DEFAULT_CF_ID) -> int:
        return self.seqs.get(cf_id, 0)


class WriteBatch:
    """Operations in order; of operations on one key the last counts."""

    def __init__(self) -> None:
        self.ops: list[tuple[int, int, bytes, bytes | None]] = []

    def put(self, key: bytes | str, value: bytes | str, cf: ColumnFamily | None = None) -> WriteBatch:
        return self._add(cf, PUT, key, value)

    def delete(self, key: bytes | str, cf: ColumnFamily | None = None) -> WriteBatch:
        return self._add(cf, DELETE, key, None)

    def merge(self, key: bytes | str, value: bytes | str, cf: ColumnFamily | None = None) -> WriteBatch:
        return self._add(cf, MERGE, key, value)

    def _add(self, cf: ColumnFamily | None, op: int, key: bytes | str, value: bytes | str | None) -> WriteBatch:
        self.ops.append((cf.cf_id if cf else DEFAULT_CF_ID, op, _bytes(key), None if value is None else _bytes(value)))
        return self

    def last(self, key: bytes | str, cf: ColumnFamily | None = None) -> tuple[int, bytes | None] | None:
        """Operation and value of the last entry for a key."""
        want = (cf.cf_id if cf else DEFAULT_CF_ID, _bytes(key))
        return next(((op, v) for c, op, k, v in reversed(self.ops) if (c, k) == want), None)

    def __contains__(self, key: bytes | str) -> bool:
        return self.last(key) is not None

    def __len__(self) -> int:
        return len(self.ops)

    def data_size(self) -> int:
        return sum(len(k) + len(v or b"") for _, _, k, v in self.ops)

    def clear(self) -> None:
        self.ops.clear()


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _pack(x: bytes | None) -> str | None:
    return None if x is None else base64.b64encode(x).decode()


def _unpack(x: str | None) -> bytes | None:
    return None if x is None else base64.b64decode(x)


def _touches(lo: str, hi: str, smallest: bytes | None, largest: bytes | None) -> bool:
    """Whether a range of packed keys meets the given one; None is no bound."""
    return (largest is None or _unpack(lo) <= largest) and (smallest is None or _unpack(hi) >= smallest)


def _packed_size(key: str, value: str | None) -> int:
    """About the bytes of key and value."""
    return (len(key) + len(value or "")) * 3 // 4


def _sealed(text: str) -> str:
    return f"{zlib.crc32(text.encode()):08x} {text}"


def _opened(sealed: str, path: str) -> dict:
    if f"{zlib.crc32(sealed[9:].encode()):08x} " != sealed[:9]:
        raise Corruption(f"{path} doesn't match its checksum")
    return json.loads(sealed[9:])


class _State:
    """The fold of commits."""

    def __init__(self) -> None:
        self.commit = 0
        self.families = {DEFAULT_CF_ID: DEFAULT_CF}
        self.next_cf = DEFAULT_CF_ID + 1
        self.next_run = 1
        self.seqs: dict[int, int] = {}
        self.runs: dict[int, dict] = {}
        self.log: list[list] = []  # [cf_id, seq, op, key, value], packed
        self.log_bytes = 0
        self.late: list[int] = []  # families that take in versions out of their order
        self.streams: dict[str, int] = {}  # the last batch of each

    def frozen(self) -> _State:
        """This state as it is now; entries are shared, as none is ever changed."""
        other = copy.copy(self)
        for name in ("families", "seqs", "runs", "log", "late", "streams"):
            setattr(other, name, copy.copy(getattr(self, name)))
        return other

    def apply(self, number: int, commit: dict) -> None:
        for event in commit.get("families", ()):
            if event["event"] == "create":
                self.families[event["cf_id"]] = event["name"]
                self.next_cf = max(self.next_cf, event["cf_id"] + 1)
            else:
                self.families.pop(event["cf_id"], None)
                self.runs = {k: r for k, r in self.runs.items() if r["cf_id"] != event["cf_id"]}
                self.log = [x for x in self.log if x[0] != event["cf_id"]]
        for cf_id, seq, op, key, value in commit.get("ops", ()):
            self.log.append([cf_id, seq, op, key, value])
            self.log_bytes += _packed_size(key, value)
            self.seqs[cf_id] = max(self.seqs.get(cf_id, 0), seq)
        for cf_id, upto in commit.get("flushed", {}).items():
            self.log = [x for x in self.log if x[0] != int(cf_id) or x[1] > upto]
            self.log_bytes = sum(_packed_size(x[3], x[4]) for x in self.log)
        if commit.get("late") is not None and commit["late"] not in self.late:
            self.late.append(commit["late"])
        self.streams.update(commit.get("stream", {}))
        for run in commit.get("remove", ()):
            self.runs.pop(run, None)
        for run in commit.get("add", ()):
            self.runs[run["run_id"]] = run
            self.next_run = max(self.next_run, run["run_id"] + 1)
            self.seqs[run["cf_id"]] = max(self.seqs.get(run["cf_id"], 0), run["max_seq"])
        self.commit = number

    def dump(self) -> str:
        return json.dumps(vars(self))

    @classmethod
    def load(cls, found: dict) -> _State:
        self = cls()
        vars(self).update(found)
        self.families = {int(k): v for k, v in self.families.items()}
        self.seqs = {int(k): v for k, v in self.seqs.items()}
        self.runs = {int(k): v for k, v in self.runs.items()}
        return self


class Store:
    def __init__(self, spark: SparkSession, path: str, options: StoreOptions):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.files, self.statistics = Files(spark), Statistics()
        self._lock = threading.RLock()
        self._state = _State()
        self._cached: OrderedDict[int, tuple[int, int, DataFrame]] = OrderedDict()
        self._readers: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._snapshots: weakref.WeakSet[Snapshot] = weakref.WeakSet()

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: StoreOptions | None = None, families: Iterable[str] = ()) -> Store:
        """Open or create; families are opened too, and created if the store may be."""
        store = cls(spark, path, options or StoreOptions())
        if store.options.compression not in CODECS:
            raise InvalidArgument(f"compression is one of {', '.join(CODECS)}")
        there = store.files.exists(f"{store.path}/commits")
        if there and store.options.error_if_exists:
            raise InvalidArgument(f"{path} is there already")
        if not there:
            if not store.options.create_if_missing:
                raise NotFound(path)
            store.files.make_dir(f"{store.path}/commits")
        store.refresh()
        for name in families:
            if name not in store._state.families.values():
                if not store.options.create_if_missing:
                    raise NotFound(f"column family {name}")
                store.create_column_family(name)
        return store

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Commits

    def refresh(self) -> None:
        """Take in what other writers have committed. A commit that was begun and never put in place is not there."""
        with self._lock:
            there, known = self._commit_numbers()
            # Old commits may have been dropped for a state written since.
            if known and known[-1] > self._state.commit and (self._state.commit == 0 or self._state.commit + 1 not in there):
                self._state = _State.load(self._read_sealed(self._commit_path(known[-1], "s")))
            for number in (n for n in there if n > self._state.commit):
                if number != self._state.commit + 1:
                    raise Corruption(f"commit {self._state.commit + 1} is missing")
                self._state.apply(number, self._read_sealed(self._commit_path(number)))

    def _commit_numbers(self) -> tuple[list[int], list[int]]:
        """Numbers of commits, and of written states, in order."""
        names = [n for n in self.files.names(f"{self.path}/commits") if n.endswith(".json")]
        return tuple(sorted(int(n[1:-5]) for n in names if n.startswith(kind)) for kind in "cs")

    def _read_sealed(self, path: str) -> dict:
        return _opened(self.files.read(path), path)

    def commits_after(self, number: int) -> Iterator[dict]:
        """What was committed since, up to the state that is known, in order; Busy if vacuum() has dropped some of it."""
        for n in range(number + 1, self._state.commit + 1):
            if not self.files.exists(self._commit_path(n)):
                raise Busy(f"commit {n} is no longer kept")
            yield self._read_sealed(self._commit_path(n))

    def _commit_path(self, number: int, kind: str = "c") -> str:
        return f"{self.path}/commits/{kind}{number:012d}.json"

    def _commit(self, commit: dict) -> None:
        """Put the next commit in place; Busy if another writer was first."""
        with self._lock:
            number, text = self._state.commit + 1, _sealed(json.dumps(commit))
            if not self.files.create(self._commit_path(number), text, sync=self.options.sync):
                self.statistics.add(lost_races=1)
                self.refresh()
                raise Busy(f"commit {number} was taken by another writer")
            self.statistics.add(commits=1, commit_bytes=len(text), commit_syncs=int(self.options.sync))
            self._state.apply(number, commit)
            if number % STATE_EVERY == 0:
                self.files.create(self._commit_path(number, "s"), _sealed(self._state.dump()), sync=self.options.sync)

    def _retried(self, make) -> None:
        """Commit what make() builds on the newest state, again if another writer was first."""
        for _ in range(20):
            try:
                return self._commit(make())
            except Busy:
                continue
        raise Busy("other writers were always first")

    # Column families

    def create_column_family(self, name: str) -> ColumnFamily:
        made: list[ColumnFamily] = []

        def make() -> dict:
            if name in self._state.families.values():
                raise InvalidArgument(f"column family {name} is there already")
            made.append(ColumnFamily(self._state.next_cf, name))
            return {"families": [{"event": "create", "cf_id": self._state.next_cf, "name": name}]}

        self._retried(make)
        return made[-1]

    def drop_column_family(self, cf: ColumnFamily) -> None:
        if cf.cf_id == DEFAULT_CF_ID:
            raise InvalidArgument("the default column family stays")

        def make() -> dict:
            if cf.cf_id not in self._state.families:
                raise NotFound(f"column family {cf.name}")
            return {"families": [{"event": "drop", "cf_id": cf.cf_id, "name": cf.name}]}

        self._retried(make)

    def column_families(self) -> list[ColumnFamily]:
        return [ColumnFamily(i, n) for i, n in sorted(self._state.families.items())]

    def column_family(self, name: str = DEFAULT_CF) -> ColumnFamily:
        found = next((c for c in self.column_families() if c.name == name), None)
        if found is None:
            raise NotFound(f"column family {name}")
        return found

    def _cf(self, cf: ColumnFamily | None) -> int:
        cf_id = cf.cf_id if cf else DEFAULT_CF_ID
        if cf_id not in self._state.families:
            raise InvalidArgument(f"no column family {cf_id}")
        return cf_id

    # Writes

    def put(self, key: bytes | str, value: bytes | str, cf: ColumnFamily | None = None) -> None:
        self.write(WriteBatch().put(key, value, cf))

    def delete(self, key: bytes | str, cf: ColumnFamily | None = None) -> None:
        self.write(WriteBatch().delete(key, cf))

    def merge(self, key: bytes | str, value: bytes | str, cf: ColumnFamily | None = None) -> None:
        self.write(WriteBatch().merge(key, value, cf))

    def write(self, batch: WriteBatch, *, after: int | None = None) -> None:
        """All operations in one commit. after: the commit that must still be the last one, else Busy."""
        for cf_id, *_ in batch.ops:
            if cf_id not in self._state.families:
                raise InvalidArgument(f"no column family {cf_id}")

        def make() -> dict:
            if after is not None and self._state.commit != after:
                raise Busy("written since")
            seqs, ops = dict(self._state.seqs), []
            for cf_id, op, key, value in batch.ops:
                seqs[cf_id] = seqs.get(cf_id, 0) + 1
                ops.append([cf_id, seqs[cf_id], op, _pack(key), _pack(value)])
            return {"ops": ops}

        if not batch.ops:
            return
        for cf_id in {c for c, *_ in batch.ops}:
            self._make_room(cf_id)
        self._commit(make()) if after is not None else self._retried(make)
        self.statistics.add(operations=len(batch), deletions=sum(op == DELETE for _, op, _, _ in batch.ops), operation_bytes=batch.data_size())
        if self._state.log_bytes >= self.options.write_buffer_bytes:
            self.flush()

    def _make_room(self, cf_id: int) -> None:
        """A write that finds level 0 full compacts it, or waits until another process has."""
        cf = ColumnFamily(cf_id, self._state.families[cf_id])
        if not self.stalled(cf):
            return
        began = time.monotonic()
        while self.stalled(cf):
            if self.options.auto_compact:
                self.compact_level(0, cf)
            elif time.monotonic() - began >= self.options.stall_timeout_s:
                raise Stalled(f"level 0 of {cf.name} is full")
            else:
                time.sleep(0.05)
                self.refresh()
        self.statistics.add(waits=1, wait_micros=int((time.monotonic() - began) * 1e6))

    def write_frame(self, rows: DataFrame, cf: ColumnFamily | None = None) -> None:
        """Bulk write of (user_key, value) and, if there, op and ordinal; without ordinal rows count in their order."""
        cf_id = self._cf(cf)
        order = F.col("ordinal").cast("long") if "ordinal" in rows.columns else F.monotonically_increasing_id() + 1
        op = F.col("op").cast("int") if "op" in rows.columns else F.lit(PUT)
        log = rows.select(F.lit(cf_id).alias("cf_id"), F.col("user_key").cast("binary").alias("user_key"), order.alias("seq"), op.alias("op"), F.when(op != DELETE, F.col("value").cast("binary")).alias("value"))
        self._make_room(cf_id)
        self._add_run(cf_id, log, restamp=True, fresh=True)
        self.maybe_compact(cf)

    def write_versions(self, rows: DataFrame, cf: ColumnFamily | None = None, *, stream: str | None = None, batch: int = 0) -> bool:
        """Take in versions (user_key, seq, op, value) that were numbered elsewhere; seq decides, however late they come.

        stream and batch name a batch of a stream: one that has been taken in is skipped, and False returned. From then on
        compactions keep the deletions of the family, as an older version may still come.
        """
        cf_id = self._cf(cf)
        if stream is not None and self._state.streams.get(stream, -1) >= batch:
            self.statistics.add(batches_skipped=1)
            return False
        log = rows.select(F.lit(cf_id).alias("cf_id"), F.col("user_key").cast("binary").alias("user_key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("int").alias("op"), F.when(F.col("op") != DELETE, F.col("value").cast("binary")).alias("value"))
        self._make_room(cf_id)
        self._add_run(cf_id, log, fresh=True, late=True, stream=None if stream is None else (stream, batch))
        self.maybe_compact(cf)
        return True

    def _add_run(
        self, cf_id: int, rows: DataFrame, *, level: int = 0, restamp: bool = False, remove: Iterable[int] = (), flushed: int | None = None, fresh: bool = False, late: bool = False, stream: tuple[str, int] | None = None
    ) -> dict | None:
        """Write a run, then commit it; returns what the commit says of it. The path is new, so a failed attempt leaves no run.

        restamp: seqs count from the commit's. fresh: its versions are in no commit so far. Counts and bounds are observed while
        the rows are written; only the keys of a run of several files are read again, for the bounds of each.
        """
        path = f"{self.path}/runs/cf_id={cf_id}/level={level}/{uuid.uuid4().hex}"
        seen = Observation()
        size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
        told = [F.count(F.lit(1)).alias("rows"), F.sum((F.col("op") == DELETE).cast("long")).alias("tombstones"), F.sum(size.cast("long")).alias("raw"), F.min("user_key").alias("lo"), F.max("user_key").alias("hi"), F.max("seq").alias("max_seq")]
        writer = rows.drop("cf_id").sortWithinPartitions("user_key", F.col("seq").desc()).observe(seen, *told).write.option("compression", CODECS[self.options.compression])
        writer.options(**self.options.filter_policy.writer_options("user_key")).parquet(path)
        found = seen.get
        run: dict | None = None
        if found["rows"]:
            names = [n for n in self.files.names(path) if n.endswith(".parquet")]
            bounds = [(names[0], found["lo"], found["hi"])]
            if len(names) > 1:
                name = F.element_at(F.split(F.input_file_name(), "/"), -1)
                keys = self.spark.read.schema("user_key binary").parquet(path).groupBy(name.alias("name"))
                bounds = [tuple(r) for r in keys.agg(F.min("user_key"), F.max("user_key")).collect()]  # a row a file
            run = {
                "cf_id": cf_id, "level": level, "path": path, "rows": found["rows"], "tombstones": found["tombstones"], "bytes": self.files.size(path), "smallest": _pack(bytes(found["lo"])), "largest": _pack(bytes(found["hi"])),
                "files": [[n, _pack(bytes(lo)), _pack(bytes(hi))] for n, lo, hi in sorted(bounds)],
            }
        remove = list(remove)

        def make() -> dict:
            commit: dict = {"remove": remove} if remove else {}
            if any(r not in self._state.runs for r in remove):
                raise Busy("a run was compacted by another writer")
            if flushed is not None:
                commit["flushed"] = {str(cf_id): flushed}
            if stream is not None:
                commit["stream"] = {stream[0]: stream[1]}
            if late:
                commit["late"] = cf_id
            if run:
                shift = self._state.seqs.get(cf_id, 0) if restamp else 0
                commit["add"] = [run | {"run_id": self._state.next_run, "shift": shift, "max_seq": found["max_seq"] + shift}]
                if fresh:
                    commit["fresh"] = True
            return commit

        if run or remove or flushed is not None or stream is not None:
            self._retried(make)
        if run:
            self.statistics.add(runs_written=1, run_rows=run["rows"], run_bytes=run["bytes"])
        return run

    def flush(self, cf: ColumnFamily | None = None) -> None:
        """Turn logged operations into runs of level 0: all versions that count, deletions too."""
        for cf_id in [cf.cf_id] if cf else list(self._state.families):
            rows = [x for x in self._state.log if x[0] == cf_id]
            if rows:
                upto = max(x[1] for x in rows)
                log = self._frame(rows)
                kept = merge.since_base(log).unionByName(resolve.newest(log.filter(F.col("op") == DELETE))).dropDuplicates(["user_key", "seq"]) if any(x[2] == MERGE for x in rows) else compaction.flush(log)
                self._add_run(cf_id, kept, flushed=upto)
                self.statistics.add(flushes=1)
                self.maybe_compact(ColumnFamily(cf_id, self._state.families[cf_id]))

    # Reads

    def _frame(self, rows: list[list]) -> DataFrame:
        data = [(c, bytearray(_unpack(k)), s, op, None if v is None else bytearray(_unpack(v))) for c, s, op, k, v in rows]
        return self.spark.createDataFrame(data, schema.CHANGELOG)

    def _open(self, paths: list[str]) -> DataFrame:
        """Rows of run files. Opening lists files and reads footers, so opened sets are kept, the least recently used go."""
        key = tuple(paths)
        self.statistics.add(readers_asked=1, readers_kept=int(key in self._readers))
        if key not in self._readers:
            self._readers[key] = self.spark.read.schema("user_key binary, seq bigint, op int, value binary").parquet(*paths)
        self._readers.move_to_end(key)
        while len(self._readers) > self.options.kept_readers:
            self._readers.popitem(last=False)
        return self._readers[key]

    def _run_frame(self, runs: list[dict], smallest: bytes | None = None, largest: bytes | None = None) -> DataFrame | None:
        """Rows of the runs' files that can hold a key of the range; runs with the same shift of seqs are one scan."""
        out = None
        for shift in sorted({r["shift"] for r in runs}):
            paths = []
            for r in (r for r in runs if r["shift"] == shift):
                names = [n for n, lo, hi in r["files"] if _touches(lo, hi, smallest, largest)]
                paths += [r["path"]] if len(names) == len(r["files"]) else [f"{r['path']}/{n}" for n in names]  # a run copied by tasks is one entry
            if paths:
                rows = self._open(paths).select(F.lit(runs[0]["cf_id"]).alias("cf_id"), "user_key", (F.col("seq") + shift).alias("seq"), "op", "value")
                out = rows if out is None else out.unionByName(rows)
        return out

    def _seen(self, snapshot: Snapshot | None) -> _State:
        """The state that a read goes by."""
        if snapshot is None:
            return self._state
        if snapshot.state is None:
            raise InvalidArgument("this snapshot was not taken by snapshot()")
        return snapshot.state

    def changelog(self, cf: ColumnFamily | None = None, *, snapshot: Snapshot | None = None, smallest: bytes | None = None, largest: bytes | None = None) -> DataFrame:
        """All versions of a column family that are there; files that can't hold a key of the range aren't read."""
        cf_id, state = self._cf(cf), self._seen(snapshot)
        every = [r for r in state.runs.values() if r["cf_id"] == cf_id]
        runs = [r for r in every if _touches(r["smallest"], r["largest"], smallest, largest)]
        self.statistics.add(runs_considered=len(every), runs_left_out=len(every) - len(runs))
        log = self._frame([x for x in state.log if x[0] == cf_id])
        rows = self._run_frame(runs, smallest, largest)
        return log if rows is None else log.unionByName(rows)

    def resolved(self, cf: ColumnFamily | None = None, *, snapshot: Snapshot | None = None, smallest: bytes | None = None, largest: bytes | None = None) -> DataFrame:
        """Live rows (cf_id, user_key, seq, value), merges folded by the store's operator."""
        self.statistics.add(scans=1)
        cf_id = self._cf(cf)
        if snapshot is None and cf_id in self._cached:
            commit, _, rows = self._cached[cf_id]
            self.statistics.add(cache_reads=1, cache_hits=int(commit == self._state.commit))
            if commit == self._state.commit:
                self._cached.move_to_end(cf_id)
                return rows
            self.uncache(cf)
        return merge.fold(self.changelog(cf, snapshot=snapshot, smallest=smallest, largest=largest), self.options.merge_operator)

    def cache(self, cf: ColumnFamily | None = None) -> DataFrame:
        """Live rows, kept in the executors' memory (and disk) until the next commit or uncache(), if cache_bytes has room for them.

        A family counts with the stored bytes of its runs and its buffer; those least recently read make room.
        """
        self.uncache(cf)
        cf_id, rows = self._cf(cf), self.resolved(cf)
        size = sum(r["bytes"] for r in self._state.runs.values() if r["cf_id"] == cf_id) + sum(_packed_size(x[3], x[4]) for x in self._state.log if x[0] == cf_id)
        if size > self.options.cache_bytes:
            return rows
        while self._cached and size + sum(n for _, n, _ in self._cached.values()) > self.options.cache_bytes:
            self._cached.popitem(last=False)[1][2].unpersist()
            self.statistics.add(cache_evictions=1)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached[cf_id] = (self._state.commit, size, rows)
        return rows

    def uncache(self, cf: ColumnFamily | None = None) -> None:
        found = self._cached.pop(self._cf(cf), None)
        if found:
            found[2].unpersist()

    def clear_caches(self) -> None:
        """Forget cached families and opened readers."""
        while self._cached:
            self._cached.popitem()[1][2].unpersist()
        self._readers.clear()

    def cache_stats(self) -> dict[str, float]:
        """Of cached families: reads, hits, their share, evictions, bytes; of readers: kept ones, and the share that was kept."""
        s, rates = self.statistics, self.statistics.rates()
        return {
            "reads": s.cache_reads, "hits": s.cache_hits, "hit_rate": rates["cache"], "evictions": s.cache_evictions, "bytes": sum(n for _, n, _ in self._cached.values()),
            "readers": len(self._readers), "reader_rate": rates["reader"],
        }

    def _buffered(self, cf_id: int, raw: bytes, state: _State) -> tuple[bool, bytes | None]:
        """Whether the buffer alone says what key reads, and what that is. It is newer than every run, but for late versions."""
        key = _pack(raw)
        for c, _, op, k, value in reversed(state.log if cf_id not in state.late else []):
            if c == cf_id and k == key:
                return op != MERGE or self.options.merge_operator is None, None if op == DELETE else _unpack(value)
        return False, None

    def get(self, key: bytes | str, cf: ColumnFamily | None = None, *, snapshot: Snapshot | None = None) -> bytes | None:
        """The live value of a key, or None. A key whose newest version is buffered takes no job."""
        raw, cf_id = _bytes(key), self._cf(cf)
        known, value = self._buffered(cf_id, raw, self._seen(snapshot))
        if not known:
            log = self.changelog(cf, snapshot=snapshot, smallest=raw, largest=raw).filter(F.col("user_key") == F.lit(bytearray(raw)))
            row = merge.fold(log, self.options.merge_operator).first()
            value = None if row is None else bytes(row["value"])
        self.statistics.add(lookups=1, lookups_from_buffer=int(known), lookups_found=int(value is not None))
        return value

    def multi_get(self, keys: DataFrame | Iterable[bytes | str], cf: ColumnFamily | None = None, *, snapshot: Snapshot | None = None) -> DataFrame:
        """Live rows of many keys, in one job; a DataFrame has them as user_key."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(bytearray(_bytes(k)),) for k in keys], "user_key binary")
        want = keys.select(F.lit(self._cf(cf)).alias("cf_id"), F.col("user_key").cast("binary").alias("user_key"))
        return merge.fold(resolve.of_keys(self.changelog(cf, snapshot=snapshot), want), self.options.merge_operator)

    def scan(
        self, cf: ColumnFamily | None = None, *, start: bytes | str | None = None, end: bytes | str | None = None, prefix: bytes | str | None = None, reverse: bool = False, snapshot: Snapshot | None = None
    ) -> DataFrame:
        """Live rows in key order: start <= key < end, or all that begin with prefix."""
        low, high = (None if x is None else bytearray(_bytes(x)) for x in (start, end))
        if prefix is not None:
            low = bytearray(_bytes(prefix))
            stem = bytes(low).rstrip(b"\xff")  # the least key beyond all that begin so
            high = bytearray(stem[:-1] + bytes([stem[-1] + 1])) if stem else None
        rows = self.resolved(cf, snapshot=snapshot, smallest=None if low is None else bytes(low), largest=None if high is None else bytes(high))
        if low is not None:
            rows = rows.filter(F.col("user_key") >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col("user_key") < F.lit(high))
        if prefix is not None:
            rows = cursor.prefix(rows, bytes(low))
        return cursor.scan(rows, reverse=reverse)

    def iterator(self, cf: ColumnFamily | None = None, *, snapshot: Snapshot | None = None) -> Cursor:
        return Cursor(self.resolved(cf, snapshot=snapshot))

    def snapshot(self) -> Snapshot:
        """The store as it is now, for reads by this process; the runs it needs stay as long as it is referred to."""
        state = self._state.frozen()
        found = Snapshot(state.commit, state.seqs, state)
        self._snapshots.add(found)
        return found

    # Maintenance

    def level_files(self, level: int, cf: ColumnFamily | None = None) -> list[dict]:
        cf_id = self._cf(cf)
        return [r for r in self._state.runs.values() if r["cf_id"] == cf_id and r["level"] == level]

    def scores(self, cf: ColumnFamily | None = None) -> dict[int, float]:
        """Of each level; above 1 it is due. Counts of the manifest, not of data."""
        out = {0: len(self.level_files(0, cf)) / self.options.l0_trigger}
        for level in range(1, N_LEVELS):
            out[level] = sum(r["bytes"] for r in self.level_files(level, cf)) / compaction.target_bytes(level)
        return out

    def maybe_compact(self, cf: ColumnFamily | None = None) -> int | None:
        """Compact the level that most needs it; returns it."""
        if not self.options.auto_compact:
            return None
        due = {level: s for level, s in self.scores(cf).items() if s > 1.0 and level < N_LEVELS - 1}
        if not due:
            return None
        level = min(due, key=lambda x: (-due[x], x))
        self.compact_level(level, cf)
        return level

    def compact_level(self, level: int, cf: ColumnFamily | None = None, *, smallest: bytes | None = None, largest: bytes | None = None) -> None:
        """Merge a level's runs (within bounds) and those of the next that they overlap into the next level."""
        if not 0 <= level < N_LEVELS - 1:
            raise InvalidArgument(f"level {level}")
        cf_id = self._cf(cf)

        upper = [r for r in self.level_files(level, cf) if _touches(r["smallest"], r["largest"], smallest, largest)]
        if not upper:
            return
        if level == 0:  # runs of level 0 overlap: an older one must not stay above a newer one
            upper = self.level_files(0, cf)
        lo, hi = min(_unpack(r["smallest"]) for r in upper), max(_unpack(r["largest"]) for r in upper)
        lower = [r for r in self.level_files(level + 1, cf) if _touches(r["smallest"], r["largest"], lo, hi)]
        runs = [*upper, *lower]
        began = time.monotonic()
        rows = self._run_frame(runs)
        bottom = level + 1 >= N_LEVELS - 1 and cf_id not in self._state.late
        if self.options.merge_operator is None:
            merged = compaction.compact(rows, output_level=level + 1 if bottom else 0)
        else:
            live = merge.since_base(rows)
            gone = resolve.newest(rows.filter(F.col("op") != MERGE)).filter(F.col("op") == DELETE)
            merged = live if bottom else live.unionByName(gone)
        size = sum(r["bytes"] for r in runs)
        parts = max(1, size // (128 << 20))
        if size >= compaction.MIN_SUBCOMPACTION_BYTES:
            merged = compaction.sorted_runs(merged, max(parts, compaction.SUBCOMPACTIONS))
        else:
            merged = merged.coalesce(1)
        written = self._add_run(cf_id, merged, level=level + 1, remove=[r["run_id"] for r in runs])
        self.statistics.add(
            compactions=1, split_compactions=int(size >= compaction.MIN_SUBCOMPACTION_BYTES), compacted_runs=len(runs), compaction_read_bytes=size, compaction_written_bytes=written["bytes"] if written else 0,
            compaction_micros=int((time.monotonic() - began) * 1e6),
        )

    def compact_range(self, smallest: bytes | str | None = None, largest: bytes | str | None = None, cf: ColumnFamily | None = None) -> None:
        """Flush, then bring all runs that touch the range down to the bottom level."""
        self.flush(cf)
        lo, hi = (None if x is None else _bytes(x) for x in (smallest, largest))
        for level in range(N_LEVELS - 1):
            self.compact_level(level, cf, smallest=lo, largest=hi)

    def stalled(self, cf: ColumnFamily | None = None) -> bool:
        return len(self.level_files(0, cf)) >= self.options.l0_stop

    def pin(self, name: str, paths: list[str], reader: str) -> None:
        """Note that a store elsewhere reads these runs; the note counts as long as that store is there."""
        self.files.make_dir(f"{self.path}/pins")
        self.files.create(f"{self.path}/pins/{name}.json", _sealed(json.dumps({"reader": reader, "paths": paths})), sync=self.options.sync)

    def _pinned(self) -> set[str]:
        out: set[str] = set()
        for name in self.files.names(f"{self.path}/pins"):
            path = f"{self.path}/pins/{name}"
            note = self._read_sealed(path) if name.endswith(".json") else None
            if note and self.files.exists(note["reader"]):
                out |= set(note["paths"])
            elif note:
                self.files.delete(path)
        return out

    def vacuum(self) -> int:
        """Delete folders of runs that nothing names any more: no commit, snapshot or checkpoint; returns how many.

        DataFrames made from older states end to work. Commits that lie before the last but one written state go as well; a
        transaction that is older than that is told to start again.
        """
        there, known = self._commit_numbers()
        for n in (n for n in there if len(known) > 1 and n <= known[-2]):
            self.files.delete(self._commit_path(n))
        for n in known[:-2]:
            self.files.delete(self._commit_path(n, "s"))
        states = [self._state, *(s.state for s in self._snapshots if s.state)]
        live = {r["path"].rsplit("/", 1)[-1] for state in states for r in state.runs.values()} | {p.rsplit("/", 1)[-1] for p in self._pinned()}
        n = 0
        for cf in self.files.names(f"{self.path}/runs"):
            for level in self.files.names(f"{self.path}/runs/{cf}"):
                for name in self.files.names(f"{self.path}/runs/{cf}/{level}"):
                    if name not in live:
                        self.files.delete(f"{self.path}/runs/{cf}/{level}/{name}")
                        n += 1
        self._readers.clear()
        return n

    # Introspection

    def manifest(self) -> DataFrame:
        rows = [
            (r["run_id"], "add", r["cf_id"], r["level"], r["run_id"], r["path"], r["bytes"], r["rows"], r["tombstones"], bytearray(_unpack(r["smallest"])), bytearray(_unpack(r["largest"])), r["max_seq"])
            for r in self._state.runs.values()
        ]
        return self.spark.createDataFrame(rows, schema.MANIFEST)

    def get_property(self, name: str, cf: ColumnFamily | None = None) -> str | None:
        """num-files-at-levelN, total-size, num-entries or stats, with or without a prefix that ends in a dot."""
        short = name.rsplit(".", 1)[-1]
        cf_id = self._cf(cf)
        runs = [r for r in self._state.runs.values() if r["cf_id"] == cf_id]
        if short.startswith("num-files-at-level") and short[18:].isdigit():
            return str(sum(r["level"] == int(short[18:]) for r in runs))
        if short == "total-size":
            return str(sum(r["bytes"] for r in runs))
        if short == "num-entries":
            return str(sum(r["rows"] for r in runs) + sum(x[0] == cf_id for x in self._state.log))
        return self.statistics.report() if short == "stats" else None


class Cursor:
    """A position in live rows in key order. Each move is one small query on a fixed DataFrame."""

    def __init__(self, rows: DataFrame):
        self.rows, self._row = rows, None

    def _to(self, found: DataFrame) -> bool:
        self._row = found.first()
        return self.valid()

    def valid(self) -> bool:
        return self._row is not None

    def key(self) -> bytes:
        if self._row is None:
            raise NotFound("the cursor isn't at a row")
        return bytes(self._row["user_key"])

    def value(self) -> bytes:
        if self._row is None:
            raise NotFound("the cursor isn't at a row")
        return bytes(self._row["value"])

    def seek_to_first(self) -> bool:
        return self._to(cursor.first(self.rows))

    def seek_to_last(self) -> bool:
        return self._to(cursor.last(self.rows))

    def seek(self, target: bytes | str) -> bool:
        return self._to(cursor.seek(self.rows, F.lit(bytearray(_bytes(target)))))

    def seek_for_prev(self, target: bytes | str) -> bool:
        return self._to(cursor.seek_for_prev(self.rows, F.lit(bytearray(_bytes(target)))))

    def next(self) -> bool:
        return self._to(cursor.first(self.rows.filter(F.col("user_key") > F.lit(bytearray(self.key())))))

    def prev(self) -> bool:
        return self._to(cursor.last(self.rows.filter(F.col("user_key") < F.lit(bytearray(self.key())))))

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        """All rows in order, a partition at a time."""
        for row in cursor.scan(self.rows).toLocalIterator():
            yield bytes(row["user_key"]), bytes(row["value"])


