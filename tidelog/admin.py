"""Checkpoints, backups, and files from elsewhere."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Corruption, InvalidArgument, NotFound
from .schema import PUT
from .sources.files import Files
from .store import CODECS, ColumnFamily, Store, StoreOptions, _sealed


def _write_store(store: Store, path: str, runs: list[dict]) -> None:
    """A first commit at path that names these runs. Written last: what broke off before isn't a store."""
    events = [{"event": "create", "cf_id": i, "name": n} for i, n in store._state.families.items() if i]
    store.files.make_dir(f"{path}/commits")
    first = {"families": events, "add": runs}
    commits = [first, *({"late": cf_id} for cf_id in store._state.late)]
    for n in range(len(commits), 0, -1):
        store.files.create(f"{path}/commits/c{n:012d}.json", _sealed(json.dumps(commits[n - 1])), sync=store.options.sync)


def _new_place(store: Store, path: str) -> str:
    path = path.rstrip("/")
    if store.files.exists(path):
        raise InvalidArgument(f"{path} is there already")
    store.flush()
    return path


def checkpoint(store: Store, path: str) -> None:
    """A store of its own at path, which isn't there yet, with all column families as they are now.

    Runs never change, so the new store names those of the old one and no byte of them is moved, however many there are. A
    note in the old store keeps vacuum() away from them while the checkpoint is there. For a store that outlives the old one's
    folder take a backup.
    """
    path = _new_place(store, path)
    runs = list(store._state.runs.values())
    pins: dict[str, list[str]] = {}
    for run in runs:  # runs of a store that is a checkpoint itself may lie in another one
        pins.setdefault(run["path"].split("/runs/")[0], []).append(run["path"])
    for owner, paths in pins.items():
        Store.open(store.spark, owner).pin(uuid.uuid4().hex, paths, path)
    _write_store(store, path, runs)


def copy_store(store: Store, path: str) -> None:
    """A store of its own at path with its own runs: hard links where both are on one local disk, else copies by Spark tasks."""
    path, runs = _new_place(store, path), []
    for run in store._state.runs.values():
        target = f"{path}/runs/cf_id={run['cf_id']}/level={run['level']}/{uuid.uuid4().hex}"
        if not store.files.same(run["path"], target):
            rows = store.spark.read.schema("user_key binary, seq bigint, op int, value binary").parquet(run["path"])
            writer = rows.sortWithinPartitions("user_key", F.col("seq").desc()).write.option("compression", CODECS[store.options.compression])
            writer.options(**store.options.filter_policy.writer_options("user_key")).parquet(target)
            run = run | {"files": [["", run["smallest"], run["largest"]]], "bytes": store.files.size(target)}
        runs.append(run | {"path": target})
    _write_store(store, path, runs)


@dataclass(frozen=True)
class BackupInfo:
    backup_id: int
    timestamp: int
    store_path: str
    n_runs: int
    bytes: int


class BackupEngine:
    """Numbered backups in a folder, each a store with runs of its own and a description."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.files.make_dir(self.path)

    def create(self, store: Store) -> int:
        number = max([0, *(b.backup_id for b in self.list())]) + 1
        target = f"{self.path}/{number}"
        copy_store(store, f"{target}/store")
        runs = store._state.runs.values()
        info = BackupInfo(number, int(time.time()), store.path, len(runs), sum(r["bytes"] for r in runs))
        if not self.files.create(f"{target}/meta.json", json.dumps(vars(info))):
            raise InvalidArgument(f"backup {number} is there already")
        return number

    def list(self) -> list[BackupInfo]:
        """Complete backups by number."""
        found = [n for n in self.files.names(self.path) if n.isdigit() and self.files.exists(f"{self.path}/{n}/meta.json")]
        return sorted((BackupInfo(**json.loads(self.files.read(f"{self.path}/{n}/meta.json"))) for n in found), key=lambda b: b.backup_id)

    def info(self, number: int) -> BackupInfo:
        for b in self.list():
            if b.backup_id == number:
                return b
        raise NotFound(f"backup {number}")

    def catalog(self) -> DataFrame:
        rows = [tuple(vars(b).values()) for b in self.list()]
        return self.spark.createDataFrame(rows, "backup_id bigint, timestamp bigint, store_path string, n_runs bigint, bytes bigint")

    def delete(self, number: int) -> None:
        self.info(number)
        self.files.delete(f"{self.path}/{number}")

    def restore(self, number: int, path: str, options: StoreOptions | None = None) -> Store:
        """A backup as a new store at path."""
        self.info(number)
        if self.files.exists(path):
            raise InvalidArgument(f"{path} is there already")
        backup = Store.open(self.spark, f"{self.path}/{number}/store", StoreOptions(create_if_missing=False))
        copy_store(backup, path)
        return Store.open(self.spark, path, options)


@dataclass(frozen=True)
class FileInfo:
    n_entries: int
    n_keys: int
    smallest: bytes | None
    largest: bytes | None


def validate(rows: DataFrame) -> FileInfo:
    """What a file for ingest holds; it must have user_key, not null, and value, and no key twice."""
    missing = {"user_key", "value"} - set(rows.columns)
    if missing:
        raise Corruption(f"columns {', '.join(sorted(missing))} are missing")
    key = F.col("user_key").cast("binary")
    found = rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(key.isNull().cast("long")).alias("nulls")).first()
    if found["nulls"]:
        raise Corruption(f"{found['nulls']} rows have no key")
    if found["k"] != found["n"]:
        raise Corruption("keys occur more than once")
    return FileInfo(found["n"], found["k"], None if found["lo"] is None else bytes(found["lo"]), None if found["hi"] is None else bytes(found["hi"]))


def ingest(store: Store, path: str, cf: ColumnFamily | None = None, *, move: bool = False) -> FileInfo:
    """Add a Parquet file of (user_key, value) as the newest versions of its keys; move: delete it afterwards."""
    if not store.files.exists(path):
        raise NotFound(path)
    rows = store.spark.read.parquet(path)
    info = validate(rows)
    if info.n_entries:
        store.write_frame(rows.select("user_key", "value", F.lit(PUT).alias("op"), F.lit(1).alias("ordinal")), cf)
    if move:
        store.files.delete(path)
    return info


def export(store: Store, path: str, cf: ColumnFamily | None = None) -> None:
    """Live rows as a Parquet file that ingest() takes, sorted by key."""
    store.resolved(cf).select("user_key", "value").orderBy("user_key").write.parquet(path)


