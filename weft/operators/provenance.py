"""Fingerprints, the registry of partitions, guards, and a hash-linked audit log."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, PartitionError
from .partition import ROLE, Split

HALF = "conv(substring(h, {}, 15), 16, 10)"


def fingerprint_frame(df: DataFrame) -> DataFrame:
    """One row: rows and two sums of halves of row hashes. Neither row nor column order matters."""
    columns = sorted(df.columns)
    text = F.concat_ws("\x1f", *[F.concat(F.lit(c + "="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00"))) for c in columns])
    h = df.select(F.md5(text.cast("binary")).alias("h"))
    return h.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.expr(HALF.format(at)).cast("decimal(38,0)")).alias(n) for at, n in ((1, "high"), (17, "low"))])


def fingerprint(df: DataFrame) -> str:
    r = fingerprint_frame(df).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(json.dumps([r["rows"], str(r["high"]), str(r["low"]), kinds]).encode()).hexdigest()[:16]


class Registry:
    """Which fingerprint is which part of which split, how often it was looked at, and whether it was assessed.

    With ``folder``, an assessment leaves a file there, so that another session sees it.
    """

    def __init__(self, limit: int = 10_000, folder: str | None = None):
        self.limit, self.folder, self.lock = limit, folder, threading.Lock()
        self.parts: OrderedDict[str, tuple[str, str]] = OrderedDict()
        self.assessed: set[str] = set()
        self.peeks: dict[str, int] = {}
        self.targets: dict[str, str | None] = {}

    def register(self, fp: str, role: str, split_id: str, target: str | None = None) -> None:
        with self.lock:
            self.parts[fp] = (role, split_id)
            self.parts.move_to_end(fp)
            self.targets[split_id] = target
            while len(self.parts) > self.limit:
                self.parts.popitem(last=False)

    def lookup(self, fp: str) -> tuple[str, str] | None:
        with self.lock:
            return self.parts.get(fp)

    def peek(self, split_id: str) -> int:
        with self.lock:
            self.peeks[split_id] = self.peeks.get(split_id, 0) + 1
            return self.peeks[split_id]

    def _mark(self, fp: str) -> str | None:
        return os.path.join(self.folder, fp) if self.folder else None

    def assess_once(self, fp: str) -> None:
        """Mark a test part assessed; raises if it was before. The mark comes before any score."""
        with self.lock:
            path = self._mark(fp)
            if fp in self.assessed:
                raise PartitionError("this test part was assessed before")
            if path:
                os.makedirs(self.folder, exist_ok=True)
                try:
                    os.close(os.open(path, os.O_CREAT | os.O_EXCL))
                except FileExistsError:
                    raise PartitionError("this test part was assessed in another session") from None
            self.assessed.add(fp)

    def clear(self) -> None:
        with self.lock:
            self.parts.clear()
            self.assessed.clear()
            self.peeks.clear()


REGISTRY = Registry()
_mode = "strict"


def guards(mode: str | None = None) -> str:
    """The guard mode (strict, warn or off); set it if given."""
    global _mode
    if mode is not None:
        if mode not in ("strict", "warn", "off"):
            raise ConfigError("guards are strict, warn or off")
        _mode = mode
    return _mode


def _object(what: str) -> None:
    if _mode == "strict":
        raise PartitionError(what)
    if _mode == "warn":
        import warnings

        warnings.warn(what, stacklevel=3)


def register_split(s: Split) -> Split:
    """Give a split its id and register its parts and dev by fingerprint."""
    s.split_id = s.split_id or uuid.uuid4().hex[:16]
    for role, part in (("train", s.train), ("valid", s.valid), ("test", s.test), ("dev", s.dev)):
        REGISTRY.register(fingerprint(part), role, s.split_id, s.target)
    return s


ALLOWED = {"fit": {"train", "valid", "dev"}, "evaluate": {"train", "valid", "dev"}, "validate": {"test"}, "assess": {"test"}}


def guard(verb: str, df: DataFrame) -> tuple[str | None, str | None]:
    """Role and split of a table, if a verb may use it. ``assess`` also spends the test part."""
    if _mode == "off":
        return None, None
    fp = fingerprint(df)
    found = REGISTRY.lookup(fp)
    if found is None:
        _object(f"{verb} needs a part of a registered split")
        return None, None
    role, split_id = found
    if role not in ALLOWED[verb]:
        _object(f"{verb} can't use the {role} part")
    if verb == "assess" and role == "test":
        REGISTRY.assess_once(fp)
    return role, split_id


class AuditLog:
    """Entries linked by hashes: each hash covers its entry and the one before."""

    def __init__(self):
        self.entries: list[dict] = []

    def add(self, event: str, **fields) -> dict:
        body = json.dumps({"event": event, **fields}, sort_keys=True, default=str)
        last = self.entries[-1]["hash"] if self.entries else ""
        entry = {"seq": len(self.entries), "body": body, "hash": hashlib.sha256((last + body).encode()).hexdigest()}
        self.entries.append(entry)
        return entry

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(e["seq"], e["body"], e["hash"]) for e in self.entries], "seq long, body string, hash string")

    def to_json(self) -> str:
        return json.dumps(self.entries)


def verify_chain(log: DataFrame, seq: str = "seq", body: str = "body", digest: str = "hash") -> DataFrame:
    """The log with ``valid``: whether each hash is that of the one before and the entry."""
    before = F.coalesce(F.lag(digest).over(Window.partitionBy(F.lit(0)).orderBy(seq)), F.lit(""))
    return log.withColumn("valid", F.col(digest) == F.sha2(F.concat(before, F.col(body)), 256))


def lineage(s: Split) -> dict:
    return {"split_id": s.split_id, "target": s.target, "seed": s.seed, "role_column": ROLE}
