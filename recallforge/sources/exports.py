"""Exports and object stores."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import tarfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, memory

MAX_ARCHIVE = 50 << 20


def markdown(entries: DataFrame) -> DataFrame:
    """(cartridge, entry_id, value): one Markdown section a live entry, for ``write.text``."""
    title = F.when(F.coalesce("key_norm", F.lit("")) != "", F.col("key_norm")).otherwise("(no key)")
    line = F.concat(F.lit("## "), title, F.lit("\n\n"), F.col("content"), F.lit("\n\n_kind: "), memory.kind_name(F.col("kind")), F.lit(", source: "), F.coalesce("source", F.lit("")), F.lit("_\n"))
    return memory.live(entries).select("cartridge", "entry_id", line.alias("value"))


def json_lines(entries: DataFrame) -> DataFrame:
    """(cartridge, entry_id, value): one JSON object a live entry."""
    row = F.struct("content", memory.kind_name(F.col("kind")).alias("kind"), "source", "key_norm")
    return memory.live(entries).select("cartridge", "entry_id", F.to_json(row).alias("value"))


def refuse_encrypted(blob: bytes, magics: tuple[bytes, ...]) -> None:
    """Raises for bytes that begin like an encrypted envelope."""
    if any(blob.startswith(m) for m in magics):
        raise ValueError("encrypted containers can't be exported or compared")


def pack_archive(folder: str) -> str:
    """A folder as base64 of a gzipped tar, up to 50 MB (driver side)."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        tar.add(folder, arcname=Path(folder).name)
    data = out.getvalue()
    if len(data) > MAX_ARCHIVE:
        raise ValueError("archive too large")
    return base64.b64encode(data).decode()


def unpack_archive(data: str, folder: str, overwrite: bool = False) -> list[str]:
    """Files of an archive under a folder; paths that leave it and (unless wished) existing files raise."""
    blob = base64.b64decode(data)
    if len(blob) > MAX_ARCHIVE:
        raise ValueError("archive too large")
    root = Path(folder).resolve()
    with tarfile.open(fileobj=io.BytesIO(blob), mode="r:gz") as tar:
        names = [m for m in tar.getmembers() if m.isfile()]
        for m in names:
            to = (root / m.name).resolve()
            if root not in to.parents:
                raise ValueError(f"path leaves the folder: {m.name}")
            if to.exists() and not overwrite:
                raise FileExistsError(str(to))
        tar.extractall(root, members=names, filter="data")
    return [m.name for m in names]


@dataclass
class Info:
    etag: str
    size: int


class Conflict(Exception):
    """A conditional put found another version."""


class LocalStore:
    """Objects in a folder with conditional puts; the interface of any store that syncs (driver side)."""

    def __init__(self, root: str):
        self.root = Path(root)

    def _path(self, key: str) -> Path:
        p = (self.root / key).resolve()
        if self.root.resolve() not in p.parents:
            raise ValueError(f"bad key: {key}")
        return p

    def head(self, key: str) -> Info | None:
        p = self._path(key)
        if not p.exists():
            return None
        data = p.read_bytes()
        return Info(hashlib.md5(data).hexdigest(), len(data))

    def get(self, key: str) -> bytes:
        return self._path(key).read_bytes()

    def put(self, key: str, data: bytes, if_match: str | None = None, if_none_match: bool = False) -> Info:
        now = self.head(key)
        if (if_none_match and now) or (if_match is not None and (now is None or now.etag != if_match)):
            raise Conflict(key)
        p = self._path(key)
        p.parent.mkdir(parents=True, exist_ok=True)
        aside = p.with_name(p.name + ".tmp")
        aside.write_bytes(data)
        os.replace(aside, p)
        return Info(hashlib.md5(data).hexdigest(), len(data))

    def delete(self, key: str) -> None:
        self._path(key).unlink(missing_ok=True)

    def list(self, prefix: str = "") -> list[str]:
        return sorted(str(p.relative_to(self.root)) for p in self.root.rglob("*") if p.is_file() and str(p.relative_to(self.root)).startswith(prefix))


def push(plan: DataFrame, local: dict[str, bytes], store: LocalStore, etags: dict[str, str], dry_run: bool = False, force: bool = False) -> list[tuple[str, str]]:
    """Carry out the pushes of a sync plan (remote_key, status): what is ahead goes, conflicts only by force."""
    done = []
    for key, status in ((r["remote_key"], r["status"]) for r in plan.filter(F.col("status").isin("local_ahead", "conflict")).orderBy("remote_key").collect()):
        if status == "conflict" and not force:
            done.append((key, "conflict"))
        elif dry_run:
            done.append((key, "would push"))
        else:
            known = etags.get(key)
            store.put(key, local[key], if_match=None if force else known, if_none_match=known is None and not force)
            done.append((key, "pushed"))
    return done


def pull(plan: DataFrame, store: LocalStore, local: dict[str, bytes], dry_run: bool = False, force: bool = False) -> list[tuple[str, str]]:
    """Carry out the pulls of a sync plan (remote_key, status, local_policy, remote_policy) into ``local``.

    What is ahead at the remote or only there comes, conflicts only by force.
    Force doesn't open what a policy closes: either side's policy other than
    write_through (of a file that is there) keeps it out, a null one as well.
    """
    done = []
    allowed = (F.coalesce("local_policy", F.lit("write_through")) == "write_through") & F.coalesce(F.col("remote_policy") == "write_through", F.lit(False))
    rows = plan.filter(F.col("status").isin("remote_ahead", "remote_only", "conflict")).select("remote_key", "status", allowed.alias("allowed")).orderBy("remote_key")
    for key, status, may in ((r["remote_key"], r["status"], r["allowed"]) for r in rows.collect()):
        if not may:
            done.append((key, "denied"))
        elif status == "conflict" and not force:
            done.append((key, "conflict"))
        elif dry_run:
            done.append((key, "would pull"))
        else:
            local[key] = store.get(key)
            done.append((key, "pulled"))
    return done


sync_plan = diff.sync_status
