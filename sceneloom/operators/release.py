"""Releases: manifests, delta packages, preconditions, three-way plans, staged application, run identity.

Manifests are small (a row a file), so bytes are handled on the driver; the reconciliation is a join all the same.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import stat
import tempfile
import uuid
import zipfile
from collections import Counter
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes of a package's member and of all members, unpacked; the type of a package that may be applied.
MOST_MEMBER, MOST_UNPACKED = 32 * 2**20, 256 * 2**20
DELTA = "delta"
_SAFE = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._ -]*$")


def canonical_digest(value: object) -> str:
    """SHA-256 of the value as JSON with sorted keys and the default separators; non-ASCII characters as they are."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lock_violations(locked: DataFrame, present: DataFrame) -> DataFrame:
    """path, expected, found of locked files that are missing or have another hash."""
    rows = locked.select("path", F.col("sha256").alias("expected")).join(present.select("path", F.col("sha256").alias("found")), "path", "left")
    return rows.where(~F.col("expected").eqNullSafe(F.col("found")))


def reconcile(payload: DataFrame, present: DataFrame) -> DataFrame:
    """path, action of every file of a payload (path, sha256, previous_sha256): skip if it is there already, conflict if
    something else than the previous version is there (or it is missing though it should be replaced), else write."""
    there = present.select("path", F.col("sha256").alias("now"))
    rows = payload.join(there, "path", "left")
    action = F.when(F.col("now").eqNullSafe(F.col("sha256")), "skip").when(F.col("now").eqNullSafe(F.col("previous_sha256")), "write").otherwise("conflict")
    return rows.select("path", action.alias("action"))


def safe_path(name: str, allowed: tuple[str, ...]) -> str:
    """The path, if it is relative, has plain components and begins with an allowed prefix; otherwise an error."""
    p = PurePosixPath(name)
    if p.is_absolute() or "\\" in name or any(not _SAFE.match(x) for x in p.parts) or not any(name == a or name.startswith(a.rstrip("/") + "/") for a in allowed):
        raise ValueError(f"path not allowed: {name!r}")
    return name


def archive_members(path: str) -> list[dict]:
    """path, bytes of each file of a zip archive. Links, repeated names and sizes over the limits are errors."""
    with zipfile.ZipFile(path) as z:
        files = [i for i in z.infolist() if not i.is_dir()]
    faults = {
        "member twice": [n for n, k in Counter(i.filename for i in files).items() if k > 1],
        "member is a link": [i.filename for i in files if stat.S_ISLNK(i.external_attr >> 16)],
        "member too large": [i.filename for i in files if i.file_size > MOST_MEMBER],
        "package too large": [path] if sum(i.file_size for i in files) > MOST_UNPACKED else [],
    }
    for what, names in faults.items():
        if names:
            raise ValueError(f"{what}: {names[:5]}")
    return [{"path": i.filename, "bytes": i.file_size} for i in files]


class Folder:
    """A local folder that packages are applied to. Nothing outside it is read or written, nor through links."""

    def __init__(self, root: str):
        self.root = Path(root).resolve()
        if not self.root.is_dir():
            raise ValueError(f"not a folder: {root}")

    def place(self, name: str) -> Path:
        p = self.root / name
        steps = [p, *p.parents][: len(PurePosixPath(name).parts)]
        if any(x.is_symlink() for x in steps) or not p.resolve().is_relative_to(self.root):
            raise ValueError(f"links are not followed: {name!r}")
        if p.exists() and not p.is_file():
            raise ValueError(f"not a file: {name!r}")
        return p

    def bytes(self, name: str) -> bytes | None:
        p = self.place(name)
        return p.read_bytes() if p.exists() else None

    def digests(self, names: list[str]) -> dict[str, str | None]:
        return {n: None if (d := self.bytes(n)) is None else hashlib.sha256(d).hexdigest() for n in names}

    def put(self, name: str, data: bytes | None) -> None:
        p = self.place(name)
        p.unlink(missing_ok=True) if data is None else write_atomically(p, data)


class Delta:
    """A delta package: a zip archive with one manifest.json and the payload it lists. The manifest names the release, the
    release it builds on, and files that must be as stated; ``state`` is the file that tells the release of a folder."""

    def __init__(self, path: str, allowed: tuple[str, ...], state: str = "STATE.json"):
        members = {m["path"] for m in archive_members(path)}
        manifests = [n for n in members if PurePosixPath(n).name == "manifest.json"]
        if len(manifests) != 1:
            raise ValueError("exactly one manifest expected")
        with zipfile.ZipFile(path) as z:
            self.manifest = json.loads(z.read(manifests[0]))
            if self.manifest.get("package_type") != DELTA:
                raise ValueError("not a delta package")
            listed = [f["path"] for f in self.manifest["files"]]
            if sorted([*listed, *manifests]) != sorted(members):
                raise ValueError("manifest and members differ")
            self.payload = {safe_path(n, allowed): z.read(n) for n in listed}
        self.state = state
        self.files = {f["path"]: f for f in self.manifest["files"]}
        wrong = [n for n, d in self.payload.items() if (len(d), hashlib.sha256(d).hexdigest()) != (self.files[n]["bytes"], self.files[n]["sha256"])]
        if wrong:
            raise ValueError(f"content differs from the manifest: {wrong[:5]}")

    def _parent(self, folder: Folder) -> None:
        """The folder is what the package builds on, or has the package already."""
        required = {f["path"]: f["sha256"] for f in self.manifest.get("requires", {}).get("parent_files", [])}
        wrong = [n for n, d in folder.digests(list(required)).items() if d != required[n]]
        if wrong:
            raise ValueError(f"parent files differ: {wrong[:5]}")
        told = folder.bytes(self.state)
        if told is not None and json.loads(told).get("release_id") not in (self.manifest.get("parent_release_id"), self.manifest["release_id"]):
            raise ValueError("the folder holds another release than the package builds on")

    def plan(self, spark: SparkSession, root: str) -> DataFrame:
        """path, action against a folder, after the parent was found as required."""
        folder = Folder(root)
        self._parent(folder)
        payload = spark.createDataFrame([(n, f["sha256"], f.get("previous_sha256")) for n, f in self.files.items()], "path string, sha256 string, previous_sha256 string")
        present = spark.createDataFrame(list(folder.digests(list(self.files)).items()), "path string, sha256 string").where("sha256 is not null")
        return reconcile(payload, present)

    def apply(self, spark: SparkSession, root: str, dry_run: bool = True) -> list[tuple[str, str]]:
        """(path, action) in path order; writes unless ``dry_run``. A conflict is an error before anything is written. Each file
        is looked at again before it is replaced; after any failure the folder is as it was."""
        folder = Folder(root)
        seen = {n: folder.bytes(n) for n in self.files}
        actions = sorted((r["path"], r["action"]) for r in self.plan(spark, root).collect())  # a row a file of a bounded package
        if conflicts := [n for n, a in actions if a == "conflict"]:
            raise ValueError(f"unexpected content: {conflicts[:5]}")
        if not dry_run:
            with contextlib.ExitStack() as undo:
                for name in (n for n, a in actions if a == "write"):
                    if folder.bytes(name) != seen[name]:
                        raise ValueError(f"changed meanwhile: {name!r}")
                    undo.callback(folder.put, name, seen[name])  # run in reverse
                    folder.put(name, self.payload[name])
                undo.pop_all()
        return actions


def write_atomically(path: Path, data: bytes) -> None:
    """The file as a whole or not at all: written beside and renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def swap_table(spark: SparkSession, staged: str, final: str) -> None:
    """Puts a staged folder in the place of another, on any file system Spark knows. The other is kept beside it until the
    swap is done, and comes back if that fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{final.rstrip('/')}.{uuid.uuid4().hex}.old"
    there = fs.exists(path(final))
    if there and not fs.rename(path(final), path(old)):
        raise OSError(f"can't move {final} away")
    try:
        done = fs.rename(path(staged), path(final))
    except Exception:  # some file systems raise, others say no
        done = False
    if not done:
        if there:
            fs.rename(path(old), path(final))
        raise OSError(f"can't move {staged} to {final}")
    if there:
        fs.delete(path(old), True)


class Runs:
    """Finished stages by fingerprint: a stage runs again only if its inputs or settings changed or it didn't succeed, and
    never before the stages it needs have passed."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def fingerprint(self, stage: str, **inputs: object) -> str:
        import pyspark

        return canonical_digest({"stage": stage, "inputs": inputs, "spark": pyspark.__version__})

    def done(self, stage: str, fingerprint: str) -> bool:
        p = self.folder / f"{stage}.json"
        said = json.loads(p.read_text()) if p.is_file() else {}
        return (said.get("fingerprint"), said.get("status")) == (fingerprint, "passed")

    def require(self, stage: str, fingerprint: str) -> None:
        if not self.done(stage, fingerprint):
            raise ValueError(f"stage {stage!r} has not been completed with these inputs")

    def finish(self, stage: str, fingerprint: str, status: str = "passed", **facts: object) -> None:
        write_atomically(self.folder / f"{stage}.json", json.dumps({"fingerprint": fingerprint, "status": status, **facts}, ensure_ascii=False, sort_keys=True).encode())
