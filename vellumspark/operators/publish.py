"""Identities and publication on the driver: canonical JSON, digests, generations and pointers.

A generation is a folder that never changes, named by the digest of what it was built from. It is
staged beside its place and renamed into it; an equal one that is already there is reused, and a
different or broken one is set aside. Pointers are small files that are replaced whole.
"""

import contextlib
import hashlib
import json
import os
import shutil
import stat
import time
import uuid
from collections.abc import Callable

from vellumspark.sources.files import ListingError, hash_file, walk

POINTER_BYTES = 4096


def canonical_json(value) -> bytes:
    """Sorted keys, no spaces, ASCII; numbers must be finite."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def pretty_json(value, limit: int = 64 << 20) -> bytes:
    """Two spaces of indent, sorted keys and a line end, as graphs are stored."""
    data = (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()
    if len(data) > limit:
        raise ValueError(f"the document is over {limit} bytes")
    return data


def identity(inputs: dict) -> str:
    """The digest of what something is built from; times of building are not part of it."""
    if "created_at" in inputs:
        raise ValueError("the time of building is no input")
    return hashlib.sha256(canonical_json(inputs)).hexdigest()


def tree_entries(root: str, exclude: tuple = ()) -> list[dict]:
    rows, odd = walk(root, exclude)
    if odd:
        raise ListingError(f"{odd[0][0]}: {odd[0][1]}")
    return [{"path": p, "type": "directory"} if t == "directory" else {"path": p, "type": "file", "size": s, "sha256": hash_file(os.path.join(root, p))} for p, t, s, *_ in rows]


def tree_digest(root: str, exclude: tuple = ()) -> str:
    return hashlib.sha256(canonical_json(tree_entries(root, exclude))).hexdigest()


def bundle_digest(entries: list[dict]) -> str:
    return hashlib.sha256(canonical_json({"files": sorted(entries, key=lambda e: e["path"])})).hexdigest()


def atomic_write(path: str, data: bytes, replace: bool = True) -> bool:
    """Write beside, then rename; without ``replace`` an existing file stays and False is returned."""
    temp = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}.{uuid.uuid4().hex}")
    try:
        with open(temp, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if replace:
            os.replace(temp, path)
            return True
        try:
            os.link(temp, path)
        except FileExistsError:
            return False
        return True
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def write_once(path: str, value) -> dict:
    """Write a report, or read what another has written first; that must be about the same thing."""
    if atomic_write(path, pretty_json(value), replace=False):
        return value
    with open(path, "rb") as f:
        found = json.loads(f.read())
    if found.get("id") != value.get("id"):
        raise ListingError(f"{path} holds another report")
    return found


def publish(build: Callable[[str], None], parent: str, key: str) -> tuple[str, str]:
    """Path of the generation ``key`` and whether it was built, reused or replaced. ``build`` fills
    a fresh folder."""
    os.makedirs(parent, exist_ok=True)
    stage, place = os.path.join(parent, f".stage-{uuid.uuid4().hex}"), os.path.join(parent, key)
    os.mkdir(stage)
    try:
        build(stage)
        digest, outcome = tree_digest(stage), "built"
        if os.path.isdir(place):
            try:
                same = tree_digest(place) == digest
            except (ListingError, OSError):
                same = False
            if same:
                return place, "reused"
            os.rename(place, os.path.join(parent, f"quarantine-{key}-{uuid.uuid4().hex[:8]}"))
            outcome = "replaced"
        read_only(stage)
        os.rename(stage, place)
        return place, outcome
    finally:
        if os.path.isdir(stage):
            shutil.rmtree(stage, ignore_errors=True)


def read_only(root: str) -> None:
    for d, _, names in os.walk(root):
        for n in names:
            path = os.path.join(d, n)
            os.chmod(path, os.stat(path).st_mode & ~(stat.S_IWUSR | stat.S_IWGRP | stat.S_IWOTH))


def read_pointer(path: str, root: str) -> str | None:
    """The folder that a pointer names, if it is there and stays inside ``root``; None without a
    pointer. Anything else is an error."""
    if not os.path.lexists(path):
        return None
    if os.path.islink(path) or not os.path.isfile(path) or os.path.getsize(path) > POINTER_BYTES:
        raise ListingError(f"{path} is no pointer")
    with open(path, encoding="utf-8") as f:
        value = f.read().strip()
    parts = value.split("/")
    if not value or value.startswith("/") or "\\" in value or any(p in ("", ".", "..") for p in parts) or any(ord(c) < 32 for c in value):
        raise ListingError(f"{path} names an unsafe place")
    at = root
    for p in parts:  # no link on the way
        at = os.path.join(at, p)
        if os.path.islink(at) or not os.path.isdir(at):
            raise ListingError(f"{path} names no folder")
    return at


def move_pointer(path: str, root: str, target: str, order: Callable[[str], str] = os.path.basename) -> bool:
    """Point to ``target`` if it is newer than what the pointer names, or if that is broken."""
    try:
        now = read_pointer(path, root)
    except ListingError:
        now = None
    if now is not None and order(now) > order(target):
        return False
    return atomic_write(path, (os.path.relpath(target, root) + "\n").encode())


class Claim:
    """The right to move pointers of a folder: held by whoever made the claim file; others get ``held`` False. A claim older
    than ``stale`` seconds was left by a lost writer and is taken over, by one writer only."""

    def __init__(self, root: str, stale: float = 3600):
        self.path, self.stale, self.held = os.path.join(root, ".claim"), stale, False
        self.name = uuid.uuid4().hex.encode()

    def __enter__(self) -> "Claim":
        self.held = self._made()
        if not self.held:
            with contextlib.suppress(FileNotFoundError):
                if time.time() - os.stat(self.path).st_mtime > self.stale:
                    os.rename(self.path, f"{self.path}.{uuid.uuid4().hex}")  # of several writers one renames it
                    self.held = self._made()
        return self

    def _made(self) -> bool:
        """Make the claim file. Its being there is the claim, which needn't outlast the machine, so it is not synced."""
        try:
            with open(self.path, "xb") as f:
                f.write(self.name)
        except FileExistsError:
            return False
        return True

    def __exit__(self, *_) -> None:
        if self.held:
            os.unlink(self.path)


def move_together(root: str, moves: dict[str, str], expected: dict[str, str | None] | None = None) -> bool:
    """Point each pointer of ``root`` to its folder, all or none. ``expected``: what pointers must name at the moment (None:
    nothing), else nothing moves and False is returned, as it is if another writer is at work. If a move fails, those made
    before it are taken back and the error goes on."""
    with Claim(root) as claim:
        if not claim.held:
            return False
        for name, want in (expected or {}).items():
            if read_pointer(os.path.join(root, name), root) != want:
                return False
        before = []
        try:
            for name, target in moves.items():
                path = os.path.join(root, name)
                old = None
                if os.path.lexists(path):
                    with open(path, "rb") as f:
                        old = f.read()
                atomic_write(path, (os.path.relpath(target, root) + "\n").encode())
                before.append((path, old))
                read_pointer(path, root)
        except Exception:
            for path, old in reversed(before):
                if old is None:
                    os.unlink(path)
                else:
                    atomic_write(path, old)
            raise
        return True


def record_validation(root: str, target: str, success: bool, latest: str = "LATEST", validated: str = "LATEST-VALIDATED") -> bool:
    """The pointer to the latest validation always moves, that to the latest good one only on success, both or none."""
    return move_together(root, {latest: target} | ({validated: target} if success else {}))


def resolve_capture(root: str, explicit: str | None, pointers: list[str]) -> str:
    """An explicit folder, else the first pointer that exists; a broken one is an error, and is not
    passed over for the next."""
    if explicit:
        if os.path.islink(explicit) or not os.path.isdir(explicit):
            raise ListingError(f"{explicit} is no capture")
        return explicit
    for p in pointers:
        found = read_pointer(os.path.join(root, p), root)
        if found:
            return found
    raise ListingError("there is no capture")
