"""Object stores: framing, compression, and storing a batch with its manifest."""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import tempfile
from typing import Protocol

import zstandard

from tallyrill.functions.digests import authentic, canonical, signed  # noqa: F401


def frame(records: list[bytes], verbatim: bool = False) -> bytes:
    """Records one after the other, each ended by one line feed unless verbatim."""
    return b"".join(r if verbatim or r.endswith(b"\n") else r + b"\n" for r in records)


def compress(data: bytes, codec: str, level: int) -> bytes:
    """gzip (level 0 to 9), zstd (1 to 22) or none; levels outside are moved to the nearest."""
    if codec == "gzip":
        return gzip.compress(data, min(max(level, 0), 9), mtime=0)
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=min(max(level, 1), 22)).compress(data)
    if codec == "none":
        return data
    raise ValueError(codec)


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.decompress(data)
    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if codec == "zstd" else data


class Backend(Protocol):
    def put(self, key: str, data: bytes) -> None: ...
    def get(self, key: str, at_most: int | None = None) -> bytes: ...
    def size(self, key: str) -> int | None: ...
    def delete(self, key: str) -> None: ...


class LocalBackend:
    """Objects as files below a folder that all executors share; an object appears whole or not at all."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def _path(self, key: str) -> str:
        path = os.path.normpath(os.path.join(self.root, key))
        if not path.startswith(self.root + os.sep):
            raise ValueError(f"key leaves the store: {key}")
        return path

    def put(self, key: str, data: bytes) -> None:
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, part = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, path)
        except BaseException:
            if os.path.exists(part):
                os.unlink(part)
            raise

    def get(self, key: str, at_most: int | None = None) -> bytes:
        with open(self._path(key), "rb") as f:
            return f.read() if at_most is None else f.read(at_most)

    def size(self, key: str) -> int | None:
        path = self._path(key)
        return os.path.getsize(path) if os.path.isfile(path) else None

    def delete(self, key: str) -> None:
        path = self._path(key)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.unlink(path)


def verify(backend: Backend, key: str, size: int, digest: str | None) -> str:
    """passed, limited (sizes agree and there is no digest) or failed; one byte over the size is read at most."""
    stored = backend.size(key)
    if stored != size:
        return "failed"
    if digest is None:
        return "limited"
    return "passed" if hashlib.sha256(backend.get(key, size + 1)).hexdigest() == digest.lower() else "failed"


def store_batch(backend: Backend, batch_id: str, records: list[bytes], progress: dict, codec: str = "zstd", level: int = 3, verbatim: bool = False, key: bytes | None = None) -> dict:
    """Store a batch and its manifest, read both back, and return the ledger row; the state says how far it came.

    Storing the same batch again replaces equal bytes by equal bytes, so a task that
    is run twice does no harm.
    """
    raw = frame(records, verbatim)
    packed = compress(raw, codec, level)
    digest = hashlib.sha256(packed).hexdigest()
    ext = {"gzip": ".gz", "zstd": ".zst", "none": ""}[codec]
    object_key, manifest_key = f"{batch_id}.raw{ext}", f"{batch_id}.manifest.json"
    manifest = signed({"batch_id": batch_id, "object": object_key, "records": len(records), "raw_bytes": len(raw), "object_bytes": len(packed), "object_sha256": digest, "progress": progress}, key)
    body = _json(manifest)
    row = {"batch_id": batch_id, "state": "checksummed", "records": len(records), "raw_bytes": len(raw), "object_bytes": len(packed), "object_sha256": digest, "manifest_sha256": manifest["sha256"]}
    backend.put(object_key, packed)
    row["state"] = "object_uploaded"
    backend.put(manifest_key, body)
    row["state"] = "manifest_uploaded"
    good = verify(backend, object_key, len(packed), digest) == "passed" and backend.get(manifest_key, len(body) + 1) == body
    row["state"] = "verified" if good else "failed"
    return row


def _json(manifest: dict) -> bytes:
    import json

    return json.dumps(manifest, separators=(",", ":"), ensure_ascii=False).encode()


def verify_stored(backend: Backend, batch_id: str, key: bytes | None = None) -> str:
    """The verdict on a stored batch, from its manifest: passed, failed, or missing without one."""
    import json

    name = f"{batch_id}.manifest.json"
    if backend.size(name) is None:
        return "missing"
    manifest = json.loads(backend.get(name))
    if not authentic(manifest, key) or manifest["batch_id"] != batch_id:
        return "failed"
    return verify(backend, manifest["object"], manifest["object_bytes"], manifest["object_sha256"])
