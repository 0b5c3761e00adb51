"""What homes and buckets tell each other: packed, sorted, distinct hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import bytekit as K

HASHES = "bucket int, home int, hashes binary, flags binary"
REPLY = "home int, lost binary, multi binary"


def say(home: int, buckets: int, found: np.ndarray, flags: np.ndarray, docs: np.ndarray | None = None) -> pa.Table:
    """One row per bucket: sorted hashes, for each whether the home has it twice, and ids."""
    cut = K.cuts(found, buckets)
    rows = [(b, i, j) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
    cols = {
        "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
        "home": pa.array([home] * len(rows), pa.int32()),
        "hashes": pa.array([K.blob(found[i:j]) for _, i, j in rows], pa.binary()),
        "flags": pa.array([K.blob(np.packbits(flags[i:j])) for _, i, j in rows], pa.binary()),
    }
    if docs is not None:
        cols["docs"] = pa.array([K.blob(docs[i:j]) for _, i, j in rows], pa.binary())
    return pa.table(cols)


def heard(t: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Homes, their hashes and flags, as a bucket got them."""
    hashes = [np.frombuffer(b, K.U) for b in t.column("hashes").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(h)).astype(bool) for f, h in zip(t.column("flags").to_pylist(), hashes, strict=True)]
    return t.column("home").to_pylist(), hashes, flags


def reply(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    rows = [r for r in rows if len(r[1]) or len(r[2])]
    return pa.table({"home": pa.array([r[0] for r in rows], pa.int32()), "lost": pa.array([K.blob(r[1]) for r in rows], pa.binary()), "multi": pa.array([K.blob(r[2]) for r in rows], pa.binary())})
