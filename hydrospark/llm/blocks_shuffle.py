"""Moving many small records between tasks in packed blocks.

A record has one or more fixed-width fields and belongs to an owner (a text); each
block holds, for one bucket, its owners, how many records each has, and the records'
columns.  That is some 8 bytes a record where a row of its own would take 40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from hydrospark.llm.words import mix, run_starts

SCHEMA = "bucket int, block binary"
ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])


def pack(bucket: np.ndarray, owner: np.ndarray, owners: list[np.ndarray], fields: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks of the records; ``owner`` (ascending) indexes the columns ``owners``."""
    order = np.argsort(bucket, kind="stable")
    bucket, owner, fields = bucket[order], owner[order], [f[order] for f in fields]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(bucket))).astype(np.uint32)
    head_bucket, head_owner = bucket[heads], owner[heads]
    cuts = np.flatnonzero(np.append(True, head_bucket[1:] != head_bucket[:-1])) if len(heads) else heads
    out = []
    for low, high in zip(cuts, np.append(cuts, len(heads))[1:], strict=True):
        a, b = heads[low], heads[high] if high < len(heads) else len(bucket)
        out.append(b"".join([
            np.uint32(high - low).tobytes(), np.uint32(b - a).tobytes(), sizes[low:high].tobytes(),
            *[o[head_owner[low:high]].tobytes() for o in owners], *[f[a:b].tobytes() for f in fields],
        ]))
    return pa.RecordBatch.from_arrays([pa.array(head_bucket[cuts], pa.int32()), pa.array(out, pa.binary())], schema=ARROW)


def unpack(block, owners: list, fields: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Owner columns repeated for each record, and the records' columns."""
    n, m = np.frombuffer(block, np.uint32, 2)
    sizes = np.frombuffer(block, np.uint32, n, 8)
    at, who, what = 8 + 4 * int(n), [], []
    for kind in owners:
        who.append(np.repeat(np.frombuffer(block, kind, n, at), sizes))
        at += int(n) * np.dtype(kind).itemsize
    for kind in fields:
        what.append(np.frombuffer(block, kind, m, at))
        at += int(m) * np.dtype(kind).itemsize
    return who, what


def gather(batches: Iterator[pa.RecordBatch], owners: list, fields: list) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """All records of one partition at once; nothing for an empty partition."""
    parts = [unpack(block.as_buffer(), owners, fields) for rows in batches for block in rows.column("block")]
    if parts:
        yield ([np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True)],
               [np.concatenate(c) for c in zip(*[p[1] for p in parts], strict=True)])


def pack_by_key(keys: np.ndarray | list[np.ndarray], fields: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Blocks that bring records of one key (one or more 64-bit numbers) together again."""
    keys = keys if isinstance(keys, list) else [keys]
    order = np.lexsort(keys[::-1])
    keys, fields = [k[order] for k in keys], [f[order] for f in fields]
    heads = run_starts(*keys)
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys[0]))))
    home = mix(keys[0].view(np.uint64)) % np.uint64(buckets)
    return pack(home.astype(np.int32), owner, [k[heads] for k in keys], fields)
