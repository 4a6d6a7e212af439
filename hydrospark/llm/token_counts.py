"""Token counts per section of a text, from one encoding of the whole text.

Encoding sections one by one would change tokens at their borders.  Here a text is encoded
once; the byte lengths of its tokens give every token's span, and a sorted interval join
of spans with section borders allots the tokens.
"""

from __future__ import annotations

import base64
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import arrow_map, batch, blocks, text_bytes

#: What happens to a token that crosses section borders: it goes to the section of its first byte,
#: of its last byte, or of most of its bytes (ties: the earlier); or each section gets its share of bytes.
RULES = ("first", "last", "largest", "share")

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()),
                  ("section_tokens", pa.list_(pa.float64()))])
OUT = "doc_id long, n_tokens long, n_crossing long, section_tokens array<double>"

_encoders: dict[str, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a byte-level BPE vocabulary file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _encoder(name: str, vocabulary):
    """Encoder and byte length of each id, made once per worker."""
    if name not in _encoders:
        import tiktoken

        pattern, ranks = vocabulary.value
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(token) for token in ranks]
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[name]


def line_borders(text: bytes) -> np.ndarray:
    """Section starts where every line, with its line feed, is a section; and the text's end."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    return np.unique(np.concatenate([[0], feeds, [len(text)]]))


def byte_borders(text: str, cuts: list[int]) -> np.ndarray:
    """Section starts given in code points, as byte offsets; and the text's end."""
    points = np.frombuffer(text.encode(), np.uint8)
    at = np.append(np.flatnonzero((points & 0xC0) != 0x80), len(points))
    inside = [c for c in cuts if c is not None and 0 < c < len(at) - 1]
    return np.unique(np.concatenate([[0], at[inside] if inside else [], [len(points)]])).astype(np.int64)


def allot(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens cross a border.

    Token ``k`` spans ``[ends[k - 1], ends[k])``; section ``s`` spans ``[borders[s], borders[s + 1])``.
    """
    sections = len(borders) - 1
    if sections < 1 or not len(ends):
        return np.zeros(max(sections, 0)), 0
    starts = np.append(0, ends[:-1])
    low = np.searchsorted(borders, starts, "right") - 1
    high = np.searchsorted(borders, ends - 1, "right") - 1
    crossing = np.flatnonzero(low != high)
    home = low.copy()
    counts = np.zeros(sections)
    if rule == "last":
        home = high
    elif rule in ("largest", "share"):
        if rule == "share":
            home = np.delete(home, crossing)
        for k in crossing:
            cuts = borders[low[k]:high[k] + 2].clip(starts[k], ends[k])
            parts = np.diff(cuts)
            if rule == "share":
                counts[low[k]:high[k] + 1] += parts / (ends[k] - starts[k])
            else:
                home[k] = low[k] + int(np.argmax(parts))
    return counts + np.bincount(home, minlength=sections), len(crossing)


def _count(batches, name, vocabulary, rule, cut_column):
    encoder, lengths = _encoder(name, vocabulary)
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        doc_ids = rows.column("doc_id")
        cuts = rows.column("cuts").to_pylist() if cut_column else None
        for low, high in blocks(offsets):
            tokens, crossing, allotted = [], [], []
            for d in range(low, high):
                raw = data[offsets[d]:offsets[d + 1]].tobytes()
                text = raw.decode()
                ends = np.cumsum(lengths[encoder.encode_to_numpy(text, disallowed_special=())])
                borders = line_borders(raw) if cuts is None else byte_borders(text, cuts[d] or [])
                counts, crossed = allot(ends, borders, rule)
                tokens.append(len(ends))
                crossing.append(crossed)
                allotted.append(counts)
            first = np.cumsum([0, *map(len, allotted)])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(allotted)))
            yield batch(_OUT, doc_ids[low:high], tokens, crossing, lists)


def section_token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, rule: str = "largest",
                         cuts: str | None = None) -> DataFrame:
    """Tokens of every whole text, and of each of its sections.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Sections are lines (with
    their line feed), or, with ``cuts``, the stretches between the code point offsets in
    that array column (offsets outside the text, null and repeated ones are ignored).  A token
    across borders is allotted by ``rule`` (see ``RULES``), so a text's sections always sum to
    its ``n_tokens``.  A null or empty text has 0 tokens and no section.  Repeated rows give
    repeated rows; an empty table none.  The vocabulary, of fixed size, is sent to every task.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = docs.sparkSession.sparkContext.broadcast((pattern, ranks))
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if cuts:
        chosen.append(F.col(cuts).cast("array<int>").alias("cuts"))
    name = f"ranks-{len(ranks)}-{hash(pattern)}"
    return arrow_map(docs.select(*chosen), partial(_count, name=name, vocabulary=vocabulary, rule=rule, cut_column=cuts), OUT)
