"""Benchmark passages in texts: q-gram lemma filtering and banded alignment.

An occurrence of an item of ``m`` characters with at most ``k`` edits shares at least
``m - q + 1 - k * q`` q-grams with it, on diagonals that differ by at most ``k``.  Shared
q-grams are counted in overlapping bands of diagonals; a band below the bound cannot hold
an occurrence.  The rest are aligned within their band.

Texts never move: the benchmark goes to them, in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import arrow_map, batch, blocks, keep_texts, text_bytes
from hydrospark.llm.words import GRAM_FACTORS, mix, run_starts

Q = 8
#: Edits allowed per character of an item.
EDIT_RATE = 0.1
#: Characters of benchmark sent to the tasks at once; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
#: Slots of the table that rules out most q-grams of a text at once (a power of two).
SIEVE_BITS = 22

REGION = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("regions", pa.list_(REGION))])
OUT = "doc_id long, regions array<struct<item_id:long,start:long,end:long,edits:int>>"
_MORE = pa.schema([_OUT.field(0), ("text", pa.string()), _OUT.field(1)])
MORE = OUT.replace("regions", "text string, regions", 1)


def code_points(raw: bytes) -> np.ndarray:
    """Code points with A-Z lowered and every white space as a space; one for one with the text's."""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    points[(points >= 0x41) & (points <= 0x5A)] += 32
    points[(points >= 0x09) & (points <= 0x0D)] = 0x20
    return points


def gram_keys(points: np.ndarray, q: int) -> np.ndarray:
    size = max(0, len(points) - q + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size, np.uint64)
        for j in range(q):
            total += points[j:j + size] * GRAM_FACTORS[j]
        return mix(total)


@dataclass
class Index:
    """q-grams of one block of benchmark items."""

    items: list[tuple[int, np.ndarray]]
    edits: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    #: Items too short for a q-gram: found as whole words only.
    short: list[tuple[int, np.ndarray]]


def build_index(items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    """The edit budget is ``rate`` of the length, and at most what keeps the lemma's bound at 1 or
    more: none under ``2 * q`` characters.  Items under ``q`` characters are matched exactly, as whole words."""
    seen = [(i, code_points(text.strip().encode())) for i, text in items]
    kept, short = [(i, p) for i, p in seen if len(p) >= q], [(i, p) for i, p in seen if 0 < len(p) < q]
    length = np.array([len(p) for _, p in kept], np.int64)
    edits = np.minimum((length * rate).astype(np.int64), (length - q) // q)
    grams = [gram_keys(p, q) for _, p in kept]
    keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[distinct >> np.uint64(64 - SIEVE_BITS)] = True
    return Index(kept, edits, length - q + 1 - edits * q, distinct, np.append(first, len(keys)), item[order], place[order], sieve, short)


def align(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Best occurrence of ``item`` in ``text`` with at most ``most`` edits: (edits, start, end).

    Row by row over the item; a text may start and end anywhere in the band.  Of equal
    distances the leftmost end wins.
    """
    n = len(text)
    spot = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), spot.copy()
    big = n + len(item) + 1
    for c in item:
        step = np.full(n + 1, big)
        origin = np.zeros(n + 1, np.int64)
        step[1:] = cost[:-1] + (text != c)
        origin[1:] = begin[:-1]
        down = cost + 1 < step
        step[down], origin[down] = cost[down] + 1, begin[down]
        # Gaps in the item run rightwards: the least of (cost - place) so far.
        ahead = (step - spot) * (n + 1) + (n - spot)
        best = np.minimum.accumulate(ahead)
        source = n - best % (n + 1)
        cost, begin = step[source] + spot - source, origin[source]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= most else None


def find_regions(index: Index, points: np.ndarray, bounds: np.ndarray, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, start, end, edits) in a block of texts; starts count from the text's own."""
    keys = gram_keys(points, q)
    at = np.flatnonzero(index.sieve[keys >> np.uint64(64 - SIEVE_BITS)])
    if not len(at) or not len(index.keys):
        return []
    slot = np.minimum(np.searchsorted(index.keys, keys[at]), len(index.keys) - 1)
    true = index.keys[slot] == keys[at]
    at, slot = at[true], slot[true]
    many = index.first[slot + 1] - index.first[slot]
    entry = np.repeat(index.first[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())
    item, place, at = index.item[entry], index.place[entry], np.repeat(at, many)
    width = np.maximum(index.edits, 1)[item]
    band = (at - place) // width
    # A hit counts in the band it begins and in the one before, which overlaps it.
    both = np.concatenate([band, band - 1]) + (1 << 30)
    key = (np.concatenate([item, item]).astype(np.int64) << 32) | both
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = run_starts(key)
    count = np.diff(np.append(heads, len(key)))
    retained = np.flatnonzero(count >= index.least[key[heads] >> 32])
    found: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for r in retained:
        k = key[heads[r]]
        i, b = int(k >> 32), int(k & 0xFFFFFFFF) - (1 << 30)
        hits = order[heads[r]:heads[r] + count[r]] % len(at)
        # The bound holds for distinct q-grams of the item and for distinct places in the text.
        if min(len(np.unique(place[hits])), len(np.unique(at[hits]))) < index.least[i]:
            continue
        item_id, pattern = index.items[i]
        wide, most = max(int(index.edits[i]), 1), int(index.edits[i])
        low, high = b * wide - most, b * wide + 2 * wide + len(pattern) + most
        diagonals, times = np.unique(at[hits] - place[hits], return_counts=True)
        straight = int(diagonals[np.argmax(times)])
        for d in range(max(0, int(np.searchsorted(bounds, max(low, 0), "right")) - 1), len(bounds) - 1):
            if bounds[d] >= high:
                break
            a, z = max(low, int(bounds[d])), min(high, int(bounds[d + 1]))
            if z - a < len(pattern) - most:
                continue
            if a <= straight <= z - len(pattern) and np.array_equal(points[straight:straight + len(pattern)], pattern):
                best = (0, straight - a, straight - a + len(pattern))
            else:
                best = align(pattern, points[a:z], most)
            if best:
                edits, start, end = best
                start, end = start + a - int(bounds[d]), end + a - int(bounds[d])
                slot = (d, i, end // max(1, len(pattern)))
                if slot not in found or (edits, start, end) < found[slot]:
                    found[slot] = (edits, start, end)
    spans = sorted((d, index.items[i][0], start, end, edits) for (d, i, _), (edits, start, end) in found.items())
    out: list[tuple[int, int, int, int, int]] = []
    for span in spans:  # one occurrence seen from two bands is one region
        if out and out[-1][:2] == span[:2] and span[2] < out[-1][3]:
            if span[4] < out[-1][4]:
                out[-1] = span
        else:
            out.append(span)
    return out


def short_regions(index: Index, points: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The same for items under ``q`` characters; neither neighbour may be a letter, a digit or an underscore."""
    if not index.short:
        return []
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = (points >= 0x80) | (points == 0x5F)
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        letter[1:-1] |= (points >= low) & (points < high)
    # Texts lie side by side: an edge of a text is a border whatever lies beyond.
    begins, ends = np.zeros(len(points) + 1, bool), np.zeros(len(points) + 1, bool)
    begins[bounds[:-1]] = ends[bounds[1:]] = True
    out = []
    for item_id, pattern in index.short:
        m = len(pattern)
        at = np.flatnonzero(points[:max(0, len(points) - m + 1)] == pattern[0])
        for j in range(1, m):
            at = at[points[at + j] == pattern[j]]
        at = at[(begins[at] | ~letter[at]) & (ends[at + m] | ~letter[at + m + 1])]
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + m <= bounds[text + 1]
        out += [(int(d), item_id, int(a - bounds[d]), int(a - bounds[d]) + m, 0) for d, a in zip(text[inside], at[inside])]
    return out


def _block_regions(texts: pa.Array, index: Index, q: int):
    """Regions of every text of a column, block by block: (low, high, regions per text)."""
    data, offsets = text_bytes(texts)
    for low, high in blocks(offsets):
        raw = data[offsets[low]:offsets[high]]
        heads = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        bounds = heads[offsets[low:high + 1] - offsets[low]]
        regions: list[list[dict]] = [[] for _ in range(high - low)]
        points = code_points(raw.tobytes())
        for d, item, start, end, edits in [*find_regions(index, points, bounds, q), *short_regions(index, points, bounds)]:
            regions[d].append({"item_id": item, "start": start, "end": end, "edits": edits})
        yield low, high, regions


def _search(batches, index, q: int, more: bool):
    """Adds an index's regions to those of the passes before; with ``more`` passes to come the texts go along."""
    for rows in batches:
        before = rows.column("regions").to_pylist() if "regions" in rows.schema.names else None
        for low, high, regions in _block_regions(rows.column("text"), index.value, q):
            if before:
                known = lambda r: (r["item_id"] is not None, r["item_id"], r["start"], r["end"], r["edits"])
                regions = [sorted([*old, *new], key=known) for old, new in zip(before[low:high], regions)]
            held = [rows.column("doc_id")[low:high], *([rows.column("text")[low:high]] if more else []), regions]
            yield batch(_MORE if more else _OUT, *held)


def _is_clean(texts: pa.Array, state) -> list[bool]:
    index, q = state
    return [not r for _, _, regions in _block_regions(texts, index.value, q) for r in regions]


def _indexes(benchmark: DataFrame, q: int, rate: float, block_chars: int):
    """Broadcast indexes of the benchmark's blocks, each of about ``block_chars`` characters."""
    items = benchmark.where("text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    passes = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for b in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == b).orderBy("item_id", "text")
        yield benchmark.sparkSession.sparkContext.broadcast(
            build_index([(r.item_id, r.text) for r in block.toLocalIterator()], q, rate))


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` without any leaked region, all columns unchanged; no row moves."""
    for index in _indexes(benchmark, q, rate, block_chars):
        docs = keep_texts(docs, _is_clean, (index, q))
    return docs


def leaked_regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, regions``: where each whole text holds a benchmark item within the edit budget.

    ``docs`` needs ``doc_id, text``, ``benchmark`` needs ``item_id, text``; other columns are
    ignored.  Case (A-Z) and the kind of white space don't count as edits.  Null and empty texts have
    no regions; null and empty items are not searched.  Repeated
    documents each get a row; repeated items are each reported.  With an empty benchmark every
    document has none.  A benchmark above ``block_chars`` characters is searched in blocks,
    one pass over the texts each, so what a task holds stays bounded.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexes = list(_indexes(benchmark, q, rate, block_chars))
    for number, index in enumerate(indexes, 1):
        more = number < len(indexes)
        found = arrow_map(found, partial(_search, index=index, q=q, more=more), MORE if more else OUT)
    return found
