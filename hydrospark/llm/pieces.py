"""Encoding to and decoding from sub-word pieces by a unigram model.

Pieces and scores come from a vocabulary file (never trained here).  A double-array trie
over their bytes finds all pieces that start at a position; Viterbi picks the cut with
the greatest total log score, and bytes no piece covers become byte pieces.  Since no
piece has a space marker after another character, a best cut of a text is the
concatenation of best cuts of its units (markers and the word that follows), so each
distinct unit of a block is cut once, all of them side by side in array operations.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import arrow_map, batch, blocks, text_bytes
from hydrospark.llm.words import span_hashes

MARKER = "▁".encode()
#: Bytes that UTF-8 never has stand for a marker character of the text itself; it is spelled in byte pieces.
LITERAL = bytes([0xF8, 0xF9, 0xFA])
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: How far below the worst piece a byte piece scores, so that it is taken only where nothing else fits.
BYTE_GAP = 10.0
#: Distinct units remembered between blocks of one task; forgotten together when exceeded.
REMEMBERED = 400_000


def _fields(data: bytes):
    """Number, wire type and value of each field of a protocol buffer message."""
    at = 0

    def varint(at):
        shift = value = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        yield tag >> 3, kind, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, stored score, type) of each id of a SentencePiece model file."""
    with open(path, "rb") as file:
        data = file.read()
    found = []
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for field, _, content in _fields(value):
                if field == 1:
                    piece = content.decode()
                elif field == 2:
                    score = float(np.frombuffer(content, "<f4")[0])
                elif field == 3:
                    kind = content
            found.append((piece, score, kind))
    return found


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Log scores for a file whose scores are only ranks (0, -1, -2, ...): frequency as 1 / (rank + 1)."""
    ranks = [-s for _, s, kind in pieces if kind == NORMAL]
    total = float(np.log(np.sum(1.0 / (np.array(ranks) + 1.0))))
    return [(p, float(-np.log(1.0 - s) - total) if kind == NORMAL else s, kind) for p, s, kind in pieces]


@dataclass
class Model:
    """A double-array trie: the child of state ``s`` by byte ``b`` is ``base[s] + b`` if ``check`` there is ``s``."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # id of the piece that ends at a state, or -1
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    bytes_of: list[bytes]
    longest: int


def build_model(pieces: list[tuple[str, float, int]]) -> Model:
    texts = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
    if any(MARKER in p.lstrip(MARKER) for p in texts):
        raise ValueError("a piece has a space marker after another character")
    scores = np.array([s for _, s, _ in pieces])
    low = min(scores[list(texts.values())]) - BYTE_GAP
    byte_ids, bytes_of, unknown = np.full(256, -1), [], 0
    for i, (p, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_ids[int(p[3:-1], 16)] = i
            scores[i] = low
            bytes_of.append(bytes([int(p[3:-1], 16)]))
        else:
            unknown = i if kind == UNKNOWN else unknown
            bytes_of.append(p.encode().replace(MARKER, b" ") if kind == NORMAL else b"")
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    byte_ids[list(LITERAL)] = byte_ids[list(MARKER)]
    children: list[dict[int, int]] = [{}]
    ends = {}
    for text, i in texts.items():
        node = 0
        for b in text:
            node = children[node].setdefault(b, len(children))
            if node == len(children):
                children.append({})
        ends[node] = i
    base, check, piece = [0] * 1024, [-1] * 1024, [-1] * 1024
    place, free, tail = {0: 0}, 257, 1  # single children fill the first gap, families search from the last one placed
    check[0] = 0
    for node, down in enumerate(children):  # parents come before their children
        if not down:
            continue
        keys = sorted(down)
        at = max(1, (free if len(keys) == 1 else tail) - keys[0])
        while True:
            if at + 256 >= len(check):
                grow = len(check)
                base += [0] * grow
                check += [-1] * grow
                piece += [-1] * grow
            if all(check[at + k] < 0 for k in keys):
                break
            at += 1
        state = place[node]
        base[state] = at
        tail = max(tail, at) if len(keys) > 1 else tail
        for k in keys:
            check[at + k] = state
            place[down[k]] = at + k
            piece[at + k] = ends.get(down[k], -1)
        while check[free] >= 0:
            free += 1
    return Model(np.array(base + [0] * 256, np.int64), np.array(check + [-1] * 256, np.int64),
                 np.array(piece + [-1] * 256, np.int64), scores, byte_ids, unknown, bytes_of, max(map(len, texts)))


def best_cuts(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of many units side by side: all ids one after another, and how many each unit has.

    Works on cells (unit, position), forward by position; of equal totals the cut whose last
    piece starts earliest wins.
    """
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    begin, length = starts[order], size[order]
    first = np.zeros(len(order) + 1, np.int64)
    np.cumsum(length + 1, out=first[1:])
    total, came, took = np.full(first[-1], -np.inf), np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int32)
    total[first[:-1]] = 0.0
    byte_score = model.scores[model.byte_ids[0]]
    for i in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length, -i, "left"))  # units longer than i
        unit = np.arange(active)
        cell = first[:active] + i
        here = total[cell]
        byte = data[begin[:active] + i]
        target = cell + 1
        better = here + byte_score > total[target]
        at = target[better]
        total[at], came[at], took[at] = here[better] + byte_score, i, model.byte_ids[byte[better]]
        # A piece starts only at a character's first byte; elsewhere only bytes go on.
        unit = unit[(byte & 0xC0) != 0x80]
        state = np.zeros(len(unit), np.int64)
        for depth in range(model.longest):
            inside = length[unit] > i + depth
            unit, state = unit[inside], state[inside]
            if not len(unit):
                break
            child = model.base[state] + data[begin[unit] + i + depth]
            known = (model.check[child] == state) & (child > 0)
            unit, state = unit[known], child[known]
            piece = model.piece[state]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                cell, ids = first[unit[hit]] + i, piece[hit]
                target, value = cell + depth + 1, total[cell] + model.scores[ids]
                better = value > total[target]
                at = target[better]
                total[at], came[at], took[at] = value[better], i, ids[better]
    counts, where = np.zeros(len(order), np.int64), length.copy()
    steps = []
    unit = np.flatnonzero(where > 0)
    while len(unit):
        cell = first[unit] + where[unit]
        steps.append((unit, took[cell]))
        counts[unit] += 1
        where[unit] = came[cell]
        unit = unit[where[unit] > 0]
    into = np.zeros(len(order) + 1, np.int64)
    out_counts = np.zeros(len(order), np.int64)
    out_counts[order] = counts
    np.cumsum(out_counts, out=into[1:])
    ids = np.zeros(into[-1], np.int32)
    for back, (unit, piece) in enumerate(steps):  # pieces were met last to first
        ids[into[order[unit]] + counts[unit] - 1 - back] = piece
    return ids, out_counts


def marked_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with spaces turned into markers, and one marker before every text that isn't empty."""
    text = data[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    literal = np.flatnonzero((text[:-2] == MARKER[0]) & (text[1:-1] == MARKER[1]) & (text[2:] == MARKER[2]))
    if len(literal):
        text = text.copy()
        for j, byte in enumerate(LITERAL):
            text[literal + j] = byte
    filled = np.diff(bounds) > 0
    grow = np.ones(len(text), np.int64)
    grow[text == 0x20] = 3
    heads = bounds[:-1][filled]
    lead = np.zeros(len(text) + 1, np.int64)
    lead[heads] = 3
    at = np.cumsum(grow + lead[:-1]) - grow
    total = int(grow.sum() + lead.sum())
    out = np.empty(total, np.uint8)
    out[at] = text
    marks = np.concatenate([at[text == 0x20], at[heads] - 3])
    for j, byte in enumerate(MARKER):
        out[marks + j] = byte
    return out, (np.append(at, total) - lead)[bounds]


def unit_bounds(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: each run of markers together with what follows up to the next run."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    mark = np.zeros(n, bool)
    mark[:n - 2] = (text[:n - 2] == MARKER[0]) & (text[1:n - 1] == MARKER[1]) & (text[2:] == MARKER[2])
    after = np.zeros(n, bool)
    after[3:] = mark[:-3]
    begins = mark & ~after
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes blocks of texts; remembers the cuts of units it has met."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.remembered = model, remembered
        self.forget()

    def forget(self):
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the first id of each text."""
        text, bounds = marked_text(data, offsets)
        begins = unit_bounds(text, bounds)
        ends = np.append(begins[1:], len(text))
        keys = span_hashes(text, begins, ends)
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.remembered:
            self.forget()
        new = np.ones(len(distinct), bool)
        if len(self.known):
            spot = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = self.known[spot] != distinct
        fresh = at[new]
        ids, counts = best_cuts(self.model, text, begins[fresh], ends[fresh])
        entries = np.concatenate([self.place, len(self.first) - 1 + np.arange(len(fresh))])
        known = np.concatenate([self.known, distinct[new]])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], entries[order]
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        entry = self.place[np.searchsorted(self.known, distinct)][which]
        low, size = self.first[entry], self.first[entry + 1] - self.first[entry]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        picked = np.repeat(low - upto[:-1], size) + np.arange(upto[-1])
        return self.ids[picked], upto[np.searchsorted(begins, bounds)]


def decode(model: Model, ids) -> str:
    """Text of a list of ids: pieces with markers as spaces, byte pieces joined as UTF-8, without the leading space."""
    return b"".join([model.bytes_of[i] for i in ids])[1:].decode("utf-8", "replace")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("pieces", pa.list_(pa.int32())),
                  ("pieces_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])
OUT = ("doc_id long, n_pieces long, n_bytes long, pieces array<int>, pieces_sha256 string, decoded_sha256 string, exact boolean")


def _encode(batches, model, with_pieces: bool):
    model = model.value
    encoder = Encoder(model)
    is_byte = np.zeros(len(model.bytes_of), np.int64)
    is_byte[model.byte_ids] = 1
    spelled = np.array(model.bytes_of, object)
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        doc_ids = rows.column("doc_id")
        for low, high in blocks(offsets):
            ids, first = encoder.encode(data, offsets[low:high + 1])
            fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
            written = spelled[ids].tolist()
            shas, decoded, exact = [], [], []
            for d in range(high - low):
                a, b = first[d], first[d + 1]
                shas.append(hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest())
                text = b"".join(written[a:b])[1:]
                decoded.append(hashlib.sha256(text).hexdigest())
                exact.append(text == data[offsets[low + d]:offsets[low + d + 1]].tobytes())
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)) if with_pieces else pa.nulls(
                high - low, pa.list_(pa.int32()))
            yield batch(_OUT, doc_ids[low:high], np.diff(first), fallback[first[1:]] - fallback[first[:-1]], lists,
                        shas, decoded, exact)


def encode_pieces(docs: DataFrame, pieces: list[tuple[str, float, int]], with_pieces: bool = True) -> DataFrame:
    """Pieces of every whole text and a check of the way back.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Spaces become markers and
    one marker leads each text; every other character is kept as it is.  A null or empty text
    has no pieces.  ``exact`` says whether decoding gave the text back.  Repeated rows give
    repeated rows; an empty table none.  ``n_bytes`` counts byte pieces.
    The model, a vocabulary of fixed size, is the only thing sent to every task.
    """
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(build_model(pieces))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, partial(_encode, model=model, with_pieces=with_pieces), OUT)
