"""Repeated passages by prefix-partitioned suffix trees.

Suffixes (from every word on) are split by their first words into groups that fit a task.
Prefixes have a variable length: a group whose prefix is too frequent is split by more words.
A task sorts its suffixes and reads the common prefixes of neighbours; the runs at least
``window`` words deep are the deep internal nodes of the group's suffix tree, and their
leaves are the places where a passage repeats.

Words are carried as hashes of three blocks that make up a window (the edges of the tree
down to the depth asked for), so a suffix is some 20 bytes.  Most suffixes are unique and are
ruled out beforehand: a window can repeat only where its minimizer, the least hash among
its shorter grams, occurs in two documents.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm import blocks_shuffle as packed
from hydrospark.llm.common import arrow_map, batch, blocks, shuffle_parts, text_bytes
from hydrospark.llm.frequent import Frequent
from hydrospark.llm.words import gram_hashes, mix, run_starts, split_words, window_starts
from hydrospark.scratch import cut

#: Words of a gram from which minimizers are chosen; longer grams rule out more, shorter ones move less.
GRAM = 8
#: Suffixes that may share a prefix before the prefix grows by a block of words.
GROUP_SUFFIXES = 1_000_000

_PLAIN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("level", pa.int32()),
                    ("prefix", pa.int64()), ("suffixes", pa.int64())])
PLAIN = "doc_id long, th long, n_words long, sha string, level int, prefix long, suffixes long"
_HELD = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("held", pa.binary())])
HELD = "doc_id long, th long, held binary"
_ZIPPED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("zipped", pa.binary())])
ZIPPED = "doc_id long, th long, zipped binary"
_KEPT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()), ("kept", pa.string())])
KEPT = "doc_id long, th long, n_words long, n_removed long, sha string, kept string"


def _splits(window: int) -> tuple[int, int, int]:
    """Sizes of the three blocks of words that make up a window."""
    a = -(-window // 3)
    b = -(-(window - a) // 2)
    return a, b, window - a - b


def _edges(words, at, window: int) -> list[np.ndarray]:
    """Hashes of the three blocks of each window."""
    out, shift = [], 0
    for size in _splits(window):
        out.append(gram_hashes(words.hashes, size)[at + shift] if len(at) else np.zeros(0, np.uint64))
        shift += size
    return out


def _prefixes(edges) -> list[np.ndarray]:
    """Hash of the first one, two and three blocks."""
    with np.errstate(over="ignore"):
        one = mix(edges[0])
        two = mix(one + edges[1])
        return [one, two, mix(two + edges[2])]


def _minimizers(words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its start, its text, and the least gram hash in it."""
    at, text = window_starts(words, window)
    if not len(at):
        return at, text, np.zeros(0, np.uint64)
    grams = gram_hashes(words.hashes, gram)
    least = grams[at]
    for j in range(1, window - gram + 1):
        np.minimum(least, grams[at + j], out=least)
    return at, text, least


def _survey(batches, window: int, least: float):
    """Per text its words and the hash of its words; per task its frequent prefixes."""
    frequent = [Frequent() for _ in range(3)]
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        doc_ids, th = rows.column("doc_id"), rows.column("th")
        for low, high in blocks(offsets):
            words = split_words(data, offsets[low:high + 1], lower=False)
            at, _ = window_starts(words, window)
            for level, prefix in enumerate(_prefixes(_edges(words, at, window))):
                frequent[level].add(prefix)
            shas = [hashlib.sha256(b" ".join(data[offsets[d]:offsets[d + 1]].tobytes().split())).hexdigest() for d in range(low, high)]
            none = pa.nulls(high - low, pa.int64())
            yield batch(_PLAIN, doc_ids[low:high], th[low:high], words.counts, shas, pa.nulls(high - low, pa.int32()), none, none)
    for level, found in enumerate(frequent):
        keys, counts = found.above(least)
        none = pa.nulls(len(keys), pa.int64())
        yield batch(_PLAIN, none, none, none, pa.nulls(len(keys), pa.string()), np.full(len(keys), level, np.int32), keys.view(np.int64), counts)


def _keys(rows) -> list[np.ndarray]:
    """What names a row: its id and the hash of its text."""
    return [np.asarray(rows.column("doc_id")), np.asarray(rows.column("th"))]


def _part(keys: list[np.ndarray], at) -> list[np.ndarray]:
    return [k[at] for k in keys]


def _zip(batches):
    """Texts compressed one by one, for the way to their places."""
    press = zstandard.ZstdCompressor(level=3).compress
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        held = [press(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield batch(_ZIPPED, rows.column("doc_id"), rows.column("th"), held)


def _unzipped(column: pa.Array) -> list[bytes]:
    unpress = zstandard.ZstdDecompressor().decompress
    return [unpress(z) for z in column.to_pylist()]


def _half(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _send_minimizers(batches, window: int, gram: int, buckets: int):
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        keys = _keys(rows)
        for low, high in blocks(offsets):
            words = split_words(data, offsets[low:high + 1], lower=False)
            _, text, least = _minimizers(words, window, gram)
            order = np.lexsort((least, text))
            text, least = text[order], least[order]
            fresh = run_starts(text, least)
            text, least = text[fresh], least[fresh]
            # Half of a minimizer besides its bucket: a chance match only lets a window through to be compared.
            yield packed.pack((least % np.uint64(buckets)).astype(np.int32), text, _part(keys, slice(low, high)), [_half(least)])


def _collect(batches, kind):
    """One row per text with all its values as bytes, from blocks by text."""
    for keys, (values,) in packed.gather(batches, [np.int64, np.int64], [kind]):
        order = np.lexsort(keys[::-1])
        keys, values = _part(keys, order), values[order]
        heads = run_starts(*keys)
        ends = np.append(heads[1:], len(values))
        yield batch(_HELD, *_part(keys, heads), [values[a:b].tobytes() for a, b in zip(heads, ends, strict=True)])


def _by_text(sent: DataFrame, kind, parts: int) -> DataFrame:
    return arrow_map(sent.repartition(parts, "bucket"), partial(_collect, kind=kind), HELD)


def _shared_minimizers(batches, buckets: int):
    for (doc, th), (least,) in packed.gather(batches, [np.int64, np.int64], [np.uint32]):
        order = np.lexsort((th, doc, least))
        doc, th, least = doc[order], th[order], least[order]
        heads = run_starts(least)
        many = np.diff(np.append(heads, len(least)))
        shared = np.repeat(doc[heads] != doc[heads + many - 1], many)
        yield packed.pack_by_key([doc[shared], th[shared]], [least[shared]], buckets)


def _candidates(rows, window: int, gram: int):
    """Windows of a batch whose minimizer is shared: block by block (keys, words, starts, texts)."""
    texts = _unzipped(rows.column("zipped"))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    keys = _keys(rows)
    held = rows.column("held").to_pylist()
    for low, high in blocks(offsets):
        words = split_words(data, offsets[low:high + 1], lower=False)
        at, text, least = _minimizers(words, window, gram)
        least = _half(least)
        keep = np.zeros(len(at), bool)
        first = np.searchsorted(text, np.arange(high - low + 1))
        for d in range(high - low):
            shared = np.sort(np.frombuffer(held[low + d], np.uint32))
            part = least[first[d]:first[d + 1]]
            keep[first[d]:first[d + 1]] = shared[np.minimum(np.searchsorted(shared, part), len(shared) - 1)] == part
        yield _part(keys, slice(low, high)), words, at[keep], text[keep]


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _send_suffixes(batches, window: int, gram: int, buckets: int, frequent):
    """Suffixes to the group of their prefix: as many blocks long as it takes to be rare enough."""
    often = frequent.value
    for rows in batches:
        for keys, words, at, text in _candidates(rows, window, gram):
            edges = _edges(words, at, window)
            prefixes = _prefixes(edges)
            group = prefixes[0].copy()
            deeper = _is_in(prefixes[0], often[0])
            group[deeper] = prefixes[1][deeper]
            deeper &= _is_in(prefixes[1], often[1])
            group[deeper] = prefixes[2][deeper]
            at, text = at - words.first[text], text
            # A whole window that is still too frequent is a leaf class of its own, settled by _leaders.
            alone = deeper & _is_in(prefixes[2], often[2])
            keep = ~alone
            # The first edge whole and half of the others: 128 bits to tell windows apart by.
            yield packed.pack((mix(group[keep]) % np.uint64(buckets)).astype(np.int32), text[keep], keys,
                              [at[keep].astype(np.uint32), edges[0][keep], *[_half(e[keep]) for e in edges[1:]]])


def _frequent_places(batches, window: int, gram: int, often):
    """Windows that are frequent as a whole: least document per window, seen by one task."""
    often = often.value[2]
    schema = pa.schema([("prefix", pa.int64()), ("doc_id", pa.int64())])
    for rows in batches:
        for (ids, _), words, at, text in _candidates(rows, window, gram):
            prefix = _prefixes(_edges(words, at, window))[2]
            hit = _is_in(prefix, often)
            prefix, doc = prefix[hit], ids[text[hit]]
            order = np.lexsort((doc, prefix))
            prefix, doc = prefix[order], doc[order]
            heads = run_starts(prefix)
            yield batch(schema, prefix[heads].view(np.int64), doc[heads])


def _frequent_repeats(batches, window: int, gram: int, buckets: int, leaders):
    """Places of frequent windows in documents after the first one."""
    known, first = leaders.value
    for rows in batches:
        for keys, words, at, text in _candidates(rows, window, gram):
            prefix = _prefixes(_edges(words, at, window))[2]
            slot = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
            hit = (known[slot] == prefix) & (keys[0][text] > first[slot])
            yield packed.pack_by_key(_part(keys, text[hit]), [(at - words.first[text])[hit].astype(np.uint32)], buckets)


def _deep_nodes(batches, buckets: int):
    """Places under nodes at least a window deep, in documents after the node's first one."""
    for (doc, th), (at, a, b, c) in packed.gather(batches, [np.int64] * 2, [np.uint32, np.uint64, np.uint32, np.uint32]):
        order = np.lexsort((doc, c, b, a))
        doc, th, at, a, b, c = doc[order], th[order], at[order], a[order], b[order], c[order]
        # Neighbours in this order have a common prefix of 0 to 3 blocks; 3 is a deep node.
        common = np.zeros(len(a), np.int8)
        common[1:] = np.where(a[1:] != a[:-1], 0, np.where(b[1:] != b[:-1], 1, np.where(c[1:] != c[:-1], 2, 3)))
        heads = np.flatnonzero(common < 3)
        first = np.repeat(doc[heads], np.diff(np.append(heads, len(doc))))
        later = doc > first
        yield packed.pack_by_key([doc[later], th[later]], [at[later]], buckets)


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words some window covers."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges)[:n_words] > 0


def _rewrite(batches, window: int, with_text: bool):
    for rows in batches:
        texts, held = _unzipped(rows.column("zipped")), rows.column("held").to_pylist()
        total, removed, shas, kept = [], [], [], []
        for text, places in zip(texts, held, strict=True):
            words = text.split()
            gone = covered(len(words), np.frombuffer(places, np.uint32).astype(np.int64), window)
            left = b" ".join(compress(words, ~gone))
            total.append(len(words))
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode() if with_text else None)
        yield batch(_KEPT, rows.column("doc_id"), rows.column("th"), total, removed, shas, kept)


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = True, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Remove every word that lies in a passage already begun in an earlier document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A window is
    ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one text; the words of
    a window that also starts in a document with a smaller id go.  Judged on the input as a whole.
    Null and short texts have no window and stay.  Rows with one id count as one document and
    are each rewritten by their own text; rows without an id stay as they are and take nothing away.

    Returns ``doc_id, n_words, n_removed, kept_sha256``, ``th`` (xxhash64 of the text) and, with ``with_text``, ``kept``: the words
    left, joined by one space, for documents that lost some (null: the text stays).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    gram = min(GRAM, window)
    scan = docs.rdd.getNumPartitions()
    parts = shuffle_parts(docs)
    context = docs.sparkSession.sparkContext
    survey = cut(arrow_map(docs, partial(_survey, window=window, least=group_suffixes / scan), PLAIN))
    heavy = survey.where("level IS NOT NULL").groupBy("level", "prefix").agg(F.sum("suffixes").alias("n")).where(
        F.col("n") >= group_suffixes / 2).collect()  # at most 2 / group_suffixes of all suffixes
    often = [np.sort(np.array([r.prefix for r in heavy if r.level == k], np.int64).view(np.uint64)) for k in range(3)]
    frequent = context.broadcast(often)

    named = docs.where("doc_id IS NOT NULL")
    sent = arrow_map(named, partial(_send_minimizers, window=window, gram=gram, buckets=2 * parts), packed.SCHEMA)
    shared = arrow_map(sent.repartition(parts, "bucket"), partial(_shared_minimizers, buckets=parts), packed.SCHEMA)
    shared = cut(_by_text(shared, np.uint32, parts))
    zipped = arrow_map(named, _zip, ZIPPED)
    marked = zipped.join(shared, ["doc_id", "th"])
    if len(often[2]):
        marked = cut(marked)  # read three times
    groups = arrow_map(marked, partial(_send_suffixes, window=window, gram=gram, buckets=2 * parts, frequent=frequent), packed.SCHEMA)
    repeats = arrow_map(groups.repartition(parts, "bucket"), partial(_deep_nodes, buckets=parts), packed.SCHEMA)
    if len(often[2]):
        seen = arrow_map(marked, partial(_frequent_places, window=window, gram=gram, often=frequent), "prefix long, doc_id long")
        first = sorted((r.prefix % 2**64, r.doc_id) for r in seen.groupBy("prefix").agg(F.min("doc_id").alias("doc_id")).collect())
        leaders = context.broadcast((np.array([p for p, _ in first], np.uint64), np.array([d for _, d in first], np.int64)))
        repeats = repeats.unionByName(arrow_map(
            marked, partial(_frequent_repeats, window=window, gram=gram, buckets=parts, leaders=leaders), packed.SCHEMA)) if first else repeats
    repeats = cut(_by_text(repeats, np.uint32, parts))

    changed = arrow_map(zipped.join(repeats, ["doc_id", "th"]), partial(_rewrite, window=window, with_text=with_text), KEPT)
    plain = survey.where("level IS NULL").join(repeats, ["doc_id", "th"], "left_anti").select(
        "doc_id", "th", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", F.lit(None).cast("string").alias("kept"))
    out = plain.unionByName(changed).withColumnRenamed("sha", "kept_sha256")
    return out if with_text else out.drop("kept")


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a column ``n_chars`` follows, all others stay.

    No row is lost: rows that share an id keep a text each, rows without an id their text.
    """
    changed = remove_repeats(docs, window).where("kept IS NOT NULL").select("doc_id", "th", "kept").dropDuplicates(["doc_id", "th"])
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(changed, ["doc_id", "th"], "left")
    kept, row = F.col("kept"), F.col("row")
    new = {"text": F.coalesce(kept, row["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNull(), row["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])
