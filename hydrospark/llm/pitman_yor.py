"""Language-model scores from a hierarchical Pitman-Yor model.

Each context (the previous word) is a restaurant of its own, whose customers are the words
seen after it; its tables are customers of one parent restaurant, which all contexts share.

Every (word, context) pair has a home.  With a word outside the most frequent ones it is dealt
by word, so all of that word's counts, tables and its place in the parent are in one task;
with a frequent word and a context outside them, by context; with both frequent, by the pair.
Counts of frequent words and totals of frequent contexts are vectors of bounded size that are
summed between rounds; totals of all other contexts are summed at the context's home and
sent to the homes that ask for them.  Which words are frequent decides only the way, not the model.
A round is a blocked Gibbs sweep: all customers of a dish leave a restaurant and are seated
anew, given the totals of the round before.  Scores average the predictive probabilities of
several such seatings.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm import blocks_shuffle as packed
from hydrospark.llm.common import arrow_map, batch, blocks, held_out, shuffle_parts, text_bytes
from hydrospark.llm.frequent import Frequent
from hydrospark.llm.words import mix, run_starts, split_words
from hydrospark.scratch import cut

#: Words whose pairs are dealt by word and context; bounds every vector that is sent to all tasks.
CONTEXTS = 16_384
#: Seatings whose predictive probabilities are averaged.
SAMPLES = 3
STRENGTH, PARENT_STRENGTH, FIRST_DISCOUNT = 1.0, 10.0, 0.8
#: Token that ends every text; no word hashes to it but by chance.
END = np.uint64(0x8F1BBCDC6A09E667)
NO_ID = -(2**63)
#: Counted records held by a task before they are sent on.
FLUSH = 4_000_000

#: What a block holds, by kind: pairs of (rare or common word, rare or common context), pairs of two
#: rare ones at the home of the context, and totals (context, customers, tables).
RARE_COMMON, COMMON_COMMON, COMMON_RARE, RARE_RARE, ASKED, REPLY = range(6)
KINDS = 8
PAIRS = {RARE_COMMON: [np.uint64, np.uint16], COMMON_COMMON: [np.uint16, np.uint16], COMMON_RARE: [np.uint16, np.uint64],
         RARE_RARE: [np.uint64, np.uint64], ASKED: [np.uint64, np.uint64]}
TOTALS = [np.uint64, np.uint32, np.uint32]


@dataclass
class Totals:
    """What tasks know of the whole: per-context and per-frequent-word counts, and sums."""

    words: np.ndarray
    parts: int
    customers: np.ndarray | None = None
    tables: np.ndarray | None = None
    count: np.ndarray | None = None
    parent: np.ndarray | None = None
    sums: dict = field(default_factory=dict)

    @property
    def start(self) -> int:
        return len(self.words)

    @property
    def other(self) -> int:
        return len(self.words) + 1


def tokens(data, offsets, frequent: np.ndarray):
    """Word hashes with an end after each text, their contexts' hashes, the codes of both
    (``len(frequent)`` is the start of a text, one more a rare word), and the text of each."""
    words = split_words(data, offsets, lower=True)
    counts = words.counts
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts + 1, out=first[1:])
    token = np.full(first[-1], END)
    is_word = np.ones(first[-1], bool)
    is_word[first[1:] - 1] = False
    token[is_word] = words.hashes
    slot = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
    code = np.where(frequent[slot] == token, slot, len(frequent) + 1).astype(np.uint16)
    before, context = np.zeros(len(token), np.uint64), np.empty(len(token), np.uint16)
    before[1:], context[1:] = token[:-1], code[:-1]
    context[first[:-1]] = len(frequent)
    return token, before, code, context, np.repeat(np.arange(len(counts)), counts + 1)


def _kinds(token, before, code, context, other: int):
    """(kind, which tokens, word column, context column) for the kinds of pairs."""
    rare, after_rare = code == other, context == other
    for kind, pick in ((RARE_COMMON, rare & ~after_rare), (COMMON_COMMON, ~rare & ~after_rare),
                       (COMMON_RARE, ~rare & after_rare), (RARE_RARE, rare & after_rare)):
        word, ctx = PAIRS[kind]
        yield kind, pick, (token if word == np.uint64 else code)[pick], (before if ctx == np.uint64 else context)[pick]


def _frequent_tokens(batches):
    found = Frequent(1 << 18)
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        for low, high in blocks(offsets):
            found.add(split_words(data, offsets[low:high + 1], lower=True).hashes)
    keys, counts = found.above(2)
    order = np.argsort(-counts, kind="stable")[:4 * CONTEXTS]
    yield batch(pa.schema([("token", pa.int64()), ("n", pa.int64())]), keys[order].view(np.int64), counts[order])


def _at(key, parts: int) -> np.ndarray:
    """Home of a rare word, as a word and as a context."""
    return (mix(key) % np.uint64(parts)).astype(np.int64)


def _home(kind: int, word, context, parts: int) -> np.ndarray:
    if kind == COMMON_COMMON:
        with np.errstate(over="ignore"):
            pair = mix((word.astype(np.uint64) << np.uint64(16)) + context)
        home = parts + (pair % np.uint64(parts)).astype(np.int64)
    else:
        home = _at(context if kind in (COMMON_RARE, ASKED) else word, parts)
    return (home * KINDS + kind).astype(np.int32)


def _to_homes(sent: DataFrame, parts: int) -> DataFrame:
    return sent.repartition(parts, F.expr(f"bucket div {KINDS}"))


def _counted(token, context, n):
    order = np.lexsort((context, token))
    token, context, n = token[order], context[order], n[order].astype(np.int64)
    heads = run_starts(token, context)
    return token[heads], context[heads], np.add.reduceat(n, heads) if len(heads) else n


def _send_counts(batches, totals):
    """Training counts of (word, context), summed within a task before they are sent.

    Pairs of two rare words also go to the context's home, the held-out ones with a count of 0:
    their homes as words ask for the context's totals.
    """
    frequent, parts, other = totals.value.words, totals.value.parts, totals.value.other
    held, size = [], 0

    def flush():
        *of_token, train = (np.concatenate(c) for c in zip(*held, strict=True))
        for kind, pick, word, ctx in _kinds(*of_token, other):
            word, ctx, n = _counted(word, ctx, train[pick])
            for to, keep in ((kind, n > 0), (ASKED, np.ones(len(n), bool))):
                if to == kind or kind == RARE_RARE:
                    w, c = word[keep], ctx[keep]
                    yield packed.pack(_home(to, w, c, parts), np.zeros(len(w), np.int64), [], [w, c, n[keep].astype(np.uint32)])

    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        train = ~np.asarray(rows.column("held_out").cast(pa.uint8())).astype(bool)
        for low, high in blocks(offsets):
            *of_token, text = tokens(data, offsets[low:high + 1], frequent)
            held.append([*of_token, train[low:high][text]])
            size += len(text)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def seat(customers, base, pull, discount: float, rng) -> np.ndarray:
    """Tables of each dish when its customers enter one after another.

    The first opens a table; a later one opens another with probability
    ``pull * base / (pull * base + seated - discount * tables)``.  Customers are drawn in blocks
    of an eighth of those seated, within which that probability is held.
    """
    tables = (customers > 0).astype(np.float64)
    open_ = np.flatnonzero(customers > 1)
    seated, left = np.ones(len(open_)), customers[open_].astype(np.float64) - 1
    while len(open_):
        size = np.minimum(left, np.maximum(1, np.floor(seated / 8)))
        new = pull[open_] * base[open_]
        chance = new / (new + np.maximum(seated - discount * tables[open_], 1e-9))
        tables[open_] += rng.binomial(size.astype(np.int64), np.clip(chance, 0, 1))
        seated, left = seated + size, left - size
        more = left > 0
        open_, seated, left = open_[more], seated[more], left[more]
    return tables


_STATS = pa.schema([("kind", pa.int32()), ("id", pa.int32()), ("a", pa.float64()), ("b", pa.float64()),
                    ("bucket", pa.int32()), ("block", pa.binary())])
STATS = "kind int, id int, a double, b double, bucket int, block binary"
(CONTEXT, WORD, TOKENS, TYPES, CELLS, PARENT, RARE_CONTEXTS) = range(7)


def _parent_base(sums: dict) -> tuple[float, float]:
    """Base probability of a known word, and of the unknown one (V known, one unknown)."""
    unknown = sums.get("unknown", 0.5)
    return (1 - unknown) / max(1.0, sums.get("types", 1.0)), unknown


def _first_sweep(batches, totals):
    """First seating; restaurant totals are guessed.  Gives sums, and totals of rare contexts for who asks.

    Totals of common contexts are taken as this task's share times the number of tasks, those of
    rare ones as their number of words, which are all here.
    """
    totals = totals.value
    parts, contexts = totals.parts, len(totals.words) + 2
    empty = {kind: [np.zeros(0, t) for t in [*types, np.uint32]] for kind, types in PAIRS.items()}
    for home, found in _homes(batches, [], {kind: [*types, np.uint32] for kind, types in PAIRS.items()}):
        cells = empty | {kind: list(_counted(*columns)) for kind, (_, columns) in found.items()}
        rng = np.random.default_rng([1, home])
        for kind in (RARE_COMMON, COMMON_COMMON, COMMON_RARE, RARE_RARE):
            n = cells[kind][2]
            yield _stats(TOKENS, [0], [n.sum()], [0])
            yield _stats(CELLS, [0], [(n == 1).sum()], [(n == 2).sum()])
        if home >= parts:
            word, context, n = cells[COMMON_COMMON]
            count = np.bincount(word, n, contexts)
            spread = np.bincount(context, minlength=contexts)
            tables = seat(n, (count / max(1.0, n.sum()))[word], (STRENGTH + FIRST_DISCOUNT * parts * spread)[context], FIRST_DISCOUNT, rng)
            yield _sums(CONTEXT, context, n, tables)
            yield _sums(WORD, word, n, tables)
            continue
        word, n = (np.concatenate([cells[RARE_COMMON][i], cells[RARE_RARE][i]]) for i in (0, 2))
        if len(word):
            context = cells[RARE_COMMON][1]
            spread = np.bincount(context, minlength=contexts)
            pull = np.full(len(word), STRENGTH + FIRST_DISCOUNT)
            pull[:len(context)] = STRENGTH + FIRST_DISCOUNT * parts * spread[context]
            _, at = np.unique(word, return_inverse=True)
            count = np.bincount(at, n)
            tables = seat(n, count[at] / (parts * n.sum()), pull, FIRST_DISCOUNT, rng)
            yield _sums(CONTEXT, context, n[:len(context)], tables[:len(context)])
            parent = np.bincount(at, tables)
            seen = seat(parent, np.full(len(parent), 1e-7), np.full(len(parent), PARENT_STRENGTH), FIRST_DISCOUNT, rng)
            yield _stats(TYPES, [0], [len(count)], [(count == 1).sum()])
            yield _stats(PARENT, [0], [parent.sum()], [seen.sum()])
        (common, _, shown), (asking, wanted, _) = cells[COMMON_RARE], cells[ASKED]
        context, n = (np.concatenate([cells[COMMON_RARE][i], cells[ASKED][i]]) for i in (1, 2))
        if len(context):
            names, at = np.unique(context, return_inverse=True)
            guess = np.full(len(n), 1 / (parts * max(1.0, n.sum())))
            guess[:len(common)] = (np.bincount(common, shown, contexts) / max(1.0, n.sum()))[common]
            tables = seat(n, guess, STRENGTH + FIRST_DISCOUNT * np.bincount(at, n > 0)[at], FIRST_DISCOUNT, rng)
            yield _sums(WORD, common, shown, tables[:len(common)])
            customers, tables = np.bincount(at, n), np.bincount(at, tables)
            yield _stats(RARE_CONTEXTS, [0], [(customers > 0).sum()], [tables.sum()])
            # A context not told has as many customers as the pair at hand: one or none.
            told = customers[at[len(common):]] > n[len(common):]
            told |= n[len(common):] > 1
            asker, which = _at(asking[told], parts), at[len(common):][told]
            often = np.flatnonzero(customers > 1)
            asker, which = np.append(asker, np.full(len(often), home)), np.append(which, often)
            pairs = np.unique(asker * len(names) + which)
            asker, which = pairs // len(names), pairs % len(names)
            blocks_ = packed.pack((asker * KINDS + REPLY).astype(np.int32), np.zeros(len(which), np.int64), [],
                                  [names[which], customers[which].astype(np.uint32), tables[which].astype(np.uint32)])
            nothing = [pa.nulls(len(blocks_), kind.type) for kind in list(_STATS)[:4]]
            yield batch(_STATS, *nothing, *blocks_.columns)


def _sums(kind, ids, n, tables):
    used = np.unique(ids)
    return _stats(kind, used, np.bincount(ids, n)[used] if len(used) else used, np.bincount(ids, tables)[used] if len(used) else used)


def _stats(kind, ids, a, b):
    return batch(_STATS, np.full(len(ids), kind, np.int32), np.asarray(ids).astype(np.int32), np.asarray(a, float), np.asarray(b, float),
                 pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()))


def _homes(batches, owners, forms):
    """Homes of a partition: number, and owner and record columns by kind."""
    held: dict[int, dict[int, list]] = {}
    for rows in batches:
        for bucket, block in zip(rows.column("bucket").to_pylist(), rows.column("block"), strict=True):
            held.setdefault(bucket // KINDS, {}).setdefault(bucket % KINDS, []).append(block.as_buffer())
    for home in sorted(held):
        found = {}
        for kind, blocks_ in held.pop(home).items():
            got = [packed.unpack(b, owners if kind != REPLY else [], forms[kind]) for b in blocks_]
            found[kind] = ([np.concatenate(c) for c in zip(*[g[0] for g in got], strict=True)],
                           [np.concatenate(c) for c in zip(*[g[1] for g in got], strict=True)])
        yield home, found


def _send_places(batches, totals):
    """Every token of every text to the home of its pair."""
    frequent, parts, other = totals.value.words, totals.value.parts, totals.value.other
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        ids = np.asarray(rows.column("doc_id").fill_null(NO_ID))
        held = np.asarray(rows.column("held_out").cast(pa.uint8()))
        for low, high in blocks(offsets):
            *of_token, text = tokens(data, offsets[low:high + 1], frequent)
            for kind, pick, word, context in _kinds(*of_token, other):
                yield packed.pack(_home(kind, word, context, parts), text[pick], [ids[low:high], held[low:high]], [word, context])


_PART = pa.schema([("doc_id", pa.int64()), ("ends", pa.int64()), ("n", pa.int64()), ("known", pa.int64()),
                   ("base", pa.float64()), ("score", pa.float64())])
PART = "doc_id long, ends long, n long, known long, base double, score double"


def _told(names, replies, cells):
    """Customers and tables of rare contexts; one not told has ``cells`` of both."""
    known, customers, tables = replies
    if not len(known):
        return cells, cells
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    hit = known[at] == names
    return np.where(hit, customers[at], cells), np.where(hit, tables[at], cells)


def _score_places(batches, totals, samples: int):
    totals = totals.value
    parts, sums = totals.parts, totals.sums
    known_base, unknown_base = _parent_base(sums)
    discount, parent_discount = sums["discount"], sums["parent_discount"]
    out = []
    end = int(np.searchsorted(totals.words, END))
    parent_pull = PARENT_STRENGTH + parent_discount * sums["parent_tables"]

    def score(is_rare, places, room_of, seed):
        """Scores of places in order of word and context; ``room_of(contexts, n)`` gives totals of restaurants."""
        doc, held, word, context, rare_context = places
        order = np.lexsort((context, rare_context, word))
        word, context, rare_context, doc, train = word[order], context[order], rare_context[order], doc[order], held[order] == 0
        heads = run_starts(word, context, rare_context)
        size = np.diff(np.append(heads, len(word)))
        cell_word = word[heads]
        n = np.add.reduceat(train.astype(np.int64), heads)
        starts = run_starts(cell_word)
        of_word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(heads))))
        count = np.add.reduceat(n, starts) if is_rare else totals.count[cell_word[starts]]
        base = np.where(count > 0, known_base, unknown_base)
        context_customers, context_tables = room_of(context[heads], rare_context[heads], n)
        pull = STRENGTH + discount * context_tables
        room = STRENGTH + context_customers
        guess = np.maximum(count, 1e-3) / sums["tokens"]
        rng = np.random.default_rng([2, *seed])
        chance = np.zeros(len(heads))
        for _ in range(samples):
            tables = seat(n, guess[of_word], pull, discount, rng)
            customers = np.add.reduceat(tables, starts) if is_rare else totals.parent[cell_word[starts]]
            seen = seat(customers, base, np.full(len(starts), parent_pull), parent_discount, rng)
            parent = (np.maximum(customers - parent_discount * seen, 0) + parent_pull * base) / (PARENT_STRENGTH + sums["parent_customers"])
            guess = parent
            chance += (np.maximum(n - discount * tables, 0) + pull * parent[of_word]) / room
        score = np.repeat(np.log10(chance / samples), size)
        known = np.repeat((count > 0)[of_word], size)
        plain = np.repeat(np.log10((count + 1) / (sums["tokens"] + sums["types"] + 1))[of_word], size)
        ends = (word == end) if not is_rare else np.zeros(len(word), bool)
        out.append(_by_doc(doc, ends, np.ones(len(doc)), known, plain, score))
        return cell_word[starts][count > 0]

    of_common = lambda context: (totals.customers[context], totals.tables[context])
    for home, found in _homes(batches, [np.int64, np.uint8], PAIRS | {REPLY: TOTALS}):
        replies = found.pop(REPLY, (None, [np.zeros(0, t) for t in TOTALS]))[1]
        order = np.argsort(replies[0], kind="stable")
        replies = [c[order] for c in replies]
        column = lambda kind, flag: [*found[kind][0], found[kind][1][0], found[kind][1][1].astype(np.uint64),
                                     np.full(len(found[kind][1][0]), flag)]
        if COMMON_COMMON in found:
            score(False, column(COMMON_COMMON, False), lambda context, rare, n: of_common(context), [home, 0])

        def by_word(context, rare, n):
            told, tables = (c.astype(float) for c in _told(context, replies, n))
            code = np.where(rare, 0, context).astype(np.int64)
            customers_, tables_ = of_common(code)
            return np.where(rare, told, customers_), np.where(rare, tables, tables_)

        here = [column(kind, kind == RARE_RARE) for kind in (RARE_COMMON, RARE_RARE) if kind in found]
        seen = np.zeros(0, np.uint64)
        if here:
            seen = score(True, [np.concatenate(c) for c in zip(*here, strict=True)], by_word, [home, 1])
        if COMMON_RARE in found:
            # A rare word is followed by one token each time, so it has customers where it has a count.
            score(False, column(COMMON_RARE, True),
                  lambda context, rare, n: _told(context, replies, np.isin(context, seen).astype(np.int64)), [home, 2])
    if out:
        doc, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
        doc, ends, n, known, plain, score_ = _by_doc(doc, *columns)
        yield packed.pack_by_key(doc, [ends.astype(np.uint32), n.astype(np.uint32), known.astype(np.uint32), plain, score_], 2 * parts)


def _sum_parts(batches):
    """One row per document from its parts."""
    for (doc,), fields in packed.gather(batches, [np.int64], [np.uint32, np.uint32, np.uint32, np.float64, np.float64]):
        doc, *sums = _by_doc(doc, *fields)
        yield batch(_PART, doc, *[c.astype(np.int64) for c in sums[:3]], *sums[3:])


def _by_doc(doc, *columns):
    order = np.argsort(doc, kind="stable")
    heads = run_starts(doc[order])
    return doc[order][heads], *[np.add.reduceat(c[order].astype(np.float64), heads) for c in columns]


def _learn(docs: DataFrame, parts: int, contexts: int) -> tuple[Totals, DataFrame]:
    """Frequent words, then one sweep over all training counts for the restaurants' totals.

    The totals of rare contexts come as blocks for the homes that ask for them.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.where("NOT held_out").select("text")
    top = arrow_map(texts, _frequent_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = top.orderBy(F.desc("n"), "token").limit(contexts - 1).collect()
    words = np.unique(np.append(np.array([r.token for r in rows], np.int64).view(np.uint64), END))
    totals = Totals(words, parts)
    shared = context.broadcast(totals)
    sent = arrow_map(docs.select("text", "held_out"), partial(_send_counts, totals=shared), packed.SCHEMA)
    learned = cut(arrow_map(_to_homes(sent, parts), partial(_first_sweep, totals=shared), STATS))
    # At most a row per common context and frequent word comes back.
    rows = learned.where("block IS NULL").groupBy("kind", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    size = len(words) + 2
    totals.customers, totals.tables = np.zeros(size), np.zeros(size)
    totals.count, totals.parent = np.zeros(size), np.zeros(size)
    one = {r.kind: (r.a, r.b) for r in rows if r.kind not in (CONTEXT, WORD)}
    for r in rows:
        if r.kind == CONTEXT:
            totals.customers[r.id], totals.tables[r.id] = r.a, r.b
        elif r.kind == WORD:
            totals.count[r.id], totals.parent[r.id] = r.a, r.b
    return _finish(totals, one), learned.where("block IS NOT NULL").select("bucket", "block")


def _finish(totals: Totals, one: dict) -> Totals:
    n, _ = one.get(TOKENS, (0, 0))
    rare_types, rare_once = one.get(TYPES, (0, 0))
    once, twice = one.get(CELLS, (0, 0))
    customers, tables = one.get(PARENT, (0, 0))
    common = totals.count > 0
    types = rare_types + common.sum()
    discount = min(0.95, max(0.1, once / max(1.0, once + 2 * twice)))
    parent_customers = customers + totals.parent.sum()
    parent_tables = tables + common.sum()
    parent_discount = min(0.95, max(0.1, rare_once / max(1.0, types)))
    rare_contexts, rare_tables = one.get(RARE_CONTEXTS, (0, 0))
    restaurants = (totals.customers > 0).sum() + rare_contexts
    escape = (STRENGTH * restaurants + discount * (totals.tables.sum() + rare_tables)) / max(1.0, n + STRENGTH * restaurants)
    novel = (PARENT_STRENGTH + parent_discount * parent_tables) / (PARENT_STRENGTH + parent_customers)
    # The unknown word's base gives it the share of words seen once (Good-Turing) in all.
    unknown = rare_once / max(1.0, n) / max(1e-12, escape * novel)
    totals.sums = {
        "tokens": float(n), "types": float(types), "discount": discount, "parent_discount": parent_discount,
        "parent_customers": float(parent_customers), "parent_tables": float(parent_tables),
        "unknown": float(min(0.95, max(1 / (types + 1), unknown))) if n else 1.0,
    }
    return totals


def score_texts(docs: DataFrame, modulus: int, remainder: int, contexts: int = CONTEXTS, samples: int = SAMPLES) -> DataFrame:
    """log10 probabilities of every whole text, learning from the rows not held out.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Held out are rows whose
    crc32(doc_id as text) leaves ``remainder`` (a null id never does).  Words are lower-cased (A-Z); each
    text is its words and one end.  A null or empty text is an end alone.  Rows with one id
    are scored together and get their mean (for repeated rows: each its own score).  An empty table
    gives no rows; without training rows every word is unknown.

    ``contexts`` bounds the vectors sent to all tasks; every context has a restaurant of its own.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", held_out("doc_id", modulus, remainder))
    parts = shuffle_parts(docs)
    session = docs.sparkSession
    totals, replies = _learn(docs, parts, contexts)
    shared = session.sparkContext.broadcast(totals)
    sent = arrow_map(docs, partial(_send_places, totals=shared), packed.SCHEMA)
    scored = arrow_map(_to_homes(sent.unionByName(replies), parts), partial(_score_places, totals=shared, samples=samples), packed.SCHEMA)
    sums = arrow_map(scored.repartition(parts, "bucket"), _sum_parts, PART)
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "ends")))
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return sums.select(doc_id.alias("doc_id"), "ends", "n", "known", "base", "score").select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"),
        F.expr("n div ends").alias("n_tokens"), F.expr("known div ends").alias("n_known"),
        F.lit(int(totals.sums["tokens"])).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"), (F.col("score") / F.col("ends")).alias("score"))
