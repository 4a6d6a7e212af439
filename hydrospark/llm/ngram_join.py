"""N-gram Jaccard join by a token-group matrix.

Texts become sets of word shingles.  Similar sets form groups; a sparse matrix holds, for
each shingle, the groups whose union has it.  The share of a set that lies in a group's
union bounds its similarity to every member, so only groups whose bound reaches the
threshold are opened and compared exactly.

Two exact reductions come first.  Equal sets collapse to their least document.  And a
set more than ``1 - threshold`` of whose shingles occur in no other set can link to
nothing (the union of all others is the first bound): counting on a fixed slice of the
hash space drops most sets before their full shingles are ever moved.

Links are counted without being written as pairs where sets share a group: a group is dealt
into blocks of bounded size, and a task counts what two blocks have in common.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.llm import blocks_shuffle as packed
from hydrospark.llm.common import arrow_map, as_long, batch, blocks, shuffle_parts, text_bytes
from hydrospark.llm.links import components
from hydrospark.llm.words import mix, run_starts, shingles, split_words
from hydrospark.scratch import cut
from hydrospark.tiling import lookup_salted

#: Share of the hash space counted in the first reduction; must exceed 1 - threshold to drop anything.
SLICE = 0.3
#: Group keys per set: sets with an equal least hash under any of them are compared first.
GROUP_KEYS = 3
#: Ratio between the sizes of neighbouring classes of sets.
CLASS_STEP = 1.02
#: Shingles and sets of a block of a group: a task compares the sets of two blocks at once.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 17, 1 << 10
#: Shingles per step of such a comparison.
STEP_SHINGLES = 1 << 11

_HEADS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64())])
_SETS = pa.schema([*_HEADS, ("tokens", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_LINKED = pa.schema([("rep", pa.int64()), ("links", pa.int64())])
_ALONE = pa.schema([("fp1", pa.int64()), ("n", pa.int64()), ("alone", pa.int64())])


def _per_text(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    """``how`` (a ufunc) over the values of each text; 0 where a text has none."""
    out = np.zeros(len(first) - 1, values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = how.reduceat(values, first[some])
    return out


def _block_sets(data, offsets, size: int):
    """Shingles of a block of texts: (text, token), first token of each text, and two set fingerprints."""
    words = split_words(data, offsets, lower=True)
    text, tokens = shingles(words, size)
    first = np.searchsorted(text, np.arange(len(offsets)))
    with np.errstate(over="ignore"):
        fp1 = _per_text(mix(tokens), first, np.add)
        fp2 = _per_text(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), first, np.add)
    return text, tokens, first, fp1, fp2


def _heads(batches, size: int):
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        ids = rows.column("doc_id")
        for low, high in blocks(offsets):
            _, _, first, fp1, fp2 = _block_sets(data, offsets[low:high + 1], size)
            yield batch(_HEADS, ids[low:high], np.diff(first), as_long(fp1), as_long(fp2))


def _sets(batches, size: int):
    """Whole sets with their group keys."""
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        ids = rows.column("doc_id")
        for low, high in blocks(offsets):
            _, tokens, first, fp1, fp2 = _block_sets(data, offsets[low:high + 1], size)
            keys = [_per_text(mix(tokens ^ np.uint64(i + 1)), first, np.minimum) for i in range(GROUP_KEYS)]
            keys = as_long(np.stack(keys, axis=1).reshape(-1))
            yield batch(
                _SETS, ids[low:high], np.diff(first), as_long(fp1), as_long(fp2),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(as_long(tokens))),
                pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * GROUP_KEYS, pa.int32()), pa.array(keys)))


def _pack_tokens(text, tokens, first, fp1, share: float, buckets: int):
    n = np.diff(first).astype(np.uint32)
    if share < 1:
        keep = tokens < np.uint64(int(share * 2**64))
        text, tokens = text[keep], tokens[keep]
    return packed.pack((tokens % np.uint64(buckets)).astype(np.int32), text, [fp1, n], [tokens])


def _send_texts(batches, size: int, share: float, buckets: int):
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        for low, high in blocks(offsets):
            text, tokens, first, fp1, _ = _block_sets(data, offsets[low:high + 1], size)
            yield _pack_tokens(text, tokens, first, fp1, share, buckets)


def _send_sets(batches, buckets: int):
    for rows in batches:
        sets = rows.column("tokens")
        first = np.asarray(sets.offsets).astype(np.int64)
        tokens = np.asarray(sets.values)[first[0]:first[-1]].view(np.uint64)
        first = first - first[0]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        fp1 = np.asarray(rows.column("fp1")).view(np.uint64)
        yield _pack_tokens(text, tokens, first, fp1, 1.0, buckets)


def _count_alone(batches, buckets: int):
    """Per set, how many of a partition's shingles no other set has; in blocks by set."""
    for (fp, n), (tokens,) in packed.gather(batches, [np.uint64, np.uint32], [np.uint64]):
        order = np.lexsort((fp, tokens))
        fp, n, tokens = fp[order], n[order], tokens[order]
        pairs = run_starts(tokens, fp)
        fp, n, tokens = fp[pairs], n[pairs], tokens[pairs]
        heads = run_starts(tokens)
        single = heads[np.diff(np.append(heads, len(tokens))) == 1]
        sets, at, alone = np.unique(fp[single], return_index=True, return_counts=True)
        yield packed.pack_by_key(sets, [n[single][at], alone.astype(np.uint32)], buckets)


def _sum_alone(batches, threshold: int, every: bool):
    """Sets with shingles of their own; without ``every``, only those that can't reach the threshold."""
    for (fp,), (n, alone) in packed.gather(batches, [np.uint64], [np.uint32, np.uint32]):
        order = np.lexsort((n, fp))
        fp, n, alone = fp[order], n[order].astype(np.int64), alone[order].astype(np.int64)
        heads = run_starts(fp, n)
        fp, n, alone = fp[heads], n[heads], np.add.reduceat(alone, heads) if len(heads) else alone
        keep = every | (100 * (n - alone) < threshold * n)
        yield batch(_ALONE, as_long(fp[keep]), n[keep], alone[keep])


def _shingles_alone(sent: DataFrame, parts: int, threshold: int, every: bool = False) -> DataFrame:
    """``fp1, n, alone``: sets by how many of the shingles sent no other set has."""
    counted = arrow_map(sent.repartition(parts, "bucket"), partial(_count_alone, buckets=parts), packed.SCHEMA)
    return arrow_map(counted.repartition(parts, "bucket"), partial(_sum_alone, threshold=threshold, every=every), "fp1 long, n long, alone long")


def _least_shared(n: F.Column, threshold: int) -> F.Column:
    """Fewest shingles a set of ``n`` must share: the ceiling of threshold percent."""
    return F.ceil(n * threshold / 100)


def _similar(threshold: int) -> F.Column:
    shared = F.size(F.array_intersect("q_tokens", "tokens"))
    return shared * 100 >= (F.col("q_n") + F.col("n") - shared) * threshold


def _size_fits(threshold: int) -> F.Column:
    return (F.col("q_n") * 100 >= F.col("n") * threshold) & (F.col("n") * 100 >= F.col("q_n") * threshold)


def _leader_links(core: DataFrame, threshold: int) -> DataFrame:
    """Verified links of each set to the leader among those sharing one of its group keys.

    The set with the fewest shingles of its own leads: of a text and its altered copies, the text.
    """
    keyed = core.select("rep", "alone", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min(F.struct("alone", "rep")).alias("lead"), F.count("*").alias("members"))
    leaders = leaders.where("members > 1").select("key", F.col("lead.rep").alias("q_rep"))
    pairs = keyed.join(leaders, "key").where("rep <> q_rep").select("rep", "q_rep").distinct()
    led = core.select(F.col("rep").alias("q_rep"), F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens"))
    met = pairs.join(core.select("rep", "n", "tokens"), "rep").join(led, "q_rep")
    return met.where(_size_fits(threshold)).where(_similar(threshold)).select("rep", "q_rep")


def _size_class(n: F.Column) -> F.Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_STEP))


def _opened(core: DataFrame, threshold: int) -> DataFrame:
    """(query, group) pairs whose overlap bound reaches the threshold; core has rep, n, tokens, grp.

    A query meets partners of its size or larger.  Sets of sizes q <= s within the threshold
    share ``t / (100 + t) * (q + s)`` shingles; in one common order of shingles (in few groups
    first) the shares' least one then lies among the first ``q - shared + 1`` of the query's and
    the first ``s - shared + 1`` of the partner's.  Only those enter the matrix, by classes of
    the query's size, so that copies of one text meet only where they differ little.
    """
    share = threshold / (100 + threshold)
    shared_least = lambda q, s: F.ceil((q + s) * share - 1e-9)
    spread = core.select("rep", "n", "grp", F.explode("tokens").alias("token"))
    groups = spread.select("token", "grp").distinct().groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    near = cut(spread.join(groups, "token"))
    matrix = near.select("token", "grp").distinct()
    # Shingles in their own group alone come first in the order and lead nowhere.
    own = near.groupBy("rep").agg(F.count("*").alias("outside"))
    placed = near.join(own, "rep").withColumn("place", F.col("n") - F.col("outside") + F.row_number().over(
        W.partitionBy("rep").orderBy("groups", "token"))).where(F.col("place") <= F.col("n") - _least_shared(F.col("n"), threshold) + 1)
    placed = cut(placed.select("rep", "n", "grp", "token", "place"))
    least = _least_shared(F.col("n"), threshold)
    classes = placed.withColumn("size_class", F.explode(F.sequence(_size_class(least), _size_class(F.col("n")))))
    smallest = F.greatest(F.floor(F.pow(F.lit(CLASS_STEP), F.col("size_class")) - 1e-6), least)
    partners = classes.where(F.col("place") <= F.col("n") - shared_least(smallest, F.col("n")) + 1).select(
        "token", "size_class", "grp", F.col("n").alias("s"), F.col("place").alias("s_place")).distinct()
    probes = placed.where(F.col("place") <= F.col("n") - shared_least(F.col("n"), F.col("n")) + 1).select(
        "rep", "n", "place", F.col("grp").alias("q_grp"), "token", _size_class(F.col("n")).alias("size_class"))
    # Within a class of sizes the two sizes at hand decide.
    left = shared_least(F.col("n"), F.col("s")) - 1
    fits = (F.col("s") >= F.col("n")) & (F.col("place") + left <= F.col("n")) & (F.col("s_place") + left <= F.col("s"))
    met = probes.join(partners, ["token", "size_class"]).where((F.col("grp") != F.col("q_grp")) & fits)
    members = core.groupBy("grp").agg(F.count("*").alias("members"))
    met = cut(met.groupBy("rep", "grp").agg(F.min("s").alias("s")).join(members, "grp"))
    # The bound of a group of one is the overlap that opening it computes.
    bound = met.where("members > 1").join(near.select("rep", "n", "token"), "rep").join(matrix, ["token", "grp"])
    reached = bound.groupBy("rep", "grp", "n", "s").agg(F.count("*").alias("overlap")).where(
        F.col("overlap") >= shared_least(F.col("n"), F.col("s")))
    return met.where("members = 1").select("rep", "grp").unionByName(reached.select("rep", "grp"))


def _opened_links(core: DataFrame, opened: DataFrame, threshold: int) -> DataFrame:
    """Links of queries to members of opened groups that are no smaller (ties: have the larger id)."""
    query = core.select(F.col("rep").alias("q_rep"), F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens"))
    asked = opened.withColumnRenamed("rep", "q_rep").join(query, "q_rep")
    met = asked.join(core.select("rep", "n", "tokens", "grp"), "grp")
    later = (F.col("n") > F.col("q_n")) | ((F.col("n") == F.col("q_n")) & (F.col("rep") > F.col("q_rep")))
    return met.where(later & _size_fits(threshold)).where(_similar(threshold)).select("rep", "q_rep")


def _common(x, y) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``; both are (tokens, set of each token, number of sets)."""
    (tx, sx, nx), (ty, sy, ny) = x, y
    known = np.intersect1d(tx, ty)
    out = np.zeros((nx, ny))
    if not len(known):
        return out

    def placed(tokens, owner):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        hit = known[at] == tokens
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    def dense(at, owner, n, low, high):
        a, b = np.searchsorted(at, (low, high))
        held = np.zeros((n, high - low), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        return held

    px, py = placed(tx, sx), placed(ty, sy)
    for low in range(0, len(known), STEP_SHINGLES):
        high = min(low + STEP_SHINGLES, len(known))
        out += dense(*px, nx, low, high) @ dense(*py, ny, low, high).T
    return out


def _count_links(batches, threshold: int):
    """For each row, one block of a group or two: the copies of the sets that each of its sets links with."""
    for rows in batches:
        pairs = rows.column("blocks")
        sets = pairs.values.values
        ends, inner = np.asarray(pairs.offsets), np.asarray(pairs.values.offsets)
        rep, copies, size = (np.asarray(sets.field(c)) for c in ("rep", "copies", "n"))
        lists = sets.field("tokens")
        first, tokens = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
        found, counts = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            sides = []
            for low, high in zip(inner[a:b], inner[a + 1:b + 1], strict=True):
                owner = np.repeat(np.arange(high - low), np.diff(first[low:high + 1]))
                sides.append((slice(low, high), (tokens[first[low]:first[high]], owner, int(high - low))))
            (x, held_x), (y, held_y) = sides[0], sides[-1]
            shared = _common(held_x, held_y)
            linked = 100 * shared >= threshold * (size[x][:, None] + size[y][None, :] - shared)
            if len(sides) == 1:
                np.fill_diagonal(linked, False)
            else:
                found.append(rep[y])
                counts.append(linked.T @ copies[x])
            found.append(rep[x])
            counts.append(linked @ copies[y])
        if found:
            found, counts = np.concatenate(found), np.concatenate(counts)
            yield batch(_LINKED, found[counts > 0], counts[counts > 0])


def _links_inside(grouped: DataFrame, copies: DataFrame, threshold: int) -> DataFrame:
    """(rep, links): the copies of the sets linked with a set in its own group.

    A group of many sets becomes blocks; every two of its blocks, and each alone, are one
    task's row.  What is moved and compared grows with the links looked at, what a task holds does not.
    """
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1").select(
        "grp", F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("of"))
    dealt = lookup_salted(grouped, sizes, ["grp"], F.col("rep")).where("of IS NOT NULL").join(copies, "rep")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    sets = F.collect_list(F.struct("rep", "copies", "n", "tokens")).alias("sets")
    block = cut(dealt.groupBy("grp", "of", "block").agg(sets))
    other = block.where("of > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    pairs = other.groupBy("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(
        F.collect_list("sets").alias("blocks")).where("i = j OR size(blocks) = 2").select("blocks")
    tasks = block.where("of = 1").select(F.array("sets").alias("blocks")).unionByName(pairs)
    return arrow_map(tasks, partial(_count_links, threshold=threshold), "rep long, links long")


def ngram_jaccard_components(docs: DataFrame, shingle: int = 5, threshold: int = 80, count_links: bool = False) -> DataFrame:
    """Classes of documents linked by word-shingle Jaccard similarity.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Words are lower-cased
    (A-Z) runs of non-space bytes; a text of fewer than ``shingle`` words is one shingle, and
    one without words (or null) is empty and linked with nothing.  Two documents link when
    ``100 * |intersection| >= threshold * |union|``.  Rows of one ``doc_id`` each keep a row;
    a null id is a row with a null class.  An empty table gives an empty result.

    Returns ``doc_id, n_shingles, component_id``: the least id reachable by links; with ``count_links``
    also ``n_links``, the other rows (of an id) that a row links with: copies and altered copies alike.
    Texts under one id count as one node there too; a null id has a null count.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = shuffle_parts(docs)
    heads = cut(arrow_map(docs, partial(_heads, size=shingle), "doc_id long, n long, fp1 long, fp2 long"))
    reps = heads.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    share = SLICE if SLICE * 100 > 100 - threshold else 1.0
    sent = arrow_map(docs, partial(_send_texts, size=shingle, share=share, buckets=2 * parts), packed.SCHEMA)
    hopeless = cut(_shingles_alone(sent, parts, threshold).select("fp1", "n"))
    hopeful = reps.join(hopeless, ["fp1", "n"], "left_anti").select(F.col("rep").alias("doc_id")).distinct()
    whole = arrow_map(
        docs.join(hopeful, "doc_id", "left_semi"), partial(_sets, size=shingle),
        "doc_id long, n long, fp1 long, fp2 long, tokens array<long>, keys array<long>")
    sets = cut(whole.dropDuplicates(["n", "fp1", "fp2"]).withColumnRenamed("doc_id", "rep"))

    sent = arrow_map(sets.select("fp1", "tokens"), partial(_send_sets, buckets=2 * parts), packed.SCHEMA)
    alone = _shingles_alone(sent, parts, threshold, every=True)
    core = cut(sets.join(alone, ["fp1", "n"], "left").withColumn("alone", F.coalesce("alone", F.lit(0))).where(
        F.col("n") - F.col("alone") >= _least_shared(F.col("n"), threshold)).select("rep", "n", "alone", "tokens", "keys"))

    led = cut(_leader_links(core, threshold))
    # A set joins the group of one leader; leaders without one of their own stay in theirs.
    leader = led.groupBy("rep").agg(F.min("q_rep").alias("q_rep")).join(
        led.select(F.col("q_rep").alias("rep")).distinct(), "rep", "left_anti")
    grouped = cut(core.join(leader, "rep", "left").select("rep", "n", "tokens", F.coalesce("q_rep", "rep").alias("grp")))
    across = _opened_links(grouped, _opened(grouped, threshold), threshold)
    across = cut(across) if count_links else across
    found = components(led.unionByName(across), "rep", "q_rep")

    classes = reps.join(found, reps.rep == found.node, "left").select(
        "n", "fp1", "fp2", "rep", "copies", F.coalesce("root", "rep").alias("root"))
    named = F.col("doc_id").isNotNull()
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("root", "doc_id")).alias("component_id")]
    if count_links:
        copies = cut(reps.join(core.select("rep").distinct(), "rep").groupBy("rep").agg(F.sum("copies").alias("copies")))
        both = across.unionByName(across.select(F.col("q_rep").alias("rep"), F.col("rep").alias("q_rep")))
        outside = both.join(copies.withColumnRenamed("rep", "q_rep"), "q_rep").select("rep", F.col("copies").alias("links"))
        links = _links_inside(grouped, copies, threshold).unionByName(outside).groupBy("rep").agg(F.sum("links").alias("links"))
        classes = classes.join(links, "rep", "left")
        columns.append(F.when(named, F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
    out = heads.join(classes.drop("rep"), ["n", "fp1", "fp2"], "left")
    return out.select(*columns)
