"""SimHash fingerprints and a search within a Hamming radius, with DataFrame functions only.

Every word votes with a weight on each of 128 signed bits.  The votes of two bits share
one long (32 bits each), so a text's votes are 64 plain sums that Spark aggregates while
it explodes the words.  The search keeps a table per block of bits: with five blocks and a
radius of 14, two fingerprints in reach differ by at most two bits in some block, so a query
that looks up each of its blocks with every two bits flipped finds every such pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.llm.common import shuffle_parts

BITS, HALF = 128, 32
#: A word's weight is the square of its length in code points, at most this; longer words tell more.
MOST_WEIGHT = 144
SPACE = "[\\x20\\x09-\\x0D]+"
LANE = 0x0000000100000001


def _vote_sums() -> list[Column]:
    """Sums of weights per bit; bits i and i + 32 of a hash share a long."""
    return [
        F.sum(F.expr(f"(shiftrightunsigned({word}, {i}) & {LANE}L) * weight")).alias(f"{word}_{i}")
        for word in ("h1", "h2") for i in range(HALF)
    ]


def _bits(word: str) -> Column:
    """64 bits from the summed votes: a bit is set where its votes exceed half of all weight."""
    total = None
    for i in range(HALF):
        low = F.expr(f"if(2 * ({word}_{i} & 4294967295L) > total, shiftleft(1L, {i}), 0L)")
        high = F.expr(f"if(2 * shiftrightunsigned({word}_{i}, 32) > total, shiftleft(1L, {i + HALF}), 0L)")
        total = low.bitwiseOR(high) if total is None else total.bitwiseOR(low).bitwiseOR(high)
    return total


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, fp1, fp2``: the 128-bit fingerprint of each row's text as two longs.

    ``keys`` identify a row.  Null and wordless texts have fingerprint 0.  Two longs of a
    lane hold up to 2^31 of weight, some 15 million of the longest words.
    """
    words = texts.select(*keys, F.explode_outer(F.split(F.coalesce(text, F.lit("")), SPACE)).alias("word"))
    length = F.least(F.length("word"), F.lit(12))
    voted = words.select(
        *keys, (length * length).cast("long").alias("weight"),
        F.xxhash64("word").alias("h1"), F.xxhash64("word", F.lit(1)).alias("h2"))
    sums = voted.groupBy(*keys).agg(F.sum("weight").alias("total"), *_vote_sums())
    return sums.select(*keys, _bits("h1").alias("fp1"), _bits("h2").alias("fp2"))


def as_hex(high, low) -> Column:
    pad = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(pad(high), pad(low))


def distance(a1, a2, b1, b2) -> Column:
    """Bits in which two fingerprints differ."""
    xor = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    return xor(a1, b1) + xor(a2, b2)


def likeness(a1, a2, b1, b2) -> Column:
    """Share of bits in which two fingerprints agree."""
    return 1 - distance(a1, a2, b1, b2) / BITS


def with_next(docs: DataFrame, keep: list[str], parts: int) -> DataFrame:
    """Rows in order of ``doc_id`` with the next row's text as ``next_text`` (the last one's: the first's).

    Ids are cut into ranges at their quantiles; the first rows of a range also appear in the
    range before, so a window inside each range sees every successor.  Ties in ``doc_id`` are
    ordered by text; a null id comes first.  Adds ``part`` and ``place``, unique together.
    """
    quantiles = F.percentile_approx("ord", [i / parts for i in range(parts)], 100 * parts).alias("cuts")
    ids = docs.agg(F.min("ord").alias("least"), quantiles).first()
    least = ids["least"]
    cuts = sorted(set(ids["cuts"] or []) - {least})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c <= F.col("ord"))).alias("part")
    least = -1 if least is None else least
    placed = docs.select(*keep, "ord", part)
    ghost = F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("ghost"), F.lit(0).alias("turn"))
    wrap = F.struct(F.lit(len(cuts)).alias("part"), F.lit(True).alias("ghost"), F.lit(1).alias("turn"))
    own = F.struct("part", F.lit(False).alias("ghost"), F.lit(0).alias("turn"))
    homes = F.when(F.col("ord") == F.lit(least), F.array(own, wrap)).when(
        F.array_contains(bounds, F.col("ord")), F.array(own, ghost)).otherwise(F.array(own))
    rows = placed.withColumn("home", F.explode(homes)).select(*keep, "ord", "home.part", "home.ghost", "home.turn")
    order = W.partitionBy("part").orderBy("turn", "ord", "text")
    seen = rows.repartition(max(1, parts), "part").withColumn("next_text", F.lead("text").over(order)).withColumn(
        "place", F.row_number().over(order))
    return seen.where("NOT ghost").drop("ghost", "turn")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    ``docs`` needs ``doc_id`` and ``text``; a null text is empty.  The edited text replaces the
    last ``floor(n / 2)`` code points by the first as many (or all) of the next document's.
    Returns ``part, place, doc_id, n_chars, edited_sha256, fp1, fp2, e1, e2``.
    A single document is its own successor.  An empty table gives no rows.
    """
    parts = 2 * shuffle_parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63))))
    ordered = with_next(rows, ["doc_id", "text"], parts)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    made = ordered.select(
        "part", "place", "doc_id", n.alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    forms = made.select(
        "part", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("body")),
                          F.struct(F.lit(1).alias("form"), F.col("edited").alias("body")))).alias("as"))
    keys = ["part", "place", "doc_id", "n_chars", "edited_sha256", "form"]
    marked = fingerprints(forms.select(*keys[:-1], "as.form", "as.body"), keys, "body")
    of = lambda form, c: F.max(F.when(F.col("form") == form, F.col(c))).alias(f"{c}_{form}")
    both = marked.groupBy("part", "place").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_chars", "edited_sha256")],
        of(0, "fp1"), of(0, "fp2"), of(1, "fp1"), of(1, "fp2"))
    return both.select(
        "part", "place", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        F.col("fp1_0").alias("fp1"), F.col("fp2_0").alias("fp2"), F.col("fp1_1").alias("e1"), F.col("fp2_1").alias("e2"))


def with_likeness(marked: DataFrame) -> DataFrame:
    """Adds ``near_edited`` and ``near_next``; only fingerprints move here, no text.

    The last row of a range finds its successor among the first rows of the ranges, one row
    for each range, which is why they may be broadcast.
    """
    order = W.partitionBy("part").orderBy("place")
    last = marked.agg(F.max("part")).first()[0] or 0
    firsts = marked.where("place = 1").select(
        F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1).alias("part"),
        F.col("fp1").alias("s1"), F.col("fp2").alias("s2"))
    seen = marked.withColumns({"n1": F.lead("fp1").over(order), "n2": F.lead("fp2").over(order)})
    seen = seen.join(F.broadcast(firsts), "part").withColumns(
        {"n1": F.coalesce("n1", "s1"), "n2": F.coalesce("n2", "s2")})
    return seen.withColumns({
        "near_edited": likeness("fp1", "fp2", "e1", "e2"), "near_next": likeness("fp1", "fp2", "n1", "n2"),
    }).drop("part", "place", "s1", "s2", "n1", "n2")


def _flips(width: int, most: int) -> list[int]:
    """Masks of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(width), k)]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``(fp1, fp2, g1, g2, differing)``: every index fingerprint within ``radius`` bits of a query's.

    Both tables have ``fp1, fp2``, distinct.  Were each block to differ in more bits than its reach, all
    would differ in more than ``radius``, so no pair is missed; each comes from the first block within
    its reach alone.  Equal fingerprints are one row, however many texts share one.
    """
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    # The reaches and one more for each block add up to radius + 1.
    reaches = [(radius + 1 + i) // blocks - 1 for i in range(blocks)]

    def block(high: str, low: str, i: int) -> Column:
        """Bits of a block as a number; bit 0 is the lowest of ``low``."""
        a, b = cuts[i], cuts[i + 1]
        parts = []
        for word, start in ((low, 0), (high, 64)):
            first, last = max(a, start), min(b, start + 64)
            if first < last:
                bits = F.shiftrightunsigned(word, first - start).bitwiseAND(F.lit((1 << (last - first)) - 1 if last - first < 64 else -1))
                parts.append(F.shiftleft(bits, first - a))
        return parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])

    used = [i for i in range(blocks) if reaches[i] >= 0]
    place = lambda i, value: F.struct(F.lit(i).alias("block"), value.alias("value"))
    spread = lambda df, places: df.select("fp1", "fp2", F.explode(places).alias("at")).select("fp1", "fp2", "at.block", "at.value")
    known = spread(index, F.array(*[place(i, block("fp1", "fp2", i)) for i in used])).withColumnsRenamed({"fp1": "g1", "fp2": "g2"})
    own = spread(queries, F.array(*[place(i, block("fp1", "fp2", i)) for i in used]))
    masks = F.lit(None).cast("array<long>")
    for i in used:
        flips = F.array(*[F.lit(m).cast("long") for m in _flips(cuts[i + 1] - cuts[i], reaches[i])])
        masks = F.when(F.col("block") == i, flips).otherwise(masks)
    asked = own.select("fp1", "fp2", "block", "value", F.explode(masks).alias("flip")).select(
        "fp1", "fp2", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    # The planner does not count what the masks multiply; neither side is ever small enough to be sent to all.
    met = asked.hint("shuffle_merge").join(known.hint("shuffle_merge"), ["block", "value"]).withColumn("differing", distance("fp1", "fp2", "g1", "g2"))
    met = met.where(F.col("differing") <= radius)
    apart = lambda i: F.bit_count(block("fp1", "fp2", i).bitwiseXOR(block("g1", "g2", i)))
    first = F.lit(None).cast("int")
    for i in reversed(used):
        first = F.when(apart(i) <= reaches[i], F.lit(i)).otherwise(first)
    return met.where(F.col("block") == first).select("fp1", "fp2", "g1", "g2", "differing")
