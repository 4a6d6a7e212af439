"""Quality rules: a table of thresholds compiled into one projection of counts and ratios.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``.  All counts of a text are expressions
on its array of words and its array of lines, bound once each; a rule compares ``100 * part`` with
bounds times ``whole``, in integers.  No user functions, no shuffle.

Null, empty and wordless texts have counts of 0 and break the rule on the number of words.  Rows are
judged each for itself, repeated or not; an empty table gives no rows.  All columns of the table stay,
except that one named like a result (``counts``, ``failed``, ``base_failed``, ``kept``) is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]"
FILLED = "[^\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
#: Any character that is neither an ASCII digit nor an ASCII mark.
LETTER = "[^\\x21-\\x40\\x5B-\\x60\\x7B-\\x7F]"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in is that for with was on as at by this are from or be it "
    "der die das und in zu den mit von ist auf für im ein eine nicht sich des dem als "
    "le la les de des et en un une que pour dans qui sur par est pas au du se "
    "el los las una del por con para su al lo como más y es se no"
).split()
SHOWN_STOP_WORDS = sorted({shown for w in STOP_WORDS for shown in (w, w.capitalize())})
#: With at most so many repeated windows their places are looked up one by one; more are sorted.
FEW_REPEATS = 16


@dataclass(frozen=True)
class Rule:
    """``low * whole <= 100 * part <= high * whole``; either bound may be missing."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def broken(self, counts: Column) -> Column:
        part, whole = 100 * counts[self.part], counts[self.whole]
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (part < self.low * whole)
        if self.high is not None:
            bad = bad | (part > self.high * whole)
        return bad


#: ``one`` is a constant 1, for bounds on plain counts.
BASE = (Rule("few_words", "n_words", "one", low=5000), Rule("repeated_words", "n_repeat_words", "n_words", high=50))
RULES = (
    Rule("word_length", "word_chars", "n_words", low=300, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("letterless_words", "n_letterless", "n_words", high=20),
    Rule("capital_words", "n_capital", "n_words", high=30),
    Rule("few_stop_words", "n_stop", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=30),
    Rule("bullet_lines", "n_bullet", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis", "n_lines", high=30),
)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Hashes of the windows only narrow down the places: most texts have none twice, in
    others the places of repeated hashes (or all places) are sorted by the windows' words,
    equal neighbours stay, and places in order give the words they cover.
    """
    none = F.array().cast("array<int>")
    last = F.size(words) - 3
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)
    word = lambda i: F.get(words, i)

    def cover(places):
        window = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("g"), i.alias("i"))

        def repeated(rows):
            same = lambda row, k: F.coalesce(F.get(rows, k)["g"] == row["g"], F.lit(False))
            twins = F.filter(rows, lambda row, k: same(row, k - 1) | same(row, k + 1))
            return F.sort_array(F.transform(twins, lambda row: row["i"]))

        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda seen, i: F.struct(i.alias("at"), (seen["n"] + F.least(F.lit(3), i - seen["at"])).alias("n"))
        kept = _bound(F.sort_array(F.transform(places, window)), repeated)
        return F.aggregate(kept, start, step, lambda seen: seen["n"])

    def of_hashes(hashes):
        def of_twice(twice):
            few = F.filter(starts, lambda i: F.array_contains(twice, F.get(hashes, i)))
            return cover(F.when(F.size(twice) <= FEW_REPEATS, few).otherwise(starts))

        in_order = F.sort_array(hashes)
        twice = _bound(in_order, lambda h: F.filter(h, lambda x, k: F.coalesce(x == F.get(h, k - 1), F.lit(False))))
        differ = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(differ, F.lit(0).cast("long")).otherwise(_bound(F.array_distinct(twice), of_twice))

    return _bound(F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))), of_hashes)


def text_counts(text: Column) -> Column:
    """Struct of all counts (BIGINT) of one text."""
    text = F.coalesce(text, F.lit(""))
    n = lambda c: c.cast("long")

    def of_words(words):
        # The first character rules most words out before a pattern or a change of case is tried.
        marked = lambda w: (w < "A") | ((w >= "[") & (w < "a")) | ((w >= "{") & (w < "\x80"))
        letterless = lambda w: marked(w) & ~w.rlike(LETTER)
        shouted = lambda w: (((w >= "A") & (w < "[")) | (w >= "\x80")) & (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)
        return F.struct(
            n(F.size(words)).alias("n_words"), n(F.length(F.array_join(words, ""))).alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
            n(F.size(F.filter(words, letterless))).alias("n_letterless"),
            n(F.size(F.filter(words, shouted))).alias("n_capital"),
            n(F.size(F.filter(words, lambda w: w.isin(SHOWN_STOP_WORDS)))).alias("n_stop"))

    def of_lines(lines):
        ends = lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…")
        return F.struct(
            n(F.size(lines)).alias("n_lines"), n(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            n(F.size(F.filter(lines, lambda line: F.substring(F.ltrim(line), 1, 1).isin("-", "*", "•")))).alias("n_bullet"),
            n(F.size(F.filter(lines, ends))).alias("n_ellipsis"))

    words = F.array_remove(F.split(text, BLANK + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(FILLED))
    parts = F.struct(_bound(words, of_words).alias("w"), _bound(lines, of_lines).alias("l"))
    of = lambda p, group, names: [p[group][c].alias(c) for c in names]
    lift = lambda p: F.struct(
        *of(p, "w", ("n_words", "word_chars", "n_repeat_words", "n_letterless", "n_capital", "n_stop")),
        n(F.size(F.split(text, SYMBOL)) - 1).alias("n_symbols"),
        *of(p, "l", ("n_lines", "n_dup_lines", "n_bullet", "n_ellipsis")), F.lit(1).cast("long").alias("one"))
    return _bound(parts, lift)


def judge_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE,
                  prefix: str = "") -> DataFrame:
    """Every row with ``counts`` (struct), ``failed`` (names of broken rules), ``base_failed`` and ``kept``.

    ``prefix`` goes before the four names; a column of that name in ``docs`` is replaced.
    """
    name = lambda c: prefix + c
    broken = lambda counts, table: F.filter(
        F.array(*[F.when(r.broken(counts), F.lit(r.name)) for r in table]) if table else F.array().cast("array<string>"), lambda x: x.isNotNull())

    def verdict(counts):
        first = broken(counts, base)
        return F.struct(counts.alias("counts"), F.concat(first, broken(counts, rules)).alias("failed"), (F.size(first) > 0).alias("base_failed"))

    judged = _bound(text_counts(F.col(text)), verdict)
    plain = [c for c in docs.columns if c.lower() not in {name(x).lower() for x in ("counts", "failed", "base_failed", "kept")}]
    found = docs.select(*plain, judged.alias("_judged"))
    return found.select(
        *plain, F.col("_judged.counts").alias(name("counts")), F.col("_judged.failed").alias(name("failed")),
        F.col("_judged.base_failed").alias(name("base_failed")), (F.size("_judged.failed") == 0).alias(name("kept")))


def without_poor_texts(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows that break no rule, unchanged."""
    judged = judge_quality(docs, text, rules, base, prefix="_q_")
    return judged.where("_q_kept").select(*docs.columns)
