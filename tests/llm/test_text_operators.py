"""Text operators against brute force on small, awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydrospark.llm import decontaminate, ngram_join, pieces, queries, simhash, substring_dedup, token_counts, toxicity
from hydrospark.llm.chat_format import answered_pairs, id_pairs, preference_pairs
from hydrospark.llm.common import text_bytes
from hydrospark.llm.ngram_join import ngram_jaccard_components
from hydrospark.llm.pitman_yor import score_texts, seat
from hydrospark.llm.sharding import extendible_shards
from hydrospark.llm.words import shingles, split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n long, token string, grp string, place long"  # names that operators use inside
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts():
    """Copies, altered copies, shared passages, nulls, empty and odd texts, a long one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "Be", "çé", "do", "ul", "ix"]) for _ in range(rng.randint(1, 4)))
    base = [word() for _ in range(60)]
    out = [(0, " ".join(base)), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two three"), (7, "日本 x y")]
    for i in range(8, 40):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = word()
        out.append((i, rng.choice(["  ", "\n", " "]).join(copy)))
    passage = " ".join(word() for _ in range(20))
    for i in range(40, 60):
        out.append((i, " ".join(word() for _ in range(rng.randint(0, 30))) + " " + passage + " " + word()))
    out += [(60, out[0][1]), (60, out[0][1]), (61, " ".join(word() for _ in range(4000))), (62, "a a a a a a a a a a a a a a a a a a a a")]
    return out


def test_word_hashes_agree_between_blocks(texts):
    column = pa.array([t for _, t in texts])
    data, offsets = text_bytes(column)
    whole = split_words(data, offsets, lower=True)
    assert whole.counts.tolist() == [len(WORD.findall((t or ""))) for _, t in texts]
    for d in (0, 7, 20, 61):
        alone = split_words(data, offsets[d:d + 2], lower=True)
        assert alone.hashes.tolist() == whole.hashes[whole.first[d]:whole.first[d + 1]].tolist()
    text, _ = shingles(whole, 4)
    counts = Counter(text.tolist())
    assert counts[4] == 1 and counts[6] == 1 and counts[2] == 0


def sets_of(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize(("size", "threshold"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, texts, size, threshold, monkeypatch):
    if size == 2:  # groups of many blocks, compared in many steps
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    rows = ngram_jaccard_components(table(spark, texts), size, threshold, count_links=True).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    sets = {i: sets_of(t, size) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    kept = [sets_of(t, size) for _, t in texts]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= threshold * len(a | b)
    wanted = sorted((i, sum(linked(kept[x], s) for s in kept) - bool(kept[x])) for x, (i, _) in enumerate(texts))
    assert sorted((r.doc_id, r.n_links) for r in rows) == wanted
    assert max(n for _, n in wanted) > 3


def test_ngram_join_counts_of_blocks_agree_with_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (0, 1, 4000, 5000, 30)]
    side = lambda part: (np.concatenate(part), np.repeat(np.arange(len(part)), [len(s) for s in part]), len(part))
    x, y = sets[:3], sets[2:]
    assert ngram_join._common(side(x), side(y)).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_ngram_join_of_missing_ids_and_no_rows(spark):
    rows = ngram_jaccard_components(table(spark, [(None, "a b c d e"), (4, "a b c d e"), (-2, "a b c d e")]), 4, 85, True).collect()
    assert sorted(((r.doc_id, r.component_id, r.n_links) for r in rows), key=str) == [(-2, -2, 1), (4, -2, 1), (None, None, None)]
    assert ngram_jaccard_components(table(spark, [(1, "x")]).limit(0), 4, 85, True).collect() == []


def test_substring_dedup(spark, texts):
    for window, group in ((13, 1_000_000), (13, 4), (3, 1_000_000)):
        made = substring_dedup.remove_repeats(table(spark, texts), window, True, group).collect()
        first = {}
        words = {i: WORD.findall(t or "") for i, t in texts}
        for i in sorted(words):
            for p in range(len(words[i]) - window + 1):
                first.setdefault(tuple(words[i][p:p + window]), i)
        assert len(made) == len(texts)
        for r in made:
            w, gone = words[r.doc_id], set()
            for p in range(len(w) - window + 1):
                if first[tuple(w[p:p + window])] < r.doc_id:
                    gone.update(range(p, p + window))
            left = " ".join(x for p, x in enumerate(w) if p not in gone)
            assert (r.n_words, r.n_removed) == (len(w), len(gone))
            assert r.kept_sha256 == hashlib.sha256(left.encode()).hexdigest()
            assert r.kept is None if not gone else r.kept == left


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 90)) for i in range(500)] + [(None, 5), (7, None), (9, 400), (9, 30), *[(11, 40)] * 9]
    made = extendible_shards(spark.createDataFrame(rows, "doc_id long, size long"), "doc_id", F.col("size"), 300, step=5).collect()
    assert sorted((r.key is None, r.key or 0, r.bytes) for r in made) == sorted((k is None, k or 0, s or 0) for k, s in rows)
    held = defaultdict(list)
    for r in made:
        held[r.shard, r.page].append(r)
    for rows_of in held.values():
        total = sum(r.bytes for r in rows_of)
        assert {r.shard_bytes for r in rows_of} == {total} and (total <= 300 or len(rows_of) == 1)
    names = {r.shard for r in made}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for name in names - {""}:  # no shard is deeper than it must be
        assert sum(r.bytes for r in made if r.shard.startswith(name[:-1])) > 300
    assert extendible_shards(spark.createDataFrame([], "doc_id long, size long"), "doc_id", F.col("size"), 300).count() == 0


def test_preference_pairs(spark):
    said = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (1, 0, "user", "q"), (1, 1, "assistant", "b é"),
            (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, None), (6, 0, "user", "w"), (6, 0, "user", "w"), (7, 0, "assistant", "z"),
            (None, 0, "user", "lost")]
    turns = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    made = {r.pair_id: r for r in preference_pairs(turns, id_pairs(turns)).collect()}
    shown = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert made[0].prompt == shown("user", "q") and made[0].chosen == shown("assistant", "a") + shown("user", "r")
    assert [made[0].chosen[s.start:s.end] for s in made[0].chosen_mask] == ["a<|end|>\n"]
    assert [made[0].rejected[s.start:s.end] for s in made[0].rejected_mask] == ["b é<|end|>\n"]
    assert (made[1].prompt_turns, made[1].chosen, made[1].rejected) == (1, "", "")
    assert made[2].prompt == "" and made[2].chosen == shown("", "") and made[2].rejected == ""
    assert made[3].prompt_turns == 0 and set(made) == {0, 1, 2, 3}
    assert preference_pairs(turns.where("false"), id_pairs(turns.where("false"))).count() == 0


def test_pairs_of_a_conversation_and_its_neighbours_answer(spark):
    said = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"),
            (1, 0, "system", "s"), (1, 1, "assistant", "c é"), (2, 0, "user", "alone"), (2, 1, "assistant", "d"), (5, 0, "user", "no answer"),
            (4, 0, "user", "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "z"), (None, 0, "assistant", "lost"), (8, None, None, None)]
    turns = spark.createDataFrame([(*t, "p", True, 9) for t in said], "conv_id long, turn int, role string, text string, pair_id string, there boolean, last int")
    made = {r.pair_id: r for r in answered_pairs(turns).collect()}
    shown = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert set(made) == {0, 1, 2, 4, 5, 8}
    assert made[0].prompt == shown("user", "q") + shown("assistant", "a") + shown("user", "r") and made[0].prompt_turns == 3
    assert made[0].chosen == shown("assistant", "b") + shown("user", "bye") and made[0].rejected == shown("assistant", "c é")
    assert [made[0].rejected[s.start:s.end] for s in made[0].rejected_mask] == ["c é<|end|>\n"]
    assert (made[1].prompt, made[1].rejected) == (shown("system", "s"), shown("assistant", "b"))
    assert (made[2].prompt, made[2].chosen, made[2].rejected) == (shown("user", "alone"), shown("assistant", "d"), "")
    assert (made[4].prompt, made[4].chosen, made[4].rejected) == (shown("user", "x"), shown("assistant", "y") + shown("assistant", "z"), "")
    assert (made[5].prompt, made[5].chosen, made[5].rejected) == (shown("user", "no answer"), "", shown("assistant", "z"))
    assert (made[8].prompt, made[8].rejected) == (shown("", ""), "")
    assert answered_pairs(turns.where("false")).count() == 0


def test_simhash(spark, texts):
    distinct = list({i: t for i, t in texts}.items())
    made = {r.doc_id: r for r in simhash.with_likeness(simhash.edited_fingerprints(table(spark, distinct))).collect()}
    order = sorted(made)
    assert order == sorted(i for i, _ in distinct)
    known = {i: t or "" for i, t in distinct}
    prints = {}
    for k, i in enumerate(order):
        text, after = known[i], known[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = made[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, (r.fp1, r.fp2)) == (r.fp1, r.fp2)
        if edited == text:
            assert r.near_edited == 1.0
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        n = made[order[(k + 1) % len(order)]]
        bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        assert math.isclose(r.near_next, 1 - (bits(r.fp1, n.fp1) + bits(r.fp2, n.fp2)) / 128)
    assert simhash.edited_fingerprints(table(spark, [])).count() == 0


def test_search_within_radius(spark):
    rng = random.Random(2)
    prints = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(40)]
    for a, b in prints[:20]:
        for flips in (1, 3, 4):
            x = (a << 64) | b
            for bit in rng.sample(range(128), flips):
                x ^= 1 << bit
            prints.append((x >> 64, x & (2**64 - 1)))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    frame = spark.createDataFrame([(signed(a), signed(b)) for a, b in prints], "fp1 long, fp2 long")
    got = {(r.fp1, r.fp2, r.g1, r.g2) for r in simhash.within_radius(frame, frame, 3).collect()}
    want = {(signed(a), signed(b), signed(c), signed(d)) for a, b in prints for c, d in prints
            if bin(a ^ c).count("1") + bin(b ^ d).count("1") <= 3}
    assert got == want


@pytest.mark.parametrize(("radius", "blocks"), [(14, 5), (0, 3), (7, 2 * 4)])
def test_search_within_wider_radius(spark, radius, blocks):
    rng = random.Random(4)
    known = [rng.getrandbits(128) for _ in range(30)]
    for x in known[:15]:
        for flips in (1, 5, radius, radius + 1):
            known.append(x ^ sum(1 << b for b in rng.sample(range(128), flips)))
    known = list(dict.fromkeys(known))
    signed = lambda x: tuple(v - 2**64 if v >= 2**63 else v for v in (x >> 64, x & (2**64 - 1)))
    frame = spark.createDataFrame([signed(x) for x in known], "fp1 long, fp2 long")
    got = [tuple(r) for r in simhash.within_radius(frame, frame, radius, blocks).collect()]
    want = [(*signed(x), *signed(y), (x ^ y).bit_count()) for x in known for y in known if (x ^ y).bit_count() <= radius]
    assert sorted(got) == sorted(want)


def test_near_copies_are_returned(spark, tmp_path):
    """Copies with one word in fifty changed are found, and the result tells which they are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(12):
        words = [word() for _ in range(200)]
        rows.append((50 * i, " ".join(words)))
        for k in rng.sample(range(200), 4):
            words[k] = word()
        rows.append((50 * i + 1, " ".join(words)))
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    made = {r.doc_id: r for r in queries.op5_simhash(spark, str(tmp_path)).collect()}
    found = 0
    for i in range(12):
        asked, copy = made[50 * i], made[50 * i + 1]
        assert asked.fingerprint in asked.near_fingerprints and copy.near_fingerprints is None
        assert asked.n_near == sum(r.fingerprint in asked.near_fingerprints for r in made.values())
        found += copy.fingerprint in asked.near_fingerprints
    assert found >= 9


def test_language_model(spark, texts):
    rng = random.Random(3)
    likely = [(100 + i, " ".join(itertools.chain(*[rng.choice([["a", "b"], ["c", "d", "e"]]) for _ in range(20)]))) for i in range(60)]
    rows = texts + likely + [(None, "a b")]
    made = score_texts(table(spark, rows), 7, 2, contexts=64).collect()
    assert len(made) == len(rows)
    counts, total = Counter(), 0
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    for i, t in rows:
        if not out(i):
            counts.update(tokens(t))
    total = sum(counts.values())
    texts_of = dict(rows)
    for r in made:
        words = tokens(texts_of[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in made if r.held_out and r.doc_id >= 100]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_texts(table(spark, []), 7, 2).count() == 0


def test_every_context_has_its_own_restaurant(spark, texts):
    """How many words are dealt as frequent ones changes no score beyond the spread of samples."""
    rng = random.Random(11)
    rows = list(texts[:1])
    for i in range(100, 400):
        pairs = rng.sample(range(60), 12)
        rows.append((i, " ".join(f"x{k} y{k} z{rng.randrange(3000)}" for k in pairs)))
    few, many = ({r.doc_id: r for r in score_texts(table(spark, rows), 7, 2, contexts=n).collect()} for n in (4, 16_384))
    held = [i for i in few if few[i].held_out and i >= 100]
    assert len(held) > 20 and few.keys() == many.keys()
    for i in few:
        assert few[i].score > 1.05 * many[i].score and many[i].score > 1.05 * few[i].score
    # Within a pair the second word is certain: about two of three tokens cost something.
    assert sum(few[i].score for i in held) > 0.75 * sum(few[i].base_score for i in held)


def test_seating_bounds():
    n = np.array([0, 1, 2, 50, 100_000])
    tables = seat(n, np.full(5, 0.01), np.full(5, 10.0), 0.5, np.random.default_rng(0))
    assert tables[:2].tolist() == [0, 1] and (tables[2:] >= 1).all() and (tables <= n).all()


@pytest.fixture(scope="module")
def ranks():
    return {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257, b".\n": 258}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, texts, ranks, rule):
    pattern = r"[^\s]+\s*|\s+"
    rows = [*texts, (80, "the.\nthe.\n\nthé"), (81, "\n")]
    made = {r.doc_id: r for r in token_counts.section_token_counts(table(spark, rows), ranks, pattern, rule).collect()}
    for i, t in rows:
        assert math.isclose(sum(made[i].section_tokens), made[i].n_tokens, abs_tol=1e-6)
        assert len(made[i].section_tokens) == len(re.findall("[^\n]*\n|[^\n]+", t or ""))
    assert made[80].section_tokens == [2, 2, 1, 3]  # the last is th and the two bytes of é


def test_allotting_crossing_tokens():
    ends, borders = np.array([2, 7, 9]), np.array([0, 3, 6, 9])
    allot = lambda rule: token_counts.allot(ends, borders, rule)[0].tolist()
    assert allot("first") == [2, 0, 1] and allot("last") == [1, 0, 2] and allot("largest") == [1, 1, 1]
    assert np.allclose(allot("share"), [1.2, 0.6, 1.2])


def edit_occurrence(item, text):
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        diagonal, cost[0] = cost[0], i + 1
        for j, x in enumerate(text):
            diagonal, cost[j + 1] = cost[j + 1], min(diagonal + (c != x), cost[j] + 1, cost[j + 1] + 1)
    return min(cost)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéfgh ") for _ in range(8))
    items = [(i, "".join(word() for _ in range(rng.randint(5, 12)))) for i in range(12)]
    docs = [(0, None), (1, ""), (2, "short")]
    for i in range(3, 60):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, len(item) // 7)):
            spot = rng.randrange(len(item))
            item[spot:spot + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        docs.append((i, "".join(word() for _ in range(rng.randint(0, 20))) + "".join(item).upper() + word()))
    bench = spark.createDataFrame([*items, (99, None), (98, "tiny")], "item_id long, text string")
    for chars in (4_000_000, 300):
        made = {r.doc_id: r.regions for r in decontaminate.leaked_regions(table(spark, docs), bench, block_chars=chars).collect()}
        for i, t in docs:
            points = decontaminate.code_points((t or "").encode())
            want = set()
            for item_id, text in items:
                text = decontaminate.code_points(text.strip().encode())
                most = min(len(text) // 10, (len(text) - 8) // 8)
                if edit_occurrence(text.tolist(), points.tolist()) <= most:
                    want.add(item_id)
            assert {r.item_id for r in made[i]} == want
            assert all(0 <= r.start < r.end <= len(points) for r in made[i])
    clean = decontaminate.without_leaks(table(spark, docs), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, found in made.items() if not found}
    assert decontaminate.leaked_regions(table(spark, docs), bench.where("false")).where("size(regions) > 0").count() == 0


PIECES = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)],
          *[(p, s, 1) for p, s in [("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -4.5), ("bab", -6.5), ("é", -5.0), ("▁▁", -6.0)]]]


def test_short_items_and_rows_of_one_id_in_several_blocks(spark):
    bench = spark.createDataFrame(
        [(1, "secret key"), (2, "pin"), (3, "x" * 40), (None, "abcdefgh"), (5, " "), (6, "secret key")], "item_id long, text string")
    docs = [(7, "the Secret\tkey is here"), (7, "spinning pin, pin_ pin"), (None, "pin"), (None, "zabcdefghz"), (8, "x" * 41), (8, None), (9, "secretkey")]
    want = sorted([(7, [(1, 4, 14), (6, 4, 14)]), (7, [(2, 9, 12), (2, 19, 22)]), (None, [(2, 0, 3)]), (None, [(None, 1, 9)]),
                   (8, [(3, 0, 40)]), (8, []), (9, [])], key=repr)
    for chars in (1_000, 12):
        made = decontaminate.leaked_regions(table(spark, docs), bench, block_chars=chars).collect()
        assert sorted(((r.doc_id, [(x.item_id, x.start, x.end) for x in r.regions]) for r in made), key=repr) == want
    assert decontaminate.without_leaks(table(spark, docs), bench).count() == 2


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_long_patterned_words_keep_their_own_hash(spark):
    """For such pairs a sum of powers modulo 2^64 is the same, whatever the odd base."""
    for n in (512, 1024, 4096):
        a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
        data, offsets = text_bytes(pa.array([a, b, a]))
        hashes = split_words(data, offsets, lower=True).hashes
        assert hashes[0] == hashes[2] != hashes[1]
    tail = " ".join(f"w{i}" for i in range(12))
    docs = table(spark, [(1, f"{a} {a} {a} {a}"), (2, f"{b} {b} {b} {b}"), (3, f"{a} {tail}"), (4, f"{b} {tail}")])
    assert {r.doc_id: r.component_id for r in ngram_jaccard_components(docs, 4, 85).where("doc_id < 3").collect()} == {1: 1, 2: 2}
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(docs, 13).collect())
    assert all(r.exact for r in pieces.encode_pieces(docs, PIECES).collect())


def test_passages_under_shared_negative_and_missing_ids(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(-3, passage + " end"), (5, "start " + passage), (5, "other text of its own " + passage + " more"), (5, "short"), (None, passage), (5, "start " + passage)]
    docs = spark.createDataFrame([(i, t, 9, "k", "r", "c", "h") for i, t in rows], "doc_id long, text string, n_chars int, _kept string, row string, kept string, th string")
    made = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).where("doc_id IS NOT NULL").collect())
    assert made == [(-3, 21, 0), (5, 1, 0), (5, 21, 20), (5, 21, 20), (5, 26, 20)]
    left = corpus_pipeline.drop_repeated_passages(spark, docs, "")
    assert left.columns == docs.columns
    found = sorted(((r.doc_id, r.text, r.n_chars, r._kept) for r in left.collect()), key=repr)
    assert found == sorted([(-3, rows[0][1], 9, "k"), (5, "start", 5, "k"), (5, "start", 5, "k"), (5, "other text of its own more", 26, "k"),
                            (5, "short", 9, "k"), (None, passage, 9, "k")], key=repr)


def test_pieces(spark, texts):
    model = pieces.build_model(PIECES)
    scores = {p.encode(): (s, i) for i, (p, s, kind) in enumerate(PIECES) if kind == 1}
    low = min(s for s, _ in scores.values()) - pieces.BYTE_GAP

    def best(text):
        best_at = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                score = scores.get(text[start:end], (low if end - start == 1 else -math.inf, 0))[0]
                best_at[end] = max(best_at[end], (best_at[start][0] + score, -start))
        return best_at[-1][0]

    samples = ["abab bab", "a  b", " x", "é日", "", "▁a", "ab\nba  \t"]
    encoder = pieces.Encoder(model)
    ids, first = encoder.encode(*text_bytes(pa.array(samples)))
    for d, text in enumerate(samples):
        own = ids[first[d]:first[d + 1]]
        assert pieces.decode(model, own) == text
        if text and "▁" not in text:
            spelled = ("▁" + text.replace(" ", "▁")).encode()
            assert math.isclose(sum(low if PIECES[i][2] == 6 else PIECES[i][1] for i in own), best(spelled))
    made = {r.doc_id: r for r in pieces.encode_pieces(table(spark, [*texts, (90, "▁ ▁▁")]), PIECES).collect()}
    assert all(r.exact for r in made.values()) and made[2].n_pieces == 0
    assert made[0].n_pieces == len(made[0].pieces)


def toxic_tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "re", "mo", "li"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(10, 60))]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "V1LE", "vіle", "rotten", "r0tten###"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad)))
    docs += [(600, None), (601, ""), (602, "such v1le things"), (602, "such v1le things")]
    return table(spark, docs), spark.createDataFrame([*labels, (7000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    automaton, beta = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 <> 0 OR doc_id IS NULL"))
    made = toxicity.score_toxicity(docs, automaton, beta).collect()
    assert len(made) == 604 and all(0 <= r.score <= 1 for r in made)
    wrong = [r for r in made if r.doc_id < 600 and (r.score >= 0.3) != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 6
    assert all(r.score >= 0.3 for r in made if r.doc_id == 602) and all(r.score < 0.3 for r in made if r.doc_id in (600, 601))
    empty, beta = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, empty, beta).collect()} == {0.5}


def test_folding_and_exceptions():
    assert toxicity.fold("Tr4sh### ТRASH") .split() == ["trash", "trash"]
    automaton = toxicity.Automaton({" moron": 3.0}, frozenset({" not moron ", " moronett "}))
    assert automaton.features(toxicity.fold("so m0r0ns"))[0] == 3.0
    assert automaton.features(toxicity.fold("not MORON"))[0] == 0.0
    assert automaton.features(toxicity.fold("moronett"))[0] == 0.0
    assert automaton.features(toxicity.fold("moronett moron moron"))[0] == 3.0


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    item = "what is the longest river that crosses the old northern valley before it meets the sea"
    passage = " ".join(f"w{i}" for i in range(30))
    rest = " ".join(f"z{i}" for i in range(30))
    rows = [(i, t) for i, t in [(700, f"intro {item} outro"), (701, f"first {passage} x"), (702, f"second {passage} {rest}"),
                                (703, " ".join(f"c{i}" for i in range(50))), (704, " ".join(f"c{i}" for i in range(50)))]]
    docs = docs.unionByName(table(spark, rows)).withColumn("n_chars", F.length("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    done, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, done, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        done = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r.doc_id: r for r in done.collect()})
        assert k == 4 or done.columns == columns
    assert 602 not in seen[0] and 600 in seen[0] and len(seen[0]) > 440
    assert 703 in seen[1] and 704 not in seen[1]
    assert seen[2][702].text == f"second {rest}" and seen[2][702].n_chars == len(rest) + 7 and passage in seen[2][701].text
    assert 700 in seen[2] and 700 not in seen[3] and 701 in seen[3]
    assert set(seen[4]) == set(seen[3]) and all(r.exact for r in seen[4].values())


def test_every_query_is_registered():
    names = [*queries.QUERIES]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(names)
