"""Orchard clustering, quality rules and target resampling against brute force on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from hydrospark.llm import crc_prefix, orchard_clustering, quality_rules, target_resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- centroid clustering -------------------------------------------------------------------

def test_orchard_finds_the_lowest_nearest_centroid_with_fewer_distances():
    rng = np.random.default_rng(3)
    for spread in (1, 4, 60):
        centroids = rng.integers(-spread, spread + 1, (30, 3))
        centroids[7] = centroids[2]  # equal centroids: the lower number wins
        vectors = np.concatenate([rng.integers(-spread, spread + 1, (400, 3)), centroids])
        best, distance, computed = orchard_clustering.nearest(vectors, centroids)
        apart = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert best.tolist() == apart.argmin(axis=1).tolist()
        assert distance.tolist() == apart.min(axis=1).tolist()
        assert computed <= len(vectors) * 30
    far = np.arange(40).reshape(-1, 1) * 1000
    _, _, computed = orchard_clustering.nearest(np.repeat(far, 50, axis=0), far)
    assert computed < 2000 * 40 / 2  # well apart: lists end early


def plain_lloyd(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * scale < 1 << 27 for x in v)]
    rank = lambda row: (hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1])
    centroids = [v for _, v in sorted(kept, key=rank)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        by = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, by) if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    found = sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=repr)
    return found, centroids


def test_clustering_equals_plain_rounds_on_awkward_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.7, 2.25]) + rng.random() / 50 for _ in range(4)]) for i in range(120)]
    rows += [(5, rows[5][1]), (6, [0.1, 0.2, 0.3, 0.4]), (None, [1.0, 1.0, 1.0, 1.0]), (200, None), (201, [1.0, None, 0.0, 0.0]),
             (202, [1.0, 2.0]), (203, [float("nan"), 0.0, 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, []), (206, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, key string, v int")
    assigned, centroids = orchard_clustering.cluster_vectors(df.repartition(5), k=9, rounds=4, dims=4, scale=16, seed=2)
    found, plain = plain_lloyd(rows, 9, 4, 4, 16, 2)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=repr) == found
    assert centroids.tolist() == plain
    figures = orchard_clustering.with_inertia(assigned, centroids).collect()
    for r in figures:
        assert r["cluster_inertia"] == sum(d for _, c, d in found if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in found)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest()
    few, centroids = orchard_clustering.cluster_vectors(df.where("vec_id < 3"), k=9, rounds=2, dims=4)
    assert len(centroids) == 3 and few.count() == 3
    none, centroids = orchard_clustering.cluster_vectors(df.where("vec_id = 205"), k=9, dims=4)
    assert orchard_clustering.with_inertia(none, centroids).count() == 0


def test_empty_clusters_keep_their_centroid(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(40)], "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assigned, centroids = orchard_clustering.cluster_vectors(df, k=10, rounds=3, dims=2, scale=256)
    found, plain = plain_lloyd(rows, 10, 3, 2, 256, 2)
    assert centroids.tolist() == plain and len({c for _, c, _ in found}) < 10
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()) == sorted(found)


# --- quality rules -------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + j for p in places for j in range(3))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_letterless": sum(not re.search(r"[^\x21-\x40\x5B-\x60\x7B-\x7F]", w) for w in words),
        "n_capital": sum(len(w) > 1 and w.upper() == w and w.lower() != w for w in words),
        "n_stop": sum(w in quality_rules.SHOWN_STOP_WORDS for w in words),
        "n_bullet": sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines),
        "n_ellipsis": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines), "one": 1}


def odd_texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("the and of to in meadow river stone light under walking slowly".split()) + "x" * rng.randint(0, 3) for _ in range(n))
    same = "the river bends here and the valley opens wide"
    return [
        None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x x x x x x", "ab c d a bc d", "\x00 \x07a é ß STRASSE ÜBER 日本 𝒳𝒴 12 --- 4% #a",
        prose(300), "\n".join([same] * 30), "\n".join(f"- item {prose(4)}..." for _ in range(30)), " | ".join(prose(80).split()), prose(80).upper(),
        prose(60) + " " + " ".join(f"{w}###" for w in prose(60).split()), " ".join(["der"] * 200), prose(20_000),
        " ".join(f"w{i % 997}" for i in range(6_000)), " ".join(str(rng.randint(0, 9)) for _ in range(100)), "x" * 200_000,
        "\n".join(f"* {prose(9)}" for _ in range(20)), prose(120) + " " + prose(8), prose(120),
    ]


def test_counts_equal_plain_counts(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "kept?", 3) for i, t in enumerate([*texts, texts[10]])], "doc_id long, text string, kept string, words int")
    judged = quality_rules.judge_quality(df.repartition(3)).collect()
    assert len(judged) == len(texts) + 1 and "words" in judged[0].asDict()
    for row in judged:
        plain = plain_counts([*texts, texts[10]][row["doc_id"]])
        assert row["counts"].asDict() == plain, row["doc_id"]
        broken = []
        for rule in (*quality_rules.BASE, *quality_rules.RULES):
            part, whole = 100 * plain[rule.part], plain[rule.whole]
            if (rule.low is not None and part < rule.low * whole) or (rule.high is not None and part > rule.high * whole):
                broken.append(rule.name)
        assert row["failed"] == broken
        assert row["base_failed"] == (plain["n_words"] < 50 or 2 * plain["n_repeat_words"] > plain["n_words"])
        assert row["kept"] == (not broken)
    verdict = {row["doc_id"]: row["failed"] for row in judged}
    assert verdict[23] == [] and "symbols" in verdict[15] and "capital_words" in verdict[14] and "bullet_lines" in verdict[21]
    kept = quality_rules.without_poor_texts(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, failed in verdict.items() if not failed}
    assert quality_rules.judge_quality(df.where("doc_id < 0")).count() == 0


def test_rules_are_a_projection_without_python_or_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.judge_quality(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    judged = quality_rules.judge_quality(df, rules=(), base=(quality_rules.Rule("long", "word_chars", "one", high=0),)).first()
    assert judged["failed"] == ["long"] and judged["base_failed"]


# --- target resampling ---------------------------------------------------------------------

def test_substring_crcs_from_running_ones():
    for n in (0, 1, 2, 9, 257, 5000):
        data = np.frombuffer(random.Random(n).randbytes(n), np.uint8)
        places = np.random.default_rng(n).integers(0, n + 1, (2, 60))
        begins, ends = places.min(axis=0), places.max(axis=0)
        found = crc_prefix.substring_crc(crc_prefix.running(data), begins, ends)
        assert found.tolist() == [zlib.crc32(data[b:e].tobytes()) for b, e in zip(begins, ends)]


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_draw(docs, target, longest, buckets, percent, least, seed):
    def buckets_of(text):
        words = TOKEN.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in buckets_of(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        n, found = buckets_of(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r in out if r[1] >= least]
    order = lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3], r[1])
    for rank, row in enumerate(sorted(fit, key=order)[:percent * len(fit) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_equals_plain_draw(spark, longest):
    rng = random.Random(4)
    word = lambda: rng.choice(["River", "stone", "ÉtÉ", "日本", "x9", "the", "Of", "𝒳", "a"]) + rng.choice(["", "s", "7"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "\x7f", "_"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "..."), (153, text(20_000)), (7, docs[7][1]), (8, text(40)), (None, text(50)), (154, "日" * 3000), (155, "a" * 70_000)]
    target = [text(30), None, "", "river stones"]
    df = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in docs], "doc_id long, text string, score int, rank string, key int").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = target_resampling.importance_resample(df, aim, longest=longest, buckets=50, percent=30, least_words=20, seed=9)
    assert drawn.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    found = sorted(map(tuple, drawn.collect()), key=repr)
    assert found == plain_draw(docs, target, longest, 50, 30, 20, 9)
    rows = target_resampling.drawn_documents(df, aim, longest=longest, buckets=50, percent=30, least_words=20, seed=9)
    assert rows.columns == df.columns and {r["doc_id"] for r in rows.collect()} == {r[0] for r in found if r[5]}


def test_draw_from_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert target_resampling.importance_resample(docs, docs).count() == 0
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in target_resampling.importance_resample(one, docs, percent=100).collect()] == [1]
