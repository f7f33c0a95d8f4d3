"""Near duplicates, decontamination, top-k and toxicity against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import decontamination, near_dedup, topk, toxicity
from tests.llm.helpers import alnum, frame, odd_rows, prose, words
from tests.llm.test_operators import counted


# near duplicates

def components_by_hand(rows, percent=75):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(t) for _, t, _ in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for (i, _, _), s, g in zip(rows, sets, group):
        if i is not None and (least[g] is None or i < least[g]):
            least[g] = i
    return sets, group, [least[g] if s else rows[k][0] for k, (s, g) in enumerate(zip(sets, group))]


def near_rows(seed, n):
    rng = random.Random(seed)
    rows = odd_rows(seed)
    bases = [prose(rng, rng.randrange(3, 120), 400).split() for _ in range(5)]
    for i in range(n):
        copy = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(copy), "a"))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 16)])
def test_near_duplicates(spark, seed, block):
    rows = near_rows(seed, 250)
    sets, _, component = components_by_hand(rows)
    got = near_dedup.near_duplicates(frame(spark, rows), block=block)
    assert counted(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(
        (i, len(s), c, i == c) for (i, _, _), s, c in zip(rows, sets, component))


def test_one_of_each_group_stays(spark):
    rows = near_rows(3, 60)
    sets, group, _ = components_by_hand(rows)
    docs = frame(spark, rows)
    got = near_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert len(kept) == len({g for g, s in zip(group, sets) if s}) + len({(i, t) for (i, t, _), s in zip(rows, sets) if not s})
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_equal_rows_without_words_stay(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, " ", "a"), (1, "", "a"), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a")]
    got = near_dedup.drop_near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows[:6])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    def mixed(n):
        return np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
    common, left, right = mixed(600), mixed(200), mixed(200)
    a, b, both = np.concatenate([common, left]), np.concatenate([common, right]), np.concatenate([common, left, right])
    s = [near_dedup.sketch(np.unique(x), np.array([0, len(x)])) for x in (a, b, both)]
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2
    keeps = lambda x, y, n, m: near_dedup.likelihood_keeps(x, y, np.array([n * 1.0]), np.array([m * 1.0]), 0.75)[0]
    assert keeps(s[0], s[0], 800, 800) and not keeps(s[0], near_dedup.sketch(mixed(800), np.array([0, 800])), 800, 800)


# decontamination

def contamination_by_hand(rows, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k:k + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t, _ in rows:
        w = alnum(t)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (ids := windows.get(tuple(w[k:k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found - {None}))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_words,window,shortest", [(1 << 20, 13, 4), (30, 4, 1), (60, 13, 13)])
def test_contamination(spark, block_words, window, shortest):
    rng = random.Random(13)
    items = [(k if k % 9 else None, prose(rng, rng.randrange(shortest, 25), 7)) for k in range(25)] + [(3, None), (4, ""), (5, "..."), (1, prose(rng, 14, 7))]
    items += items[:3]
    rows = odd_rows() + [(900 + i, prose(rng, rng.randrange(60), 7), "a") for i in range(60)]
    rows += [(990, prose(rng, 400, 900) + " É " + (items[1][1] or "") + "! " + prose(rng, 300, 900), "a"), (991, items[2][1], "a")]
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n string")
    got = decontamination.contamination(docs, bench, window=window, block_words=block_words)
    have = Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(map(str, r["items"]))), r.contaminated) for r in got.collect())
    expected = contamination_by_hand(rows, items, window)
    assert have == Counter(expected)
    clean = decontamination.drop_contaminated(docs, bench, window=window, block_words=block_words)
    assert clean.columns == docs.columns
    assert Counter(r.text for r in clean.collect()) == Counter(t for (_, t, _), e in zip(rows, expected) if not e[4])


def test_cut_spans(spark):
    item = " ".join(f"b{i}" for i in range(15))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = frame(spark, [(1, f"É {filler} {item.upper()}, {filler}", "a"), (2, item, "a"), (3, filler, "a"), (4, None, "a")])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontamination.cut_spans(docs, bench).collect()}
    assert got == {1: f"É {filler} , {filler}", 3: filler, 4: None}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.cut_spans(docs, empty).count() == 4
    assert decontamination.contamination(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,0)", "string", "date"])
def test_item_ids_of_any_type(spark, kind):
    item = " ".join(f"b{i}" for i in range(15))
    value = F.lit("2024-01-05").cast("date") if kind == "date" else F.lit(7).cast(kind)
    bench = spark.range(1).select(value.alias("item_id"), F.lit(item).alias("text"))
    got = decontamination.contamination(frame(spark, [(1, item, "a"), (2, "x", "a")]), bench)
    want = bench.first()["item_id"]
    assert {r.doc_id: r["items"] for r in got.collect()} == {1: [want], 2: []}
    assert decontamination.digest(got).count() == 2


# top-k

@pytest.mark.parametrize("block,query_block", [(1 << 14, 1 << 12), (50, 5)])
def test_top_k(spark, block, query_block):
    rng = np.random.default_rng(17)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [rows[40], rows[41]]  # ties and repeated rows
    odd = [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, rows[0][1]),
           (2080, [1.0, 2.0]), (2081, [3.0, -1.0]), (2100, []), (2101, []), (2120, [0.0] * 8)]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows + odd], "vec_id bigint, embedding array<float>, rank int, score int")
    got = Counter(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 7, block=block, query_block=query_block)
                  .select("query_id", "rank", "vec_id", "score").collect())
    sound = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows + odd
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for r, (i, q) in enumerate(sound):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for c, (j, v) in enumerate(sound) if c != r and len(v) == len(q))
            expected.update((i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:7]))
    assert got == expected
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_are_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [1.0]), (20, [2.0]), (20, [2.0])], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 3, scale=1).collect())
    assert got == [(0, 1, 20, 2), (0, 2, 20, 2), (0, 3, 1, 1), *sorted([(20, 1, 20, 4), (20, 2, 0, 2), (20, 3, 1, 2)] * 2)]


def test_reading_stops_where_the_bounds_part():
    rng = np.random.default_rng(5)
    easy = np.round(rng.pareto(0.4, (4000, 6)) * 10).clip(0, 10 ** 6)
    hard = np.round(rng.normal(0, 8, (4000, 64)))
    for vectors, deepest in ((easy, 0.25), (hard, 0.875)):
        lists = topk.Lists(np.arange(4000), np.arange(4000), vectors)
        queries = np.abs(vectors[:20])
        for i, (ids, scores) in enumerate(lists.top(np.arange(20), queries, 5)):
            every = sorted((-s, j) for j, s in enumerate(vectors @ queries[i]) if j != i)[:5]
            assert [(-s, j) for j, s in zip(ids, scores)] == every
        assert max(lists.read) == deepest


# toxicity

def toxic_table(spark, n=600):
    rng = random.Random(19)
    rows, marks = [], []
    for i in range(n):
        text, toxic = prose(rng, 60, 300), rng.random() < 0.2
        if toxic:
            spoken = text.split()
            for _ in range(2):
                spoken.insert(rng.randrange(60), rng.choice(["slur", "vile", "Insult", f"lowly{rng.randrange(9)}ish"]))
            text = " ".join(spoken)
        rows.append((i, text, "a"))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_on_the_held_out_fold(spark):
    rows, marks = toxic_table(spark)
    labels = lambda m: spark.createDataFrame([(i, t, "x") for i, t in m], "doc_id bigint, toxic int, score string")
    docs = frame(spark, rows + odd_rows()[2:])
    got = toxicity.toxicity(docs, labels(marks + [(None, 1), (5, None)])).collect()
    assert len(got) == len(rows) + len(odd_rows()) - 2
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 13]
    assert len(held) > 80 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    flipped = [(i, 1 - t if next(r.held_out for r in got if r.doc_id == i) else t) for i, t in marks]
    again = toxicity.toxicity(docs, labels(flipped)).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == Counter((r.doc_id, round(r.score, 9)) for r in again)


def test_toxic_words_of_a_rare_language(spark):
    """1 % of the toxic documents are in a language of its own, and the lexicon is full without it."""
    rng = random.Random(23)
    rows, marks = [], []
    for i in range(8000):
        rare, toxic = i % 100 == 0, i % 5 == 0
        text = (" ".join(f"q{rng.randrange(300)}" for _ in range(30)) if rare else prose(rng, 30, 300)).split()
        if toxic and i % 200 < 100:
            pool = ["zufoul", "zavile", "zoslur"] if rare else [f"{a}{b}ious" for a in ("slur", "vile", "lowly", "nasty", "cruel") for b in "abcdefghijkl"]
            text += rng.sample(pool, 2 if rare else 6)
        rows.append((i, " ".join(text), "a"))
        marks.append((i, int(toxic and i % 200 < 100)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    for options in ({}, {"max_features": 100}):
        got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, **options).collect()}
        assert sum(got[i].held_out for i in range(0, 8000, 200)) >= 3
        assert all(got[i].predicted == t for i, t in marks if i % 100 == 0), options


def test_toxicity_without_labels(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.toxicity(frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(23)
    y = rng.random(6000) < 0.3
    free = [y & (rng.random(6000) < 0.7) | ~y & (rng.random(6000) < 0.05) for _ in range(4)]
    copied = y & (rng.random(6000) < 0.5) | ~y & (rng.random(6000) < 0.2)
    votes = np.stack([*free, *[copied] * 4], axis=1).astype(float)
    model = toxicity.LabelModel(votes, np.ones(6000), votes[:300], y[:300] * 0.9 + 0.05)
    assert model.correlations[4:8, 4:8].sum() / 12 > 0.9 and model.correlations[:4, :4].max() < 0.4
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93
    one, four = np.zeros((2, 1, 8))
    one[0, 0], four[0, 4:] = 1, 1
    assert model.posterior(four)[0] < model.posterior(one)[0]
