"""Merkle manifests, vector codes and language-model scores against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import lm_scoring, merkle, vector_codes
from tests.llm.helpers import frame, odd_rows, prose, words
from tests.llm.test_operators import counted


# Merkle manifest

def hashed(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_by_hand(*values):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashed(*below[i:i + arity]) for i in range(0, len(below), arity)])
    return levels


def up_by_hand(levels, i, node, arity):
    around = []
    for level in levels[:-1]:
        first = i // arity * arity
        run = level[first:first + arity]
        around += run[:i - first] + run[i - first + 1:]
        node = hashed(*run[:i - first], node, *run[i - first + 1:])
        i //= arity
    return around, node


def audit_by_hand(rows, arity=2):
    by_lang = defaultdict(list)
    for i, text, lang, source, n in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        leaf = leaf_by_hand(i, source, lang, n, text)
        by_lang[lang].append((i, leaf, leaf_by_hand(i, source, lang, n + 1, text) if tampered else leaf))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree_by_hand([leaf for _, leaf, _ in by_lang[lang]], arity))
    top = tree_by_hand([t[-1][0] for t in trees], arity) if trees else []
    out = []
    for k, (lang, levels) in enumerate(zip(langs, trees)):
        for i, (doc, leaf, given) in enumerate(by_lang[lang]):
            inside, node = up_by_hand(levels, i, given, arity)
            above, node = up_by_hand(top, k, node, arity)
            out.append((doc, leaf, levels[-1][0], top[-1][0], hashed(*inside, *above), node, node == top[-1][0]))
    return Counter(out)


def documents(spark, rows):
    full = [(i, t, lang, s, n, 1, "x", "y", 5, "h", "z") for i, t, lang, s, n in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, idx bigint, hash string, "
                                       "tree string, size int, tampered string, proof string")


def manifest_rows(seed, n):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "zz", "Z", "", None]
    rows = [(None if rng.random() < 0.05 else rng.randrange(n), prose(rng, rng.randrange(4)) or None, rng.choice(langs),
             rng.choice(["a", "ü", None]), rng.choice([None, 0, 7, -3])) for _ in range(n)]
    return rows + rows[:n // 10] + [(5, "tie", "lone", "a", 1), (2 ** 63 - 1, "", "en", "", 2 ** 62), (3, "x" * 300_000, "en", "a", 300_000)]


AUDIT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n,arity,height", [(150, 2, 12), (150, 2, 2), (97, 3, 1), (300, 2, 3), (1, 2, 12)])
def test_audit(spark, n, arity, height):
    rows = manifest_rows(n, n)
    got = merkle.audit(documents(spark, rows), arity, height)
    assert counted(got, *AUDIT) == audit_by_hand(rows, arity)


def test_manifest_of_few_rows(spark):
    assert merkle.audit(documents(spark, [])).count() == 0
    assert merkle.Manifest(documents(spark, [])).root() is None
    row = (1, "a", "en", "s", 1)
    assert counted(merkle.audit(documents(spark, [row])), *AUDIT) == audit_by_hand([row])
    assert merkle.Manifest(documents(spark, [row])).root() == leaf_by_hand(1, "s", "en", 1, "a")
    nulls = [(None, None, None, None, None)] * 3
    assert counted(merkle.audit(documents(spark, nulls)), *AUDIT) == audit_by_hand(nulls)


def test_tampering_is_found(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(200)]
    got = merkle.audit(documents(spark, rows)).collect()
    bad = {r.doc_id for r in got if not r.verified}
    assert bad == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0} and bad


def test_a_partition_asks_for_the_least_union():
    rng = random.Random(4)
    for _ in range(200):
        arity, size = rng.choice([2, 3]), rng.randrange(1, 60)
        held = sorted(rng.sample(range(size), rng.randrange(1, size + 1)))
        counts = merkle.sizes(size, arity)
        asked = merkle.missing(np.array(held), counts, arity)
        needed = set()
        for i in held:
            for level, count in enumerate(counts[:-1]):
                needed |= {(level, j) for j in range(i // arity * arity, min((i // arity + 1) * arity, count)) if j != i}
                i //= arity
        # A node with a held leaf below follows from below and is not asked for.
        derived = {(level, i // arity ** level) for i in held for level in range(len(counts))}
        assert set(asked) == needed - derived and len(asked) == len(set(asked))


# vector codes

def codes_by_hand(rows, entries=256, rounds=4, parts=4):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-2 ** 26, min(2 ** 26, math.floor(1024 * float(np.float32(x))))) for x in v], label))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[v[p * width:(p + 1) * width] for v in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * width:(p + 1) * width]
                mine[nearest(p, x)[1]].append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(p, v[p * width:(p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return Counter((i, code, error, by_label[label]) for i, code, error, label in out), text


def vectors(spark, rows):
    full = [(i, v, label, "c", 1, 2, [3]) for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, code string, error int, slot int, v array<int>")


def vector_rows(seed, n, dim=8):
    rng = random.Random(seed)
    bases = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(6)]
    rows = [(rng.randrange(n), [x + rng.gauss(0, rng.choice([0, 0.01, 0.3])) for x in rng.choice(bases)], rng.choice([0, 1, None])) for _ in range(n)]
    odd = [(None, bases[0], 0), (1, None, 1), (2, [0.5] * 7 + [None], 1), (3, [float("nan")] + [0.0] * 7, 1), (4, [float("inf")] + [0.0] * 7, 2),
           (5, [1e30] + [-1e30] * 7, 3), (6, [0.25], 3), (6, [], 3), (7, bases[1][:5], None)]
    return rows + rows[:n // 4] + odd


@pytest.mark.parametrize("seed,n,entries,cell", [(1, 80, 256, 32), (2, 150, 9, 32), (3, 150, 16, 1), (4, 60, 4, 100_000)])
def test_codes(spark, seed, n, entries, cell):
    rows = vector_rows(seed, n)
    codes, books = vector_codes.encode(vectors(spark, rows), entries=entries, cell=cell)
    want, text = codes_by_hand(rows, entries)
    assert vector_codes.listed(books) == text
    assert counted(vector_codes.with_label_errors(codes), "vec_id", "code", "error", "label_error") == want


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0), (2, [], None)], [(1, [0.5, 0.5, 0.5, 0.5], 0)]])
def test_codes_of_few_rows(spark, rows):
    codes, books = vector_codes.encode(vectors(spark, rows))
    want, text = codes_by_hand(rows)
    assert vector_codes.listed(books) == text
    assert counted(vector_codes.with_label_errors(codes), "vec_id", "code", "error", "label_error") == want


def test_most_entries_are_dominated(monkeypatch):
    rng = np.random.default_rng(1)
    entries, x = rng.normal(0, 128, (256, 16)).astype(np.int64), rng.normal(0, 128, (500, 16)).astype(np.int64)
    full = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    monkeypatch.setattr(vector_codes, "MEMO", 64)
    monkeypatch.setattr(vector_codes, "TOGETHER", 100)
    book = vector_codes.Codebook(entries, 32)
    for part in (x, x[:50], x[:50]):
        code, error = book.nearest(part)
        assert (code == full[:len(part)].argmin(axis=1)).all() and (error == full[:len(part)].min(axis=1)).all()
    compared, borders = book.candidates(x)
    assert len(compared) < len(x) * 256 / 8


# language model

def counts_by_hand(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    c = Counter()
    for (_, t, _), h in zip(rows, held):
        if not h:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t, _), h in zip(rows, held):
        mine = [*words(t), None]
        out.append((i, h, len(mine), sum(c[w] > 0 for w in mine), n,
                    round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine), 5)))
    return Counter(out)


def scored(df):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect())


@pytest.mark.parametrize("lookup,words_,classes", [(1 << 18, 1_535, 512), (40, 20, 8), (0, 0, 1)])
def test_base_scores(spark, lookup, words_, classes):
    rng = random.Random(3)
    rows = odd_rows(2)[:9] + [(100 + i, prose(rng, rng.randrange(1, 200), 900), "a") for i in range(80)]
    got = lm_scoring.score(frame(spark, rows), lookup=lookup, words=words_, classes=classes)
    assert scored(got) == counts_by_hand(rows)


def test_scores_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, t, "a") for i, t in zip(held, ["a b c", "", None, "a"])]
    got = lm_scoring.score(frame(spark, rows)).collect()
    assert scored(lm_scoring.score(frame(spark, rows))) == counts_by_hand(rows)
    assert all(math.isclose(r.score, -r.n_tokens * math.log10(513), rel_tol=0.02) for r in got)
    assert lm_scoring.score(frame(spark, [])).count() == 0


def chain_rows(seed, n):
    """Texts of two kinds, whose next word follows from the one before."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind, w, out = rng.randrange(2), 0, []
        for _ in range(rng.randrange(20, 80)):
            w = (3 * w + rng.randrange(3)) % 40
            out.append(f"{'ab'[kind]}{w}")
        rows.append((i, " ".join(out), "a"))
    return rows


def test_the_model_learns_what_follows(spark):
    got = lm_scoring.score(frame(spark, chain_rows(5, 1500)), words=60, classes=4, batch=256).where("held_out")
    base, score, n = got.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (score - base) / n > 0.4


def test_probabilities_add_up_and_follow_from_the_weights():
    rng = np.random.default_rng(2)
    model = lm_scoring.LogBilinear(rng.integers(0, 50, 30).astype(float), 5)
    target, before, second = (rng.integers(0, 30, 4000) for _ in range(3))
    grown = {k: np.full(v.shape, 1.0, np.float32) for k, v in model.weights.items()}
    model.fit(target, before, second, rng, grown, 64, 8, 0.3)
    first, other, total = model.tables()
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    for a in range(30):
        for b in range(30):
            s = w["symbol"] @ (w["context"][a] * w["scale"][0] + w["context"][b] * w["scale"][1]) + w["bias"][:, 0]
            p = np.exp(first[a].astype(np.float64) + other[b] - total[a, b])
            assert abs(p.sum() - 1) < 1e-4
            assert np.allclose(p, np.exp(s - s.max()) / np.exp(s - s.max()).sum(), rtol=1e-3, atol=1e-7)


def test_normalisers_of_far_apart_scores():
    model = lm_scoring.LogBilinear(np.ones(3), 1)
    model.weights["context"] = np.array([[400.0], [-400.0], [0.0]], np.float32)
    model.weights["symbol"] = np.array([[1.0], [-1.0], [0.0]], np.float32)
    first, other, total = model.tables()
    both = (first[0] + other[1]).astype(np.float64)
    assert np.isfinite(total).all() and abs(np.exp(both - total[0, 1]).sum() - 1) < 1e-3


def test_contexts_stay_inside_their_text():
    target, before, second, starts = lm_scoring.sequences(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]))
    assert target.tolist() == [1, 2, 3, 0, 0, 4, 0] and starts.tolist() == [0, 4, 5]
    assert before.tolist() == [0, 1, 2, 3, 0, 0, 4]
    assert second.tolist() == [0, 0, 1, 2, 0, 0, 0]
