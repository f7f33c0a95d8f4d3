import random
from datetime import date, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from riskspark.operators import identity

SCHEMA = ("source_system string, customer_id long, document_number string, full_name string, birth_date date, email string, "
          "phone string, created_at timestamp_ntz, updated_at timestamp_ntz")
WHEN = datetime(2020, 1, 1)


def people(n=90, seed=11):
    """Few documents, so blocks are large; fields go missing; many exact copies."""
    r, out = random.Random(seed), []
    for i in range(n):
        p = r.randrange(9)
        name = f"MARIA DA SILVA {p}" if r.random() < .8 else f"MARIA D SILVA {p}"
        out.append(("s", i, r.choice([f"doc{p}", f"doc{p}", f"doc{p % 3}", ""]), name, date(1980, 1, 1 + (p if r.random() < .8 else 20)),
                    r.choice([f"m{p}@x", f"m{p}@x", None]), r.choice([f"55{p}", f"55{p}", None]), WHEN, WHEN))
    return out + [("s", 1000 + i, *out[0][2:]) for i in range(30)]


def ratio(a, b):
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edit_ratio(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def direct_score(a, b, policy="skip", ratio=ratio):
    total = weight = 0.0
    skip = policy == "skip"
    for f, w in ((2, 1.0), (5, .8), (6, .7)):
        both = bool(a[f]) and bool(b[f])
        if both or not skip:
            weight += w
            total += w if (not both or a[f] == b[f]) else 0
    for f, w, least in ((4, .9, .85), (6, .8, .8)):
        text = lambda x: str(x) if x else "none"
        if skip and not (a[3] and b[3] and a[f] and b[f]):
            continue
        s = (ratio(text(a[3]), text(b[3])) + ratio(text(a[f]), text(b[f]))) / 2
        weight += w
        total += s * w if s >= least else 0
    return total / weight if weight else 0.0


@pytest.fixture(scope="module")
def rows():
    return people()


@pytest.fixture(scope="module")
def ids(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def wanted(rows):
    """Matches of all pairs, by direct scoring."""
    out = {}
    for x in rows:
        for y in rows:
            if x[1] < y[1]:
                s = direct_score(x, y)
                if s >= 0.8:
                    out[x[1], y[1]] = s
    return out


def groups(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_blocking_loses_no_match(spark, ids, wanted):
    variants = identity.record_variants(ids)
    got = {(r["id_a"], r["id_b"]): r["score"] for r in identity.score_pairs(identity.candidate_pairs(variants)).collect()}
    reps = {r["rep"] for r in variants.collect()}
    for (a, b), s in wanted.items():
        if a in reps and b in reps:
            assert got[a, b] == pytest.approx(s)


@pytest.mark.parametrize("policy", ["skip", "reference"])
def test_blocking_with_every_pattern_of_empty_fields(spark, policy):
    full = {2: "d1", 3: "ANA SOUZA", 4: date(1980, 1, 1), 5: "a@x", 6: "551"}
    other = {2: "d2", 3: "ANA SOUSA", 4: date(1980, 1, 2), 5: "b@x", 6: "552"}
    rows = []
    for changed in range(8):  # document, e-mail, phone of the second person
        for empty in range(32):
            x = {f: other[f] if f in (2, 5, 6) and changed >> (2, 5, 6).index(f) & 1 else full[f] for f in full}
            x = {f: None if empty >> (f - 2) & 1 else v for f, v in x.items()}
            rows.append(("s", len(rows), *[x[f] for f in sorted(x)], WHEN, WHEN))
    rows += [("s", 1000 + i, r[2], "ANA SOUSA" if r[3] else None, *r[4:]) for i, r in enumerate(rows) if i % 3 == 0]
    variants = identity.record_variants(spark.createDataFrame(rows, SCHEMA)).cache()
    reps = {r["rep"] for r in variants.collect()}
    got = {(r["id_a"], r["id_b"]): r["score"] for r in
           identity.score_pairs(identity.candidate_pairs(variants, policy), null_policy=policy).collect()}
    n = 0
    for x in rows:
        for y in rows:
            if x[1] < y[1] and {x[1], y[1]} <= reps and (s := direct_score(x, y, policy)) >= 0.8:
                assert got[x[1], y[1]] == pytest.approx(s), (x, y)
                n += 1
    assert n > 100


def strangers(n=230, seed=5):
    """People with few identifiers, their names and dates a few letters apart."""
    r, out = random.Random(seed), []
    names = ["ANA SOUZA", "JOSÉ", "LI", "MARIA APARECIDA DOS SANTOS", "PEDRO HENRIQUE LIMA", "AABBAABB", "O", "ÍRIS \U0001F600 LUZ"]

    def typed(text, alphabet, times):
        for _ in range(times):
            i, c = r.randrange(len(text) + 1), r.choice(alphabet)
            text = r.choice([text[:i] + c + text[i:], text[:i] + c + text[i + 1:], text[:i] + text[i + 1:], text[i:] + text[:i]])
        return text.strip()
    for i in range(n):
        name, day = typed(r.choice(names), "ABES ", r.randrange(5)) or None, date(1980, 1, 1)
        for _ in range(r.randrange(3)):
            day = day.replace(**r.choice([{"year": r.choice([1908, 1981, 1990, 2019])}, {"month": r.randrange(1, 13)}, {"day": r.randrange(1, 29)}]))
        if r.random() < .1:
            name, day = (None, day) if r.random() < .5 else (name, None)
        some = lambda v: v if r.random() < .3 else None
        out.append(("s", i, some(f"d{i}"), name, day, some(f"{i}@x"), some(f"55{i}"), WHEN, WHEN))
    return out


@pytest.mark.parametrize("policy", ["skip", "reference"])
@pytest.mark.parametrize("fuzzy", ["matcher", "edit"])
def test_similar_names_without_identifiers(spark, policy, fuzzy):
    rows = strangers()
    got = {(r["id_a"], r["id_b"]): r["score"] for r in
           identity.matched_pairs(spark.createDataFrame(rows, SCHEMA), fuzzy, policy).collect()}
    want, apart = {}, 0
    for x in rows:
        for y in rows:
            if x[1] < y[1] and (s := direct_score(x, y, policy, ratio if fuzzy == "matcher" else edit_ratio)) >= 0.8:
                want[x[1], y[1]] = s
                apart += x[3] != y[3] and x[4] != y[4]
    assert apart > 20
    assert all(rows[a][2:] == rows[b][2:] for a, b in got if (a, b) not in want)  # exact copies are always tied
    assert {p: got[p] for p in want if p in got} == pytest.approx({p: want[p] for p in want if p in got})
    reps = {r["rep"] for r in identity.record_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not {p for p in want if p not in got and set(p) <= reps}


def test_similar_names_are_not_compared_all_with_all(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPRSTUVZ") for _ in range(r.randrange(4, 9)))
    rows = [("s", i, None, f"{word()} {word()}", date(1940 + r.randrange(60), r.randrange(1, 13), r.randrange(1, 29)), None, None, WHEN, WHEN)
            for i in range(4000)]
    rows += [("s", 4000 + i, None, x[3][:-1] + "X", x[4], None, None, WHEN, WHEN) for i, x in enumerate(rows[:400])]
    pairs = identity.similar_pairs(identity.record_variants(spark.createDataFrame(rows, SCHEMA)))
    found = {(p["a_rep"], p["b_rep"]) for p in pairs.select("a_rep", "b_rep").collect()}
    assert {(i, 4000 + i) for i in range(400)} <= found and len(found) < 4000


def test_bound_of_ratios(spark):
    texts = [x[3] or "" for x in strangers(60)]
    pairs = [(a, b) for a in texts for b in texts]
    bound = identity.ratio_bound(F.col("a"), F.col("b"))
    for a, b, most in spark.createDataFrame(pairs, "a string, b string").select("a", "b", bound).collect():
        assert most >= SequenceMatcher(None, a, b).ratio() - 1e-9
        assert not (a or b) or most >= 1 - edits(a, b) / max(len(a), len(b)) - 1e-9


def test_components_equal_all_pairs(ids, rows, wanted):
    want = groups(wanted, [r[1] for r in rows])
    got = {r["customer_id"]: r["canonical_customer_id"] for r in identity.resolve(ids).collect()}
    assert got == want


def test_seed_mode_is_greedy_in_id_order(ids, rows, wanted):
    want, done = {}, set()
    order = sorted(r[1] for r in rows)
    for a in order:
        if a in done:
            continue
        want[a] = a
        done.add(a)
        for b in order:
            if b not in done and (a, b) in wanted:
                want[b] = a
                done.add(b)
    pairs = ids.sparkSession.createDataFrame([(a, b, s) for (a, b), s in wanted.items()], "id_a long, id_b long, score double")
    got = {r["customer_id"]: r["canonical_customer_id"] for r in identity.id_mapping(ids, pairs, mode="seed").collect()}
    assert got == want


def seeds_by_hand(links):
    near, out = {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a in sorted(near):
        if a not in out:
            for b in [a, *near[a]]:
                out.setdefault(b, a)
    return out


def test_seed_mode_on_chains_and_tangles(spark, monkeypatch):
    from riskspark.plans import fixpoint
    r, rounds = random.Random(8), []
    whole = fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: rounds.append(1) or whole(df))
    monkeypatch.setattr(identity, "cut", fixpoint.cut)
    chain = [(i, i + 1) for i in range(10_000)]
    for links, most in ((chain, 25), ([(r.randrange(300), 300 + r.randrange(300)) for _ in range(500)]
                                      + [(1000 + a, 1000 + b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(240)) if a != b], 200)):
        rounds.clear()
        pairs = spark.createDataFrame([(min(l), max(l)) for l in links], "id_a long, id_b long")
        got = {x["id"]: x["component"] for x in identity._seed_groups(pairs).collect()}
        assert got == seeds_by_hand(links) and len(rounds) <= most, len(rounds)


def test_reference_policy_counts_empty_sides(spark):
    a = ("s", 1, "d", "ANA", date(1980, 1, 1), None, "9", WHEN, WHEN)
    b = ("s", 2, "d", "ANA", date(1980, 1, 1), "a@x", "9", WHEN, WHEN)
    variants = identity.record_variants(spark.createDataFrame([a, b], SCHEMA))
    got = identity.score_pairs(identity.candidate_pairs(variants), null_policy="reference").first()["score"]
    assert got == pytest.approx(direct_score(a, b, "reference"))


def test_first_row_per_source_and_lookup(spark):
    rows = [("s", 1, "d", "B", date(1980, 1, 1), "e", "p", datetime(2021, 1, 1), WHEN), ("s", 1, "d", "A", date(1980, 1, 1), "e", "p", WHEN, WHEN)]
    kept = identity.first_per_source(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == 1 and kept[0]["full_name"] == "A"
    mapping = spark.createDataFrame([(5, 1), (1, 1)], "customer_id long, canonical_customer_id long")
    asked = spark.createDataFrame([(5,), (7,)], "customer_id long")
    assert {tuple(r) for r in identity.canonical_lookup(asked, mapping).collect()} == {(5, 1), (7, 7)}
    assert {tuple(r) for r in identity.related_ids(asked, mapping).collect()} == {(5, 1), (5, 5)}


@pytest.mark.parametrize("fuzzy", ["matcher", "edit"])
def test_pairs_with_an_equal_identifier_count_no_letters(spark, ids, fuzzy):
    """Letters counted one by one, in each of the joins, had taken nearly all of the time of the identity queries."""
    variants = identity.record_variants(ids.where("document_number <> ''"))
    plan = identity.score_pairs(identity.candidate_pairs(variants), fuzzy, at_least=0.8)
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_need_no_matching(spark):
    pairs = [("a" * 300, "a" * 300), ("", ""), ("ab", "ba"), ("maria # 1", "maria#1")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", identity.matcher_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def all_matches(rows, policy):
    """Every id pair that reaches the score, over all pairs of rows."""
    out = {}
    for x in rows:
        for y in rows:
            if x[1] < y[1] and (s := direct_score(x, y, policy, edit_ratio)) >= 0.8:
                out[x[1], y[1]] = max(s, out.get((x[1], y[1]), 0))
    return out


def copied():
    """Groups of exact copies that match each other, and ids that have two variants in two systems."""
    r = random.Random(4)
    kinds = [("d1", "ANA SOUZA", date(1980, 1, 1), "a@x", "551"), ("d1", "ANA SOUSA", date(1980, 1, 1), "a@x", "551"),
             ("d1", "ANA SOUZA", date(1980, 1, 2), None, "551"), ("d2", "JOSE LIMA", date(1975, 5, 5), "j@x", None),
             (None, "JOSE LIMA", date(1975, 5, 5), "j@x", None), (None, "JOSE LIMA", date(1975, 5, 5), None, None),
             (None, "JOSE LIMO", date(1975, 5, 5), None, None)]
    rows = [("s", i, *r.choice(kinds), WHEN, WHEN) for i in range(60)]
    return rows + [("t", i, *r.choice(kinds), WHEN, WHEN) for i in range(0, 60, 4)]


@pytest.mark.parametrize("policy", ["skip", "reference"])
def test_every_pair_of_copies_that_matches_is_listed(spark, policy):
    rows = copied()
    found = identity.matched_pairs(spark.createDataFrame(rows, SCHEMA), "edit", policy).collect()
    got, want = {(r["id_a"], r["id_b"]): r["score"] for r in found}, all_matches(rows, policy)
    assert len(found) == len(got) and got == pytest.approx(want)


@pytest.mark.parametrize("mode", ["components", "seed"])
def test_groups_of_copies(spark, mode):
    rows = copied()
    want, got = all_matches(rows, "skip"), {}
    nodes = sorted({r[1] for r in rows})
    want = groups(want, nodes) if mode == "components" else {**{n: n for n in nodes}, **seeds_by_hand(want)}
    for r in identity.resolve(spark.createDataFrame(rows, SCHEMA), "edit", mode=mode).collect():
        got[r["customer_id"]] = r["canonical_customer_id"]
    assert got == want


def test_copies_make_few_links(spark):
    rows = [("s", i, "d1", f"ANA SOUZA {i % 3}", date(1980, 1, 1), "a@x", "551", WHEN, WHEN) for i in range(300)]
    ids = spark.createDataFrame(rows, SCHEMA)
    assert identity.matched_links(ids, "edit").count() == 3 + 297
    assert identity.matched_pairs(ids, "edit").count() == 300 * 299 // 2


def test_copies_without_comparable_fields_stay_tied(spark):
    rows = [("s", i, None, "ANA", None, None, None, WHEN, WHEN) for i in range(4)]
    got = {(r["id_a"], r["id_b"]) for r in identity.matched_pairs(spark.createDataFrame(rows, SCHEMA), "edit").collect()}
    assert got == {(0, 1), (0, 2), (0, 3)}
