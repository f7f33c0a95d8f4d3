"""Toxicity by weak supervision.

1. A bounded sample of labelled rows gives a lexicon: whole words, beginnings
   and ends of words that stand in toxic documents far more often than in others,
   in many of them or beyond chance. If that is more than the lexicon holds, entries
   come first that stand in a toxic document which has few others, so that the words
   of a rare language are not crowded out.
2. Voters are the lexicon split by kind, by precision and at random, two for
   one or many precise entries, and patterns of spelling that know no label. A voter fires or
   stays silent on a text, so a text has one vote pattern.
3. A generative label model is fitted to the pattern counts of all documents
   outside the held-out fold, with the labelled sample as an anchor: EM on two
   classes gives each voter's firing rates;
   voters that are correlated inside the classes (they fire for the same reason)
   then count less, and EM runs again. At most 2^voters counts
   come to the driver.
4. The posterior odds are scaled to the labels of the sample.
5. A logistic model on the lexicon entries is fitted to the posterior labels
   of the sample's texts, and scores every document in one pass.

Labels are read only where crc32(doc_id as text) mod 5 is not 0. Texts and
nothing else enter a score.

Bounds: ``sample_rows`` labelled rows, ``max_features`` lexicon entries.

Defined results. Null and empty texts score like a text without any entry. A
null id counts as held out. Labels with null id or null mark are left out, of
labels that disagree on an id the toxic one holds. Without usable labels every
score is 0. Each row of ``documents`` gives one row; ``doc_id`` and ``text`` are
the only columns read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as tx
from riskspark.llm.store import stored

FOLDS = 5
#: Kinds of entries: whole words, and first or last bytes of longer words.
KINDS = [("word", 0)] + [("start", n) for n in (3, 4, 5, 6, 7)] + [("end", n) for n in (4, 5, 6)]
#: One odd number per kind.
SALTS = np.arange(1, len(KINDS) + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
TABLE_BITS = 20
PATTERNS = 3
#: Probability by chance of an entry that stands in few toxic documents; entries each toxic document has before others fill up.
CHANCE, COVER = 1e-3, 8


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold whose labels are never read."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS == 0


def entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, word indices, hashes of the words' entries of this kind)."""
    for k in kinds:
        name, n = KINDS[k]
        at = np.arange(len(starts)) if name == "word" else np.flatnonzero(ends - starts > n)
        s = ends[at] - n if name == "end" else starts[at]
        e = starts[at] + n if name == "start" else ends[at]
        yield k, at, tx.mix(tx.word_hashes(data, s, e) + SALTS[k])


class Table:
    """A fixed set of entry hashes: finds the index of those that occur."""

    def __init__(self, hashes: np.ndarray, kinds: list[int]):
        self.order = np.argsort(hashes)
        self.hashes, self.kinds = hashes[self.order], sorted(set(kinds))
        self.bits = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.bits[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, data, starts, ends, borders) -> tuple[np.ndarray, np.ndarray]:
        """(text, entry) pairs, each once."""
        texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, at, h in entries(data, starts, ends, self.kinds):
            maybe = np.flatnonzero(self.bits[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            ok = self.hashes[i] == h[maybe]
            texts.append(np.searchsorted(borders, at[maybe[ok]], side="right") - 1)
            found.append(self.order[i[ok]])
        pairs = np.unique(np.concatenate(texts) * len(self.hashes) + np.concatenate(found))
        return np.divmod(pairs, len(self.hashes)) if len(self.hashes) else (pairs, pairs)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
    for first, raw, offsets in tx.pieces(tx.column(batch, "text")):
        data = tx.LOWER[raw]
        yield (first, raw, offsets, data, *tx.words(data, offsets, tx.ALNUM))


def _counts(known: np.ndarray | None):
    """(h, kind, n): in how many texts each entry stands; only the ``known`` hashes, if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, data, starts, ends, borders in _tokens(batch):
                for k, at, h in entries(data, starts, ends, list(range(len(KINDS)))):
                    text = np.searchsorted(borders, at, side="right") - 1
                    if known is not None:
                        have = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                        text, h = text[have], h[have]
                    order = np.lexsort((h, text))
                    text, h = text[order], h[order]
                    first = np.ones(len(h), dtype=bool)
                    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                    values, n = np.unique(h[first], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values.view(np.int64)), pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))],
                        ["h", "kind", "n"])
    return run


COUNTS = "h bigint, kind int, n bigint"


def spelling(raw: np.ndarray, offsets: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """Label-free voters: mostly capitals, many exclamation marks, hardly any words."""
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    upper, lower = sums((raw >= 65) & (raw <= 90)), sums((raw >= 97) & (raw <= 122))
    n_words = np.diff(borders)
    return [upper > lower, sums(raw == 33) * 20 > n_words, n_words < 5]


def beyond_chance(n: int, other: int, rate: float) -> bool:
    """Whether ``n`` toxic of ``n + other`` documents are too many for a share ``rate`` (a Chernoff bound)."""
    total, share = n + other, n / (n + other)
    gap = share * np.log(share / rate) + ((1 - share) * np.log((1 - share) / (1 - rate)) if other else 0.0)
    return share > rate and total * gap >= -np.log(CHANCE)


def _found(table: Table):
    """(entries): of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data, starts, ends, borders in _tokens(batch):
                text, entry = table.find(data, starts, ends, borders)
                at = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(entry.astype(np.int32)))], ["entries"])
    return run


def covering(documents: list[list[int]], n: int, most: int) -> list[int]:
    """``most`` of ``n`` ranked entries: first those that stand in a document with fewer than COVER chosen ones, then by rank."""
    standing: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(documents):
        for e in own:
            standing[e].append(i)
    have, chosen = np.zeros(len(documents), dtype=np.int64), []
    for e in range(n):
        if len(chosen) < most and (have[standing[e]] < COVER).any():
            chosen.append(e)
            have[standing[e]] += 1
    taken = set(chosen)
    return sorted(chosen + [e for e in range(n) if e not in taken][:most - len(chosen)])


class Voters:
    """The lexicon table, the voter each entry belongs to, and which entries are precise."""

    def __init__(self, table: Table, voter: np.ndarray, n: int, precise: np.ndarray):
        self.table, self.voter, self.n, self.precise = table, voter, n, precise

    def votes(self, raw, offsets, data, starts, ends, borders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vote pattern of each text as a number, and the (text, entry) pairs it rests on."""
        text, entry = self.table.find(data, starts, ends, borders)
        pattern = np.zeros(len(offsets) - 1, dtype=np.int64)
        np.bitwise_or.at(pattern, text, np.int64(1) << self.voter[entry])
        found = np.bincount(text, self.precise[entry], minlength=len(pattern))
        for j, fires in enumerate([found >= 1, found >= 3, *spelling(raw, offsets, borders)]):
            pattern |= fires.astype(np.int64) << (self.n + j)
        return pattern, text, entry

    @property
    def width(self) -> int:
        return self.n + 2 + PATTERNS


def _patterns(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets, data, starts, ends, borders in _tokens(batch):
                values, n = np.unique(voters.votes(raw, offsets, data, starts, ends, borders)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["pattern", "n"])
    return run


def _described(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets, data, starts, ends, borders in _tokens(batch):
                pattern, text, entry = voters.votes(raw, offsets, data, starts, ends, borders)
                at = np.searchsorted(text, np.arange(len(pattern) + 1)).astype(np.int32)
                toxic = batch.column(0).slice(first, len(pattern))
                yield pa.RecordBatch.from_arrays(
                    [toxic, pa.array(pattern), pa.ListArray.from_arrays(pa.array(at), pa.array(entry.astype(np.int32)))],
                    ["toxic", "pattern", "entries"])
    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class LabelModel:
    """Two classes; voters fire or stay silent, with class-wise firing rates and correlations.

    A voter counts less the more it is correlated with others inside the classes.
    ``marked`` texts (of votes ``own``) keep their class and weigh as much as all
    counts together, so that the classes stay what the labels mean.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, own: np.ndarray, marked: np.ndarray, rounds: int = 20):
        every = np.vstack([votes, own])
        mass = np.concatenate([counts, np.full(len(own), counts.sum() / max(len(own), 1))])
        self.correlations = np.zeros((votes.shape[1],) * 2)
        self.fit(own, np.ones(len(own)), marked)
        for correlated in (False, True):
            if correlated:
                self.correlations = self.correlation(every, mass, np.concatenate([self.posterior(votes), marked]))
            for _ in range(rounds):
                self.fit(every, mass, np.concatenate([self.posterior(votes), marked]))

    def fit(self, votes: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> None:
        mass = np.stack([(1 - posterior) * counts, posterior * counts])
        self.rates = (mass @ votes + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)
        self.prior = (mass[1].sum() + 0.5) / (mass.sum() + 1)

    def odds(self, votes: np.ndarray) -> np.ndarray:
        fired, silent = (np.log(r[1]) - np.log(r[0]) for r in (self.rates, 1 - self.rates))
        weights = 1 / (1 + self.correlations.sum(axis=1))
        return np.log(self.prior / (1 - self.prior)) + (votes * fired + (1 - votes) * silent) @ weights

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(self.odds(votes))

    @staticmethod
    def correlation(votes: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Positive correlations of pairs of voters inside the classes."""
        total = np.zeros((votes.shape[1],) * 2)
        for mass in (counts * posterior, counts * (1 - posterior)):
            share = mass / max(mass.sum(), 1e-12)
            centred = votes - share @ votes
            cov = (centred * share[:, None]).T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            total += np.maximum(cov / np.outer(sd, sd), 0) / 2
        np.fill_diagonal(total, 0)
        return total


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 25) -> np.ndarray:
    """Logistic weights (the last one the bias) for soft labels, classes balanced, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    balance = y * 0.5 / max(y.mean(), 1e-6) + (1 - y) * 0.5 / max(1 - y.mean(), 1e-6)
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        curve = (x * (balance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        move = np.linalg.solve(curve + np.diag(ridge), x.T @ ((y - p) * balance) - ridge * w)
        w = w + move * min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return w


class Scorer:
    """What a task needs to score: the lexicon and one weight per entry. Bounded by ``max_features``."""

    def __init__(self, table: Table | None, weights: np.ndarray | None):
        self.table, self.weights = table, weights

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.table is None:
            return np.zeros(batch.num_rows)
        out = [np.zeros(0)]
        for _, _, offsets, data, starts, ends, borders in _tokens(batch):
            text, entry = self.table.find(data, starts, ends, borders)
            z = self.weights[-1] + np.bincount(text, self.weights[entry], minlength=len(offsets) - 1)
            out.append(sigmoid(z))
        return np.concatenate(out)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 8000, max_features: int = 512,
          support: float = 0.02) -> Scorer:
    """Fit the lexicon, the label model and the linear model."""
    docs = documents.select("doc_id", "text")
    marks = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows pairs of an id and a mark: their size is bounded.
    sample = stored(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct(), "sample")
    total = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    if not n_toxic:
        return Scorer(None, None)

    # An entry in fewer toxic documents than ``support`` asks for has to be beyond chance.
    least = 3 if n_toxic >= 10 else 1
    many, rate = max(least, int(support * n_toxic)), n_toxic / (n_toxic + n_clean)
    toxic = (sample.where("toxic = 1").transform(tx.in_arrow, _counts(None), COUNTS).groupBy("h", "kind")
             .agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())
    if not toxic:
        return Scorer(None, None)
    known = np.sort(np.array([r.h for r in toxic], dtype=np.int64).view(np.uint64))
    clean = {r.h: r.n for r in sample.where("toxic = 0").transform(tx.in_arrow, _counts(known), COUNTS).groupBy("h")
             .agg(F.sum("n").alias("n")).collect()}
    rated = []
    for r in toxic:
        share, other = (r.n + 0.5) / (n_toxic + 1), (clean.get(r.h, 0) + 0.5) / (n_clean + 1)
        if share >= 5 * other and (r.n >= many or beyond_chance(r.n, clean.get(r.h, 0), rate)):
            rated.append((share * np.log(share / other), r.h, r.kind, (r.n + 0.5) / (r.n + clean.get(r.h, 0) + 1)))
    rated.sort(key=lambda x: (-x[0], x[1]))
    if len(rated) > max_features:
        every = Table(np.array([x[1] for x in rated], dtype=np.int64).view(np.uint64), [x[2] for x in rated])
        found = sample.where("toxic = 1").select("text").transform(tx.in_arrow, _found(every), "entries array<int>")
        rated = [rated[e] for e in covering([r.entries for r in found.collect()], len(rated), max_features)]
    if not rated:
        return Scorer(None, None)

    hashes = np.array([x[1] for x in rated], dtype=np.int64).view(np.uint64)
    table = Table(hashes, [x[2] for x in rated])
    # Twelve voters: by kind, by precision of the entry, and in two random halves.
    kind = np.array([0 if x[2] == 0 else 1 if KINDS[x[2]][0] == "start" else 2 for x in rated])
    weak = np.array([x[3] < 0.9 for x in rated]).astype(int)
    voters = Voters(table, kind * 4 + weak * 2 + (hashes % np.uint64(2)).astype(int), 12, 1.0 - weak)

    described = sample.transform(tx.in_arrow, _described(voters), "toxic int, pattern bigint, entries array<int>").collect()
    bits = lambda p: ((np.asarray(p)[:, None] >> np.arange(voters.width)) & 1).astype(float)
    own = bits([r.pattern for r in described])
    marked = np.array([r.toxic for r in described], dtype=float)
    counted = (docs.where(~held_out(F.col("doc_id"))).select("text").transform(tx.in_arrow, _patterns(voters), "pattern bigint, n bigint")
               .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect())
    votes, counts = bits([r.pattern for r in counted]), np.array([r.n for r in counted], dtype=float)
    model = LabelModel(votes, counts, own, np.clip(marked, 0.02, 0.98))

    x = np.zeros((len(described), len(rated)), dtype=np.float32)
    for i, r in enumerate(described):
        x[i, r.entries] = 1
    # Discounted votes give odds in the right order but too close to even: one slope and one bias scale them.
    odds = model.odds(own)[:, None]
    slope, bias = fit_linear(odds, marked)
    soft = sigmoid(odds[:, 0] * slope + bias)
    weights = fit_linear(x, soft)
    # The same for the linear model, whose weights the ridge keeps small.
    slope, bias = fit_linear((x @ weights[:-1])[:, None], soft, l2=1e-4)
    return Scorer(table, np.append(weights[:-1] * slope, bias))


def _scored(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch))], ["doc_id", "score"])
    return run


def _below(scorer: Scorer, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch) < threshold))
    return run


def toxicity(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``documents``."""
    scorer = train(documents, labels, **options)
    docs = documents.select("doc_id", "text")
    scored = docs.transform(tx.in_arrow, _scored(scorer), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents whose score is below ``threshold``, all columns unchanged, without a shuffle."""
    return documents.transform(tx.in_arrow, _below(train(documents, labels, **options), threshold), documents.schema)
