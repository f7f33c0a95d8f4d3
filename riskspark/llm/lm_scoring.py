"""Log-probabilities of whole texts under a log-bilinear neural model.

A token is a word or the end of its text. The model's symbols are the end, the
``words`` most frequent words, and ``classes`` classes of all other words by their
last letters. It predicts a symbol from the two before it: the context vectors, scaled
per dimension and place, add up to a predicted vector, and its inner product with a
symbol's vector plus the symbol's bias is the symbol's score. A word of a class then has its
smoothed share of the class, so every word, unseen ones too, has a probability.

Training is by noise-contrastive estimation in numpy: the model learns to tell the
symbol that follows from symbols drawn by frequency, without any normalisation. All
training texts are read, each in one of ``rounds`` rounds. In a round every task trains a
copy on its own texts, and the copies are averaged by their tokens in a shuffle;
the driver only sees the average, about (words + classes) * (2 * width + 1) numbers.

Scoring is normalised. Because scores are sums over the two places, the normalisers of all
pairs of context symbols are one product of two matrices,
sum over w of exp(first[a, w]) * exp(second[b, w] + bias[w]), and a token costs three look-ups.

Counts cover all words of all training texts. Words are told apart by 64-bit hashes. The
words counted at least ``common`` times, the threshold being set so that they are ``lookup``
at most, are looked up in the tasks; all others, of which none is frequent, meet their counts in a join.

Defined results. A null text is an empty one: its only token is the end. Rows of null id
are training rows. Equal rows are rows of their own, in training and in the
result. Without training rows the model stays as drawn, symbols almost equally likely. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text
from riskspark.llm.store import stored

#: Added to every count.
LEAST = 0.1
#: Squared gradients that a weight counts as having seen before its first step: few drawn symbols serve a
#: whole batch, so early gradients are rough.
CAUTION = 1000.0
#: Words a task holds before it gives their counts.
HELD = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def class_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word: by its last two bytes, and the one before where it has three."""
    last = data[ends - 1].astype(np.uint64)
    for back in (2, 3):
        last = last * text.U(257) + np.where(ends - starts >= back, data[np.maximum(ends - back, 0)].astype(np.uint64) + text.U(1), text.U(0))
    return (text.mix(last) % text.U(classes)).astype(np.int64)


def tokens(batch: pa.RecordBatch):
    """Per piece of the batch: first row, hashes, bytes, starts and ends of its words, and the borders of its texts."""
    for first, data, offsets in text.pieces(text.column(batch, "text")):
        data = text.LOWER[data]
        starts, ends, borders = text.words(data, offsets, text.NOT_BLANK)
        yield first, signed(text.word_hashes(data, starts, ends)), data, starts, ends, borders


def _count(classes: int):
    """(word, class, n) of a task's words; the word of the end is null."""
    def give(held: list[tuple]) -> pa.RecordBatch:
        word, kind, n = (np.concatenate(c) for c in zip(*held))
        word, first, at = np.unique(word, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(word), pa.array(kind[first]), pa.array(np.bincount(at, n, len(word)).astype(np.int64))], ["word", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for batch in batches:
            texts += batch.num_rows
            for _, word, data, starts, ends, _ in tokens(batch):
                word, first, n = np.unique(word, return_index=True, return_counts=True)
                held.append((word, class_of(data, starts[first], ends[first], classes), n))
                size += len(word)
            if size > HELD:
                merged = give(held)
                if merged.num_rows > HELD // 2:
                    yield merged
                    held, size = [], 0
                else:
                    held, size = [tuple(c.to_numpy() for c in merged.columns)], merged.num_rows
        if size:
            yield give(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([texts], pa.int64())],
                                         ["word", "kind", "n"])
    return run


class Vocabulary:
    """What tasks need to know of the counts: the common words' counts, the symbols, and the classes' sizes."""

    def __init__(self, counts: DataFrame, words: int, classes: int, lookup: int):
        seen = counts.where("n > 0")
        self.total, self.distinct, self.ends = (int(x or 0) for x in seen.agg(
            F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first())
        real = seen.where("word is not null")
        step = F.floor(F.log2("n") * 64)
        sizes = sorted(real.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect(), reverse=True)
        room, self.common = lookup, (sizes[0].n + 1) if sizes else 1
        for row in sizes:
            room -= row.words
            if room < 0:
                break
            self.common = row.n
        common = real.where(F.col("n") >= self.common).select("word", "kind", "n").toArrow()
        self.word, kind, self.n = (common.column(c).to_numpy() for c in ("word", "kind", "n"))
        order = np.argsort(self.word)
        self.word, kind, self.n = self.word[order], kind[order], self.n[order]
        best = np.lexsort((self.word, -self.n))[:words]
        self.classes, self.first_class = classes, 1 + len(best)
        self.symbol = np.zeros(len(self.word), np.int64)
        self.symbol[best] = 1 + np.arange(len(best))
        inside, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for row in real.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
            inside[row.kind], kinds[row.kind] = row.n, row.words
        inside -= np.bincount(kind[best], self.n[best], classes).astype(np.int64)
        kinds -= np.bincount(kind[best], minlength=classes)
        self.share = np.log10(inside + LEAST * (kinds + 1))
        self.counts = np.concatenate([[self.ends], self.n[best], inside]).astype(np.float64)
        # The training tasks look up the symbols alone.
        self.best = np.sort(best)

    def __len__(self) -> int:
        return len(self.counts)

    def symbols(self, word: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The symbol of each word."""
        at, known = find(self.word[self.best], word)
        return np.where(known, self.symbol[self.best][at] if len(self.best) else 0, self.first_class + kind)

    def light(self) -> Vocabulary:
        """The same symbols without the words that have none of their own."""
        out = object.__new__(Vocabulary)
        out.__dict__.update(self.__dict__, word=self.word[self.best], symbol=self.symbol[self.best], n=self.n[self.best],
                            best=np.arange(len(self.best)))
        return out


def find(sorted_words: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands in the sorted words, and whether it does."""
    if not len(sorted_words):
        return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    at = np.minimum(np.searchsorted(sorted_words, word), len(sorted_words) - 1)
    return at, sorted_words[at] == word


def sequences(symbols: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a piece, the symbols one and two before each (0 before the start), and each text's first token."""
    texts = len(borders) - 1
    target = np.zeros(len(symbols) + texts, np.int64)
    target[np.arange(len(symbols)) + np.repeat(np.arange(texts), np.diff(borders))] = symbols
    starts = borders[:-1] + np.arange(texts)
    before = np.concatenate(([0], target[:-1]))
    second = np.concatenate(([0, 0], target))[:len(target)]
    second[starts] = 0
    return target, before, second, starts


class LogBilinear:
    """``context`` and ``symbol`` vectors, two ``scale`` vectors for the places, and biases, in one matrix each."""

    def __init__(self, counts: np.ndarray, width: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        noise = (counts + 1) / (counts + 1).sum()
        self.log_noise = np.log(noise).astype(np.float32)
        self.until = np.cumsum(noise)
        draw = [rng.normal(0, 0.1, (len(counts), width)).astype(np.float32) for _ in range(2)]
        self.weights = {"context": draw[0], "symbol": draw[1], "scale": np.ones((2, width), np.float32), "bias": self.log_noise[:, None].copy()}

    def fit(self, target: np.ndarray, before: np.ndarray, second: np.ndarray, rng: np.random.Generator, grown: dict, batch: int, noise: int,
            rate: float) -> None:
        """One pass over the tokens in random order; ``grown`` keeps the squares of the gradients."""
        w, order = self.weights, rng.permutation(len(target))
        log_k = np.float32(np.log(noise))

        def ascend(name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
            by = np.argsort(rows, kind="stable")
            sorted_rows = rows[by]
            first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
            used, step = sorted_rows[first], np.add.reduceat(gradient.take(by, axis=0), first, axis=0)
            squares = grown[name].take(used, axis=0) + step * step
            grown[name][used] = squares
            w[name][used] += rate * step / np.sqrt(squares)

        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            t, a, b = target[some], before[some], second[some]
            drawn = np.minimum(np.searchsorted(self.until, rng.random(noise)), len(self.until) - 1)
            va, vb, (sa, sb) = w["context"].take(a, axis=0), w["context"].take(b, axis=0), w["scale"]
            predicted = va * sa + vb * sb
            q, z = w["symbol"].take(t, axis=0), w["symbol"][drawn]
            true = np.einsum("ij,ij->i", predicted, q) + w["bias"][t, 0] - self.log_noise[t] - log_k
            false = predicted @ z.T + (w["bias"][drawn, 0] - self.log_noise[drawn] - log_k)
            up = (1 / (1 + np.exp(np.clip(true, -30, 30))))[:, None]
            down = np.exp(np.clip(false, -30, 30, out=false), out=false)
            down /= -1 - down
            pull = up * q + down @ z
            ascend("symbol", np.concatenate([t, drawn]), np.concatenate([up * predicted, down.T @ predicted]))
            ascend("bias", np.concatenate([t, drawn]), np.concatenate([up, down.sum(axis=0)[:, None]]))
            ascend("context", np.concatenate([a, b]), np.concatenate([pull * sa, pull * sb]))
            ascend("scale", np.arange(2), np.stack([(pull * va).sum(axis=0), (pull * vb).sum(axis=0)]))

    def flat(self) -> np.ndarray:
        """All weights as rows of one width: bias rows hold one number each, padded."""
        width = self.weights["scale"].shape[1]
        return np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in self.weights.values()])

    def take(self, rows: np.ndarray) -> None:
        at = 0
        for name, m in self.weights.items():
            self.weights[name] = rows[at:at + len(m), :m.shape[1]].astype(np.float32)
            at += len(m)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (symbol before, symbol) and (symbol two before, symbol), and the log normaliser by (before, two before)."""
        w = self.weights
        first, second = ((w["context"] * s) @ w["symbol"].T for s in w["scale"])
        second += w["bias"].T
        tops = [m.max(axis=1, keepdims=True) for m in (first, second)]
        with np.errstate(divide="ignore"):
            total = np.log(np.exp(first - tops[0]) @ np.exp(second - tops[1]).T) + tops[0] + tops[1].T
        # Where the greatest terms of the two places fall apart so far that the product vanishes, add up directly.
        for a, b in np.argwhere(~np.isfinite(total)):
            both = (first[a] + second[b]).astype(np.float64)
            total[a, b] = both.max() + np.log(np.exp(both - both.max()).sum())
        return first, second, total


def _train(vocabulary: Vocabulary, model: LogBilinear, seed: int, batch: int, noise: int, rate: float):
    """A task's copy of the model after its texts: (row, tokens, values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, n = np.random.default_rng(seed), 0
        own = object.__new__(LogBilinear)
        own.__dict__.update(model.__dict__, weights={k: v.copy() for k, v in model.weights.items()})
        grown = {k: np.full(v.shape, CAUTION, np.float32) for k, v in own.weights.items()}
        for arrow in batches:
            for _, word, data, starts, ends, borders in tokens(arrow):
                symbols = vocabulary.symbols(word, class_of(data, starts, ends, vocabulary.classes))
                target, before, second, _ = sequences(symbols, borders)
                own.fit(target, before, second, rng, grown, batch, noise, rate)
                n += len(target)
        if n:
            rows = own.flat()
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), n)), values], ["row", "tokens", "v"])
    return run


def _averages(width: int):
    """Means of the rows of one partition, weighted by tokens; a row at a time is held per model row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            row, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float64)
            v = batch.column(2).flatten().to_numpy().reshape(len(row), width) * n[:, None]
            for r, values, weight in zip(row.tolist(), v, n):
                sums[r] = sums.get(r, 0) + np.append(values, weight)
        out = np.array([s[:-1] / s[-1] for s in sums.values()]).reshape(len(sums), width)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * width, pa.int32()), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), values], ["row", "v"])
    return run


def train(documents: DataFrame, vocabulary: Vocabulary, width: int, rounds: int, batch: int, noise: int, rate: float) -> LogBilinear:
    model, light = LogBilinear(vocabulary.counts, width), vocabulary.light()
    turn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds))
    for r in range(rounds):
        copies = text.in_arrow(documents.where(turn == r).select("text"), _train(light, model, r, batch, noise, rate),
                               "row bigint, tokens bigint, v array<float>")
        means = text.in_arrow(copies.repartition("row"), _averages(width), "row bigint, v array<double>").toArrow()
        if means.num_rows:
            rows = model.flat()
            rows[means.column("row").to_numpy()] = means.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
            model.take(rows)
    return model


PARTS = "row_known bigint, base double, score double, n_tokens bigint, rare array<bigint>, times array<int>"


def _score(vocabulary: Vocabulary, model: LogBilinear):
    """Per text: what the task knows of its sums, and its words that are not common, with how often they stand there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, total = model.tables()
        floor = np.log10(vocabulary.total + LEAST * (vocabulary.distinct + 1))
        log_n, log_end = np.log10(vocabulary.n + LEAST), np.log10(vocabulary.ends + LEAST)
        for batch in batches:
            out = [[] for _ in range(6)]
            for _, word, data, starts, ends, borders in tokens(batch):
                texts = len(borders) - 1
                of = np.repeat(np.arange(texts), np.diff(borders))
                kind = class_of(data, starts, ends, vocabulary.classes)
                at, known = find(vocabulary.word, word)
                symbol = np.where(known, vocabulary.symbol[at] if len(vocabulary.word) else 0, 0)
                in_class = symbol == 0
                symbol = np.where(in_class, vocabulary.first_class + kind, symbol)
                target, a, b, begin = sequences(symbol, borders)
                likely = (first[a, target].astype(np.float64) + second[b, target] - total[a, b]) / np.log(10)
                counted = np.where(known, log_n[at] if len(log_n) else 0.0, 0.0)
                size = np.diff(borders) + 1
                known_n = np.bincount(of, known, texts).astype(np.int64) + (vocabulary.ends > 0)
                base = np.bincount(of, counted, texts) + log_end - size * floor
                inside = np.where(in_class, counted - vocabulary.share[kind], 0.0)
                score = np.add.reduceat(likely, begin) + np.bincount(of, inside, texts)
                by = np.lexsort((word[~known], of[~known]))
                rare_of, rare = of[~known][by], word[~known][by]
                new = np.flatnonzero(np.concatenate(([True], (rare_of[1:] != rare_of[:-1]) | (rare[1:] != rare[:-1])))[:len(rare)])
                times = np.diff(np.append(new, len(rare)))
                ends_ = np.searchsorted(rare_of[new], np.arange(texts + 1))
                for column, values in zip(out, (known_n, base, score, size, (rare[new], ends_), (times, ends_))):
                    column.append(values)
            if batch.num_rows:
                lists = []
                for column, kind_ in zip(out[4:], (pa.int64(), pa.int32())):
                    sizes = np.concatenate([np.diff(e) for _, e in column])
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                                          pa.array(np.concatenate([v for v, _ in column]).astype(np.int64)).cast(kind_)))
                given = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*given, *(pa.array(np.concatenate(c)) for c in out[:4]), *lists],
                                                 ["doc_id", "held_out", "row_known", "base", "score", "n_tokens", "rare", "times"])
    return run


def score(documents: DataFrame, words: int = 1_535, classes: int = 512, width: int = 16, rounds: int = 4, lookup: int = 1 << 18,
          batch: int = 2_048, noise: int = 64, rate: float = 0.3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; log10 probabilities."""
    docs = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = stored(text.in_arrow(learn.select("text"), _count(classes), "word bigint, kind bigint, n bigint")
                    .groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "counts")
    vocabulary = Vocabulary(counts, words, classes, lookup)
    model = train(learn, vocabulary, width, rounds, batch, noise, rate)
    kind = dict(docs.dtypes)["doc_id"]
    parts = stored(text.in_arrow(docs, _score(vocabulary, model), f"doc_id {kind}, held_out boolean, {PARTS}")
                   .withColumn("row", F.monotonically_increasing_id()), "parts")
    pairs = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    scarce = counts.where((F.col("n") < vocabulary.common) & F.col("word").isNotNull()).select("word", "n")
    more = (pairs.join(scarce, "word", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + LEAST)).alias("more"),
                 F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")))
    extra = F.coalesce("more", F.lit(0.0))
    return parts.drop("rare", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("row_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
