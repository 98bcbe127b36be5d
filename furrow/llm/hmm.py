"""A hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores.

Tokens are words (A-Z folded) and one end. Every training word has emissions by
state of its own, kept in a table that grows with the vocabulary; all words
that training lacks share one symbol. The model is a distribution over whole
texts, and gathers counts from all training texts, each of them whole. Texts are packed into buckets
with the list of their words, so that a word's emissions are joined once a
bucket. The HEAD most frequent words, which nearly all buckets hold, travel by
broadcast instead; the scores do not depend on their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import bucketed, forgotten, single_rows, table, written
from furrow.llm.quality import fold
from furrow.llm.words import slices, words

#: Words whose emissions are broadcast; those of all others are joined.
HEAD = 262_144
STATES = 6
ITERATIONS = 4
SEED = 7
#: Tokens that are counted, or padded to one block, at a time.
BLOCK = 500_000
#: Tokens from which a bucket of whole texts is complete.
BUCKET = 1_000_000
#: Longer texts are worked off in stretches of so many tokens side by side, with what each stretch hands to the next.
STRETCH = 1024
#: Steps after which products over a stretch are scaled to 1 again.
RESCALE = 8
#: Tokens by the words' shares that each state is taken to have beyond its own.
PRIOR = 500.0
#: Occurrences that each word is taken to have beyond its own, by the states' shares of all tokens: a rare word leans little to a state.
WORD_PRIOR = 10.0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    texts = 0

    def out() -> pa.RecordBatch:
        token, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c)], names=["token", "c"])

    for batch in batches:
        texts += batch.num_rows
        for _, _, data, offsets in slices(batch.column("text")):
            held.append(words(data, offsets, lower=True).hash)
            if sum(map(len, held)) > 8 * BLOCK:
                yield out()
                held = []
    if held:
        yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts], pa.int64())], names=["token", "c"])


class Vocabulary:
    """Places of the head words' hashes: their rank, -1 for all others; the end has the place after them."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.sorted, self.symbol = hashes[order], order.astype(np.int32)
        self.end = len(hashes)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.symbol[at], np.int32(-1))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """A row per bucket of whole texts: places of head words, and behind the end's those of the bucket's other words (rest)."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        rows, ids, train, counts, hashes = zip(*held, strict=True)
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        symbol = vocabulary.symbols(distinct)
        other = symbol < 0
        rest = distinct[other]
        symbol[other] = vocabulary.end + 1 + np.arange(len(rest))
        symbol = symbol[place]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [one(pa.concat_arrays(ids)), one(pa.concat_arrays(train)), one(pa.array(np.concatenate(counts))), pa.array([symbol.tobytes()], pa.binary()), one(pa.array(rest.view(np.int64)))]
        return pa.RecordBatch.from_arrays([rows[0].slice(0, 1), *columns], names=["bucket", "doc_ids", "train", "lengths", "symbols", "rest"])

    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            w = words(data, offsets, lower=True)
            part = batch.slice(lo, hi - lo)
            held.append((part.column("row"), part.column("doc_id"), part.column("train"), w.counts.astype(np.int64), w.hash))
            size += len(w.hash) + hi - lo
            if size >= BUCKET:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, at, x) of sequences of like length, longest first: x[at[t] : at[t + 1]] are the symbols at time t of all that are as long."""
    length = np.array([len(s) for s in sequences])
    order = np.argsort(-length, kind="stable")
    done = 0
    while done < len(order):
        longest = length[order[done]]
        to = min(len(order), done + max(1, BLOCK // longest))
        chosen = order[done:to]
        padded = np.zeros((longest, len(chosen)), np.int32)
        for b, i in enumerate(chosen):
            padded[: length[i], b] = sequences[i]
        there = np.arange(longest)[:, None] < length[chosen]
        yield chosen, length[chosen], np.append(0, np.cumsum(there.sum(1))), padded[there]
        done = to


def _cut_up(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple[int, bool]]]:
    """Stretches of all sequences in order, each with its sequence and whether it begins it."""
    cuts = [(i, a) for i, s in enumerate(sequences) for a in range(0, len(s), STRETCH)]
    return [sequences[i][a : a + STRETCH] for i, a in cuts], [(i, a == 0) for i, a in cuts]


class Model:
    """Start (K), moves (K, K) and emissions (symbols, K)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        """Of symbols, by state and place."""
        return np.ascontiguousarray(self.emit[x].T)

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each whole sequence by the scaled forward recursion."""
        out = np.zeros(len(sequences))
        short = [i for i, s in enumerate(sequences) if len(s) <= STRETCH]
        for chosen, _, at, x in _blocks([sequences[i] for i in short]):
            emit, total, alpha = self._emissions(x), np.zeros(len(chosen)), None
            for a, b in zip(at, at[1:], strict=False):
                alpha = (self.start[:, None] if alpha is None else self.moves.T @ alpha[:, : b - a]) * emit[:, a:b]
                scale = alpha.sum(0)
                alpha /= scale
                total[: b - a] += np.log(scale)
            out[np.array(short)[chosen]] = total
        long = [i for i, s in enumerate(sequences) if len(s) > STRETCH]
        stretches, of = _cut_up([sequences[i] for i in long])
        products, logs = self._products(stretches, of)
        for (i, begins), p, log in zip(of, products, logs, strict=True):
            alpha = (self.start if begins else alpha) @ p
            out[long[i]] += log + math.log(alpha.sum())
            alpha = alpha / alpha.sum()
        return out / math.log(10)

    def _products(self, stretches: list[np.ndarray], of: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """What each stretch makes of the states before it: its product of moves and emissions, of sum 1, and the natural log of the scale."""
        k = len(self.start)
        begins = np.array([b for _, b in of], bool)
        products, logs = np.zeros((len(stretches), k, k)), np.zeros(len(stretches))
        for chosen, _, at, x in _blocks(stretches):
            emit = self._emissions(x)
            product = np.repeat(np.eye(k)[:, :, None], len(chosen), 2)  # by state after, state before and stretch
            for t, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                n, held = b - a, product.shape[2]
                if n < held:
                    products[chosen[n:held]] = product[:, :, n:].transpose(2, 1, 0)
                    product = np.ascontiguousarray(product[:, :, :n])
                product = (self.moves.T @ product.reshape(k, k * n)).reshape(k, k, n)
                if t == 0:
                    product[:, :, begins[chosen]] = np.eye(k)[:, :, None]  # a text's first symbol has no move before it
                product *= emit[:, None, a:b]
                if t % RESCALE == RESCALE - 1:
                    scale = product.sum((0, 1))
                    product /= scale
                    logs[chosen[:n]] += np.log(scale)
            products[chosen[: product.shape[2]]] = product.transpose(2, 1, 0)
        scale = products.sum((1, 2))
        return products / scale[:, None, None], logs + np.log(scale)

    def _borders(self, stretches: list[np.ndarray], of: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch the state probabilities before it (0 for a text's first) and what comes after it as seen from its last state (1 at a text's end)."""
        before, after = np.zeros((len(stretches), len(self.start))), np.ones((len(stretches), len(self.start)))
        ends = [i + 1 == len(of) or of[i + 1][1] for i in range(len(of))]
        cut = [i for i, (_, b) in enumerate(of) if not (b and ends[i])]
        products, _ = self._products([stretches[i] for i in cut], [of[i] for i in cut])
        for i, p in zip(cut, products, strict=True):
            if not ends[i]:
                alpha = (self.start if of[i][1] else before[i]) @ p
                before[i + 1] = alpha / alpha.sum()
        for i, p in zip(reversed(cut), products[::-1], strict=True):
            if not of[i][1]:
                beta = p @ after[i]
                after[i - 1] = beta / beta.sum()
        return before, after

    def expected(self, sequences: list[np.ndarray], emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """Adds the expected counts (forward-backward) of whole sequences to the three arrays."""
        stretches, of = _cut_up(sequences)
        begins = np.array([b for _, b in of], bool)
        before, after = self._borders(stretches, of)
        for chosen, length, at, x in _blocks(stretches):
            emit, first = self._emissions(x), begins[chosen]
            alpha, scales = np.empty_like(emit), np.empty(len(x), emit.dtype)
            into = np.where(first, self.start[:, None], self.moves.T @ before[chosen].T)
            for t, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if t:
                    into = self.moves.T @ alpha[:, at[t - 1] : at[t - 1] + b - a]
                now = np.multiply(into, emit[:, a:b], out=alpha[:, a:b])
                scales[a:b] = now.sum(0)
                now /= scales[a:b]
            emit /= scales
            # beta at a stretch's last symbol, such that the states' probabilities there sum to 1
            last = alpha[:, at[length - 1] + np.arange(len(chosen))]
            rest = after[chosen].T
            rest = (rest / (last * rest).sum(0)).astype(emit.dtype)
            beta = rest[:, : at[-1] - at[-2]]
            pairs = np.zeros_like(moved)
            for t in range(len(at) - 2, 0, -1):
                c, a, b = at[t - 1 : t + 2]
                ahead = emit[:, a:b] * beta
                alpha[:, a:b] *= beta  # the states' probabilities from here on
                pairs += alpha[:, c : c + b - a] @ ahead.T
                beta = self.moves @ ahead
                if b - a < a - c:
                    beta = np.concatenate((beta, rest[:, b - a : a - c]), 1)
            # the move into a stretch from the one before it
            pairs += before[chosen].T @ (emit[:, : at[1]] * beta).T
            alpha[:, : at[1]] *= beta
            moved += pairs * self.moves
            started += alpha[:, : at[1]][:, first].sum(1)
            for k in range(len(self.start)):
                emitted[:, k] += np.bincount(x, alpha[k], minlength=len(emitted))


def smoothed(c: np.ndarray, s: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    """Weights by state of words with training counts c and expected counts s; over the states they are c + 0.5, and the prior's part."""
    return (s + WORD_PRIOR * share) * ((c + 0.5) / (c + WORD_PRIOR))[:, None] + PRIOR * ((c + 0.5) / total)[:, None]


class Parameters(NamedTuple):
    """What is broadcast of a model: hashes (top) of the head words, counts c of them and the end, their emissions, and how to make those of other words."""

    start: np.ndarray
    moves: np.ndarray
    top: np.ndarray
    c: np.ndarray
    emit: np.ndarray
    total: float
    share: np.ndarray | None
    weight: np.ndarray

    def bucket(self, batch: pa.RecordBatch, i: int, size: int) -> tuple[np.ndarray, Model]:
        """Training counts of, and the model over, the places of bucket i, which has size other words; those of training are held with their place (at), count c and values s0, ..."""
        k = len(self.start)
        c, s = np.zeros(size), np.zeros((size, k))
        if batch.column("held")[i].is_valid:
            values = batch.column("held")[i].values
            held = lambda name: values.field(name).to_numpy(zero_copy_only=False)
            at = held("at")
            c[at] = held("c")
            s[at] = np.stack([held(f"s{j}") for j in range(k)], 1)
        if self.share is None:  # values of the first round are weights already, but for words without any
            emit = np.where(c[:, None] > 0, s, 0.5 / self.total) / self.weight
        else:
            emit = smoothed(c, s, self.share, self.total) / self.weight
        return np.concatenate((self.c, c)), Model(self.start, self.moves, np.concatenate((self.emit, emit)))


def _texts(batch: pa.RecordBatch, i: int, end: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The texts of a bucket with their ends, whether they are for training, and the bucket's other words."""
    symbols = np.frombuffer(batch.column("symbols")[i].as_py(), np.int32)
    length = batch.column("lengths")[i].values.to_numpy(zero_copy_only=False)
    last = np.cumsum(length)
    train = batch.column("train")[i].values.to_numpy(zero_copy_only=False)
    rest = batch.column("rest")[i].values.to_numpy(zero_copy_only=False)
    return [np.append(symbols[a:b], np.int32(end)) for a, b in zip(last - length, last, strict=True)], train, rest


def _expectations(batches: Iterator[pa.RecordBatch], p: Parameters) -> Iterator[pa.RecordBatch]:
    """(place, token, c, s0, ...): expected counts by token, with their place those of head words; by place alone those of the end, and below 0 of moves and start."""
    k = len(p.start)
    end = len(p.emit) - 1
    emitted, moved, started = np.zeros((k, end + 1)).T, np.zeros((k, k)), np.zeros(k)  # counts of a state lie together
    names = ["place", "token", "c", *(f"s{i}" for i in range(k))]

    def out(place: pa.Array, token: pa.Array, c: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        values = values.astype(np.float32)
        return pa.RecordBatch.from_arrays([place, token, c, *(pa.array(values[:, i].copy()) for i in range(k))], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            sequences, train, rest = _texts(batch, i, end)
            learnt = [s for s, t in zip(sequences, train, strict=True) if t]
            if not learnt:
                continue
            c, model = p.bucket(batch, i, len(rest))
            # counts are sums of state probabilities, scaled at every symbol, and leave as single floats: half the memory, and no loss that shows
            model = Model(model.start, model.moves.astype(np.float32), model.emit.astype(np.float32))
            here = np.zeros((k, len(model.emit))).T
            model.expected(learnt, here, moved, started)
            emitted += here[: end + 1]
            here = here[end + 1 :]
            seen = np.flatnonzero(here.sum(1))
            yield out(pa.nulls(len(seen), pa.int64()), pa.array(rest[seen]), pa.array(c[end + 1 :][seen].astype(np.int64)), here[seen])
    seen = np.flatnonzero(emitted.sum(1))
    place = np.concatenate((seen, [-1 - i for i in range(k)], [-1 - k])).astype(np.int64)
    head = (place >= 0) & (place < end)
    token = np.where(head, np.append(p.top, 0)[np.where(head, place, -1)], 0)
    yield out(pa.array(place), pa.array(token, mask=~head), pa.nulls(len(place), pa.int64()), np.concatenate((emitted[seen], moved, started[None])))


def _noise(seed: int, i: int):
    """Gamma noise (shape 2, scale 0.5) of a word for state i, from the word's hash alone."""
    uniform = lambda j: (F.shiftrightunsigned(F.xxhash64("token", F.lit(seed), F.lit(i), F.lit(j)), 11) + 0.5) / float(1 << 53)
    return F.log(uniform(0) * uniform(1)) * -0.5 + 0.05


def _attached(encoded: DataFrame, pairs: DataFrame, emissions: DataFrame) -> DataFrame:
    """encoded with a list (held) of those of the bucket's other words that emissions (token, c, s0, ...) has: place (at), count and values.

    pairs are the other words of all buckets (bucket, at, token).
    """
    values = [c for c in emissions.columns if c != "token"]
    held = pairs.join(emissions, "token").groupBy("bucket").agg(F.collect_list(F.struct("at", *values)).alias("held"))  # a bucket's words at most
    return encoded.join(held, "bucket", "left").drop("bucket")


def baum_welch(encoded: DataFrame, pairs: DataFrame, words_: DataFrame, top: np.ndarray, ends: int, total: float, states: int, iterations: int, seed: int) -> tuple[Parameters, DataFrame]:
    """The model after some rounds of expected counts over all training texts, and the table of the other words' values (token, c, s0, ...).

    encoded and pairs are bucketed tables, by bucket and by token. words_ (token, c) are all training words, top the head words' hashes in their order.
    """
    context = encoded.sparkSession.sparkContext
    columns = [f"s{i}" for i in range(states)]
    first = words_.select("token", "c", *[((F.col("c") + 0.5) / total * _noise(seed, i)).cast("float").alias(c) for i, c in enumerate(columns)])
    weight = np.array(first.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in columns]).first(), float)
    heads = encoded.sparkSession.createDataFrame(pa.table({"place": np.arange(len(top)), "token": top}))  # HEAD rows at most
    head = first.join(F.broadcast(heads), "token").toArrow().to_pandas().sort_values("place")
    c = np.append(head["c"].to_numpy(), ends).astype(np.float64)
    unigram, unseen = (c + 0.5) / total, 0.5 / total
    emit = np.concatenate((head[columns].to_numpy(dtype=float), np.full((1, states), unigram[-1])))
    weight = weight + unigram[-1] + unseen
    stay = 0.95
    moves = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(moves, stay if states > 1 else 1.0)
    now = Parameters(np.full(states, 1 / states), moves, top, c, emit / weight, total, None, weight)
    # the head words are in no bucket's list
    emissions, before = first.join(F.broadcast(heads), "token", "left_anti"), None
    for _ in range(iterations):
        sent = context.broadcast(now)
        counts = _attached(encoded.drop("doc_ids"), pairs, emissions)
        counts = counts.mapInArrow(lambda b, sent=sent: _expectations(b, sent.value), "place long, token long, c long, " + ", ".join(f"{c} float" for c in columns))
        with single_rows(encoded.sparkSession):
            # the sums stay where the deal by token put them, and so does the next join
            sums, name = bucketed(counts, "emissions", "token", lambda d: d.groupBy("token", "place").agg(F.max("c").alias("c"), *[F.sum(F.col(c).cast("double")).cast("float").alias(c) for c in columns]))
        if before:
            forgotten(encoded.sparkSession, before)
        before = name
        emissions = sums.where("place is null").select("token", "c", *columns)
        fixed = sums.where("place is not null").drop("token", "c").toArrow().to_pandas()  # a row per head word, state and the start
        place, value = fixed["place"].to_numpy(), fixed[columns].to_numpy()
        emitted = np.zeros_like(now.emit)
        emitted[place[place >= 0]] = value[place >= 0]
        moved = np.zeros((states, states))
        inner = (place < 0) & (place >= -states)
        moved[-1 - place[inner]] = value[inner]
        started = value[place == -1 - states].sum(0)
        scale = (F.col("c") + 0.5) / (F.col("c") + WORD_PRIOR)
        rest = emissions.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (*columns, *(F.col(i) * scale for i in columns), scale, (F.col("c") + 0.5) / total)]).first()
        rest = np.array(rest, float)
        share = emitted.sum(0) + rest[:states] + 1
        share = share / share.sum()
        emit = smoothed(c, emitted, share, total)
        # over the head, the other words and the one for unseen words
        weight = emit.sum(0) + rest[states : 2 * states] + WORD_PRIOR * share * rest[-2] + PRIOR * rest[-1] + smoothed(np.zeros(1), np.zeros((1, states)), share, total)[0]
        emit = emit / weight
        now = Parameters((started + 1) / (started + 1).sum(), (moved + 1) / (moved + 1).sum(1, keepdims=True), top, c, emit, total, share, weight)
        sent.unpersist()
        context._jvm.System.gc()  # Spark deletes the shuffle files of a round once its plan is collected
    return now, emissions


def score_texts(docs: DataFrame, train, head: int = HEAD, states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of whole texts.

    train is a condition on docs for the rows to learn from (null: not). Null and
    empty texts are the end alone. base_score adds log10((c + 0.5) / (n + 0.5 * (v + 1)))
    over the tokens, with training counts c, n of them in all, v distinct. Without
    any training row all counts are 0. Every row is scored, repeated ones too.
    head only says how many words' emissions are broadcast instead of joined.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = texts.where("train").select("text").mapInArrow(_word_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    counts = written(counts, "counts")
    ends, = counts.where("token is null").agg(F.sum("c")).first()
    ends = ends or 0
    known = counts.where("token is not null")
    v, n = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = known.orderBy(F.desc("c"), "token").limit(head).select("token").toArrow()["token"].to_numpy().astype(np.int64)  # head rows at most
    v, n = v + (ends > 0), n + ends

    vocabulary = spark.sparkContext.broadcast(Vocabulary(top.view(np.uint64)))
    kind = dict(docs.dtypes)["doc_id"]
    encoded = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        lambda b: _encoded(b, vocabulary.value), f"bucket long, doc_ids array<{kind}>, train array<boolean>, lengths array<long>, symbols binary, rest array<long>"
    )
    # dealt by bucket once, so that the joins of all rounds move the emissions alone
    dealt, name = bucketed(encoded, "texts", "bucket")
    pairs, pairs_name = bucketed(dealt.select("bucket", F.posexplode("rest").alias("at", "token")), "pairs", "token")
    spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffle files of the deal once its plan is collected

    total = n + 0.5 * (v + 1)
    # without training the end is not among the words, but still a symbol
    last, emissions = baum_welch(dealt, pairs, known, top, ends, total if ends else total + 0.5, states, iterations, seed)
    model = spark.sparkContext.broadcast(last)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sequences, _, rest = _texts(batch, i, len(model.value.emit) - 1)
                c, local = model.value.bucket(batch, i, len(rest))
                logs = np.log10(c + 0.5) - math.log10(total)
                base = np.array([logs[s].sum() for s in sequences])
                size = np.array([len(s) for s in sequences], np.int64)
                seen = np.array([np.count_nonzero(c[s]) for s in sequences], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(size), pa.array(seen), pa.array(base), pa.array(local.log10(sequences))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]
                )

    with single_rows(spark):
        scored = written(_attached(dealt, pairs, emissions).mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"), "scores")
    forgotten(spark, name)
    forgotten(spark, pairs_name)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fold("doc_id") != 1)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
