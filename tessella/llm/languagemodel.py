"""LM scoring: a gated recurrent network in numpy with a class-factored softmax.

Documents whose crc32(doc_id as text) mod 10 is not 0 train the model. Word counts cover
all of them. The network knows the ``WORDS`` most frequent words; any other is a token of
the rare class, whose members share its probability as the smoothed counts do, so the
model is a proper distribution over all texts. It starts at the counts (output biases)
and is trained by truncated backpropagation in one pass over all training documents.

Texts become ids once; training and scoring read these. Training documents are dealt to
shards by a hash of doc_id and ids and sorted by it. The number of shards follows from the
training tokens alone (``SHARD_TOKENS`` each, at most ``MAX_SHARDS`` a round), so the model
does not depend on partitions, and a replica always sees enough to learn. In each of
``ROUNDS`` rounds every shard trains a replica from the same start, and replicas are
averaged by tokens, in the order of shards.

A shard's documents are one stream, cut into lanes that run side by side; when scoring, a
document's state starts at zero and is carried across windows to its end.

Counts of the ``LOOKUP`` most frequent words are sent to all tasks (a fixed bound); words
beyond them are joined with the counts table, which never holds a hot key.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the
empty string; repeated rows are scored each; without training documents every token is
unknown and the counts are 0; very long texts are scored whole; an empty table gives an
empty result; other columns are untouched.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import table

HIDDEN = 16
CLASSES = 32
PER_CLASS = 64
WORDS = CLASSES * PER_CLASS
LOOKUP = 65_536
SMOOTHING = 0.1
ROUNDS = 2
#: Training tokens of a shard, shards of a round at most, tasks that average replicas.
SHARD_TOKENS = 1 << 21
MAX_SHARDS = 4096
AVERAGES = 16
#: Streams trained side by side, each of LANE_TOKENS or more; tokens held at once; steps of backpropagation.
LANES = 256
LANE_TOKENS = 256
BLOCK_TOKENS = 1 << 22
WINDOW = 32
RATE = 0.15
CLIP = 5.0
#: Documents scored side by side, and steps whose outputs are computed at once.
SCORE_LANES = 512
SCORE_WINDOW = 64
END = b""
RARE, START = WORDS, WORDS + 1


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end token."""
    raw = text or b""
    words = (raw.encode() if isinstance(raw, str) else raw).lower().split()
    words.append(END)
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def _exp_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows of ``x``, shifted so that nothing overflows (``x`` is changed), and the rows' sums."""
    # where all values are near each other one shift serves all rows
    high = x.max(initial=0.0)
    x -= high if high - x.min(initial=0.0) < 80 else x.max(axis=1, keepdims=True)
    e = np.exp(x)
    return e, e @ np.ones(e.shape[1], e.dtype)


class Network:
    """Parameters, scoring and training. Word ids are frequency ranks; RARE stands for the rest."""

    def __init__(self, counts: np.ndarray, rare: float) -> None:
        """``counts`` of the known words, most frequent first, and the summed counts of all others."""
        random = np.random.default_rng(11)
        h, f = HIDDEN, np.float32
        known = np.zeros(WORDS)
        known[: len(counts)] = counts
        known += SMOOTHING
        by_class = known.reshape(CLASSES, PER_CLASS)
        mass = np.append(by_class.sum(axis=1), rare + SMOOTHING)
        self.p = {
            "x": random.normal(0, 0.3, (WORDS + 2, 3 * h)).astype(f),
            "u": random.normal(0, 0.3, (h, 3 * h)).astype(f),
            "c": np.zeros((h, CLASSES + 1), f),
            "bc": np.log(mass / mass.sum()).astype(f),
            "o": np.zeros((WORDS, h), f),
            "bo": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(f).ravel(),
        }

    def dumps(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def loads(self, blob: bytes) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.frombuffer(blob, np.float32, v.size, at).reshape(v.shape).copy()
            at += v.nbytes
        return self

    def step(self, word: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The next state: gates z and r, and r weighs what the state gives to the new value."""
        h = HIDDEN
        x, g = self.p["x"][word], state @ self.p["u"]
        zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
        n = np.tanh(x[:, 2 * h :] + zr[:, h:] * g[:, 2 * h :])
        return n + zr[:, :h] * (state - n)

    def output(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target class and, but for the rare class, word."""
        group = np.minimum(target // PER_CLASS, CLASSES)
        x = states @ self.p["c"] + self.p["bc"]
        total = _exp_rows(x)[1]
        logp = x[np.arange(len(target)), group] - np.log(total)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            rows = order[ends[k] : ends[k + 1]]
            if len(rows):
                own = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
                x = states[rows] @ self.p["o"][own].T + self.p["bo"][own]
                total = _exp_rows(x)[1]
                logp[rows] += x[np.arange(len(rows)), target[rows] - k * PER_CLASS] - np.log(total)
        return logp

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each document's ids; documents of like length run side by side."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for at in range(0, len(order), SCORE_LANES):
            rows = order[at : at + SCORE_LANES]
            lengths = np.array([len(docs[i]) for i in rows])
            state = np.zeros((len(rows), HIDDEN), np.float32)
            word = np.full(len(rows), START)
            for begin in range(0, lengths[0], SCORE_WINDOW):
                states, targets, lane = [], [], []
                for t in range(begin, min(begin + SCORE_WINDOW, lengths[0])):
                    live = int(np.searchsorted(-lengths, -t, "left"))  # lengths fall: those over t
                    if t == begin:
                        chunk = np.zeros((live, SCORE_WINDOW), np.int64)
                        for k in range(live):
                            part = docs[rows[k]][begin : begin + SCORE_WINDOW]
                            chunk[k, : len(part)] = part
                    state = self.step(word[:live], state[:live])
                    word = chunk[:live, t - begin]
                    states.append(state)
                    targets.append(word)
                    lane.append(live)
                logp = self.output(np.concatenate(states), np.concatenate(targets))
                out[rows] += np.bincount(np.concatenate([np.arange(n) for n in lane]), logp, len(rows))
        return out / math.log(10)

    def train(self, docs: Iterator[np.ndarray]) -> int:
        """One pass over documents; returns the tokens used."""
        self.sums = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}
        used, held, n = 0, [], 0
        for doc in docs:
            held.append(doc)
            n += len(doc)
            if n >= BLOCK_TOKENS:
                used, held, n = used + self._block(held), [], 0
        return used + (self._block(held) if held else 0)

    def _block(self, docs: list[np.ndarray]) -> int:
        """Train on the documents as one stream in lanes; a lane starts at state zero."""
        target = np.concatenate(docs).astype(np.int64)
        n = len(target)
        first = np.zeros(n, bool)
        first[np.cumsum([0, *map(len, docs[:-1])])] = True
        word = np.where(first, START, np.r_[START, target[:-1]])
        lanes = int(np.clip(n // LANE_TOKENS, 1, LANES))
        steps = -(-n // lanes)

        def laid(x: np.ndarray, fill: int) -> np.ndarray:
            return np.concatenate([x, np.full(lanes * steps - n, fill, x.dtype)]).reshape(lanes, steps).T

        target, word, first = laid(target, -1), laid(word, START), laid(first, True)
        state = np.zeros((lanes, HIDDEN), self.p["x"].dtype)
        for t in range(0, steps, WINDOW):
            state = self._window(word[t : t + WINDOW], target[t : t + WINDOW], first[t : t + WINDOW], state)
        return n

    def _window(self, words: np.ndarray, target: np.ndarray, first: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step of truncated backpropagation; returns the last state."""
        p = self.p
        grads, used, state = self.gradients(words, target, first, state)
        scale = 1 / math.sqrt(max(1, int((target >= 0).sum())))
        for k, g in grads.items():
            g *= scale
            np.clip(g, -CLIP, CLIP, out=g)
            rows = used if k == "x" else slice(None)
            self.sums[k][rows] += g * g
            p[k][rows] -= RATE * g / np.sqrt(self.sums[k][rows])
        return state

    def gradients(self, words: np.ndarray, target: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the negative log likelihood (``x``: of the used rows alone), the used rows, the last state."""
        p, h = self.p, HIDDEN
        inputs, u = p["x"][words], p["u"]
        live = (~first).astype(state.dtype)[:, :, None]
        before, after, zr, n, un = (np.empty((*target.shape, k), inputs.dtype) for k in (h, h, 2 * h, h, h))
        for t in range(len(target)):
            b = np.multiply(state, live[t], out=before[t])
            g = b @ u
            un[t] = g[:, 2 * h :]
            g[:, : 2 * h] += inputs[t, :, : 2 * h]
            zr[t] = _sigmoid(g[:, : 2 * h])
            n[t] = np.tanh(inputs[t, :, 2 * h :] + zr[t, :, h:] * un[t])
            state = after[t] = n[t] + zr[t, :, :h] * (b - n[t])
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
        outputs = self._output_gradient(after.reshape(-1, h), target.ravel(), grads).reshape(after.shape)
        z, r = zr[:, :, :h], zr[:, :, h:]
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), un * r * (1 - r)
        # what reaches the gates from the state (own), and from the input: it differs by r in the last third
        own, back, dn = np.empty_like(inputs), np.zeros_like(state), np.empty_like(n)
        for t in range(len(target) - 1, -1, -1):
            d = back + outputs[t]
            m = np.multiply(d, to_n[t], out=dn[t])
            np.multiply(d, to_z[t], out=own[t, :, :h])
            np.multiply(m, to_r[t], out=own[t, :, h : 2 * h])
            np.multiply(m, r[t], out=own[t, :, 2 * h :])
            back = (d * z[t] + own[t] @ u.T) * live[t]
        grads["u"] = before.reshape(-1, h).T @ own.reshape(-1, 3 * h)
        own[:, :, 2 * h :] = dn
        # only the rows of words in the window have a gradient, and no others move
        order = np.argsort(words, axis=None, kind="stable")
        used, start = np.unique(words.ravel()[order], return_index=True)
        grads["x"] = np.add.reduceat(own.reshape(-1, 3 * h)[order], start, axis=0)
        return grads, used, state

    def _output_gradient(self, states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Gradient of the negative log likelihood to the states; fills the output layers' gradients."""
        out = np.zeros_like(states)
        real = np.flatnonzero(target >= 0)
        s, y = states[real], target[real]
        group = np.minimum(y // PER_CLASS, CLASSES)
        d, total = _exp_rows(s @ self.p["c"] + self.p["bc"])
        d /= total[:, None]
        d[np.arange(len(y)), group] -= 1
        grads["c"] += s.T @ d
        grads["bc"] += d.sum(axis=0)
        ds = d @ self.p["c"].T
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            rows = order[ends[k] : ends[k + 1]]
            if not len(rows):
                continue
            own = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
            mine = s[rows]
            e, total = _exp_rows(mine @ self.p["o"][own].T + self.p["bo"][own])
            e /= total[:, None]
            e[np.arange(len(rows)), y[rows] - k * PER_CLASS] -= 1
            grads["o"][own] += e.T @ mine
            grads["bo"][own] += e.sum(axis=0)
            ds[rows] += e @ self.p["o"][own]
        out[real] = ds
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts in UTF-8."""
    return (t.as_py() for t in batch.column("text").cast(pa.binary()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in _texts(batch):
            counts.update(tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training documents; the end token is the empty word."""
    return train.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Ranks and counts of the most frequent words, and the totals of all."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int) -> None:
        self.rank = {bytes(w): i for i, (w, _) in enumerate(top)}
        self.counts = np.array([c for _, c in top], np.float64)
        self.total, self.distinct = total, distinct
        self.scale = total + SMOOTHING * (distinct + 1)
        #: log10 of the base probability by rank, and of all words beyond the network's
        self.log_base = np.log10((self.counts + SMOOTHING) / self.scale)
        self.log_rare = math.log10(max(1 - float(((self.counts[:WORDS] + SMOOTHING) / self.scale).sum()), SMOOTHING / self.scale))

    def head(self) -> tuple[np.ndarray, float]:
        """Counts of the network's words, and of all others together."""
        return self.counts[:WORDS], self.total - self.counts[:WORDS].sum()

    def network(self) -> Network:
        return Network(*self.head())

    def ids(self, text: str | bytes | None) -> tuple[np.ndarray, list[bytes]]:
        words = tokens(text)
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words)), words


def fit(train: DataFrame, vocabulary: Vocabulary) -> bytes:
    """The parameters trained on the documents ``train(doc_id, ids)``."""
    spark = train.sparkSession
    shards = int(min(MAX_SHARDS, max(1, vocabulary.total // (ROUNDS * SHARD_TOKENS))))
    place = F.xxhash64(F.lit("train"), "doc_id", "ids")
    dealt = train.withColumn("place", place).withColumn("turn", F.pmod("place", F.lit(ROUNDS * shards)))
    dealt = dealt.select("doc_id", "ids", "place", (F.col("turn") % ROUNDS).alias("turn"), F.floor(F.col("turn") / ROUNDS).cast("int").alias("shard"))
    schema = "shard int, used long, blob binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "used", "blob"])

    network = vocabulary.network()
    for turn in range(ROUNDS):
        docs = dealt.filter(F.col("turn") == turn).select("shard", "place", "doc_id", "ids")
        docs = docs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "doc_id").select("shard", "ids")
        sent = spark.sparkContext.broadcast((vocabulary.head(), network.dumps()))

        def replicas(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (counts, rare), blob = sent.value
            rows = ((s, x.as_buffer()) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
            for shard, own in groupby(rows, itemgetter(0)):
                replica = Network(counts, rare).loads(blob)
                used = replica.train(np.frombuffer(x, np.int16).copy() for _, x in own)
                yield batch_of([(shard, used, replica.dumps())])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, mean, shard = 0, None, 0
            for b in batches:
                for shard, used, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    v = np.frombuffer(blob, np.float32).astype(np.float64)
                    total += used
                    mean = v if mean is None else mean + (v - mean) * (used / total)
            if mean is not None:
                yield batch_of([(shard % AVERAGES, total, mean.astype(np.float32).tobytes())])

        trained = docs.mapInArrow(replicas, schema).repartitionById(AVERAGES, F.col("shard") % AVERAGES).sortWithinPartitions("shard")
        rows = sorted(tuple(r) for r in trained.mapInArrow(average, schema).collect())
        for b in average([batch_of([(s, u, bytes(x)) for s, u, x in rows])] if rows else []):
            network.loads(b.column(2)[0].as_py())
        sent.unpersist()
    return network.dumps()


def as_ids(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` as network ids, with what the counts alone say of each text.

    ``base`` is the base score of words in the lookup, ``extra`` what their membership of
    the rare class adds to the network's score; ``rest`` are the words beyond the lookup.
    """
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            found, rest, times, ends, local = [], [], [], [0], []
            for text in _texts(batch):
                ids, own = words.ids(text)
                beyond = Counter(compress(own, (ids < 0).tolist()))
                rest += beyond.keys()
                times += beyond.values()
                ends.append(len(rest))
                seen = ids[ids >= 0]
                rare = seen[seen >= WORDS]
                base = words.log_base[seen].sum() if len(seen) else 0.0
                extra = words.log_base[rare].sum() - len(rare) * words.log_rare if len(rare) else 0.0
                local.append((len(ids), len(seen), float(base), float(extra)))
                found.append(np.where(ids < 0, RARE, np.minimum(ids, RARE)).astype(np.int16).tobytes())
            pairs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], ["w", "n"]))
            del rest, times
            n, known, base, extra = zip(*local, strict=True) if local else ([],) * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "held_out")), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(extra, pa.float64()), pa.array(found, pa.binary()), pairs], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "extra", "ids", "rest"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, extra double, ids binary, rest array<struct<w:binary,n:long>>"
    return rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the base score and the model's score."""
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    counts = materialize(word_counts(rows.filter(~F.col("held_out"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # written first, so that the driver gets LOOKUP rows and not as many from each partition
    top = sorted(((bytes(r["word"]), r["c"]) for r in materialize(counts.orderBy(F.desc("c"), "word").limit(LOOKUP), "top").collect()), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(top, total, distinct)
    known = materialize(as_ids(rows, vocabulary), "ids")
    sent = spark.sparkContext.broadcast((vocabulary.head(), fit(known.filter(~F.col("held_out")).select("doc_id", "ids"), vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, rare), blob = sent.value
        network = Network(head, rare).loads(blob)
        for batch in batches:
            part = network.score([np.frombuffer(x.as_buffer(), np.int16).astype(np.int64) for x in batch.column("ids")])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(part, pa.float64())], [*batch.schema.names[:-1], "part"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, extra double, part double"
    scored = known.drop("rest").mapInArrow(run, schema)
    more = known.select("uid", F.explode("rest").alias("r")).select("uid", F.col("r.w").alias("word"), F.col("r.n").alias("n")).join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    more = more.groupBy("uid").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum("n").alias("more_n"), F.sum(F.col("n") * F.log10((c + SMOOTHING) / vocabulary.scale)).alias("more_base"))
    out = scored.join(more, "uid", "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("part") + F.col("extra") + zero("more_base") - zero("more_n") * vocabulary.log_rare).alias("score"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
