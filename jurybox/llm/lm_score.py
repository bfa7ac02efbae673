"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

The network sees WINDOW words on either side of a masked one: an embedding per place and class
of word, summed and put through tanh, gives the masked word's class in two steps, one of SIDE
groups and one of the SIDE classes in it. A word's probability is that of its class times its
share of the class's words in the training texts: the FREQUENT most frequent words are classes
of their own, all others share a class with words of the same ending. So every word of the
corpus is predicted, the counts of words grow with it as a table, and the probabilities of all
words sum to one. A document's score is the sum of the log-probabilities of its words, each
given its neighbours on both sides.

Every document trains once. A hash of id and text deals documents into shards of about
SHARD_WORDS words, and shards into ROUNDS; within a round every shard trains from the same weights in the
order of its hashes, and the weights are averaged, weighted by words. How Spark partitions the
table changes nothing but the last bits of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import give_back, settle
from jurybox.llm.tokens import chunks

SIDE = 32  # groups, and classes in a group
SIZE = SIDE * SIDE
FREQUENT = 768  # words that are classes of their own
ENDINGS = SIZE - FREQUENT  # classes of all other words, by their last ENDING characters
ENDING = 2
WINDOW = 2
PLACES = 2 * WINDOW
WIDTH = 16
ROUNDS = 2
SHARD_WORDS = 2_000_000
MAX_TASKS = 20_000  # a task takes several shards beyond that
FIRST_BATCH, BATCH = 64, 4096
RATE = 0.1
SEED = 7
SHAPES = {"embed": (PLACES * (SIZE + 1), WIDTH), "hidden": (WIDTH,), "top": (WIDTH, SIDE), "top_bias": (SIDE,),
          "low": (SIDE, WIDTH, SIDE), "low_bias": (SIDE, SIDE)}
CHUNK_BYTES = 8 << 20


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' 64-bit hashes and ending classes, every word's index among them, and each text's bounds.

    Words are lower-cased runs without white space.
    """
    import xxhash

    parts = pc.ascii_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    runs = parts.flatten().dictionary_encode()
    names = runs.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names)).view(np.int64)
    kinds = {e: xxhash.xxh3_64_intdigest(e) % ENDINGS for e in {w[-ENDING:] for w in names}}
    endings = np.fromiter((kinds[w[-ENDING:]] for w in names), dtype=np.int64, count=len(names))
    full = np.fromiter((w != "" for w in names), dtype=bool, count=len(names))
    codes = runs.indices.to_numpy(zero_copy_only=False)
    real = full[codes] if len(codes) else np.zeros(0, dtype=bool)
    places = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return hashes, endings, codes[real], np.concatenate([[0], np.cumsum(real)])[places - places[0]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            hashes, endings, codes, _ = split_words(part.column("text"))
            n = np.bincount(codes, minlength=len(hashes))
            met = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(hashes[met]), pa.array(endings[met].astype(np.int16)), pa.array(n[met])],
                                             names=["word", "ending", "n"])
    give_back()


@dataclass
class Words:
    """Counts of all words as a table (word, ending, n); the FREQUENT first by rank; words of each class."""

    counts: DataFrame
    frequent: np.ndarray
    totals: np.ndarray


def count_words(docs: DataFrame, text: str = "text") -> Words:
    """Counts over all documents, ties among the frequent broken by hash. FREQUENT and ENDINGS rows reach the driver."""
    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_count, "word bigint, ending smallint, n bigint")
    counts = settle(found.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    totals = np.zeros(SIZE, dtype=np.int64)
    for row in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        totals[FREQUENT + row["ending"]] = row["n"]
    for rank, row in enumerate(top):
        totals[rank] = row["n"]
        totals[FREQUENT + row["ending"]] -= row["n"]
    return Words(counts, np.array([r["word"] for r in top], dtype=np.int64), totals)


def classes_of(hashes: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rank of a frequent word, FREQUENT plus its ending's class for others."""
    if not len(frequent):
        return FREQUENT + endings
    order = np.argsort(frequent)
    place = np.minimum(np.searchsorted(frequent, hashes, sorter=order), len(frequent) - 1)
    return np.where(frequent[order[place]] == hashes, order[place], FREQUENT + endings)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of each range of `values`."""
    at = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _encode(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                hashes, endings, codes, bounds = split_words(part.column("text"))
                kinds = classes_of(hashes, endings, frequent.value)
                ids = kinds[codes].astype(np.int16)
                other = kinds >= FREQUENT
                rare = ids >= FREQUENT
                others = (np.cumsum(other) - 1)[codes[rare]].astype(np.int32)
                n, chunk = part.num_rows, (task << 32) + number
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, chunk)), part.column("doc_id"), part.column("key"), pa.array(np.diff(bounds)),
                    _blobs(ids, bounds), _blobs(others, np.concatenate([[0], np.cumsum(rare)])[bounds])],
                    names=["chunk", "doc_id", "key", "n_words", "ids", "others"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk]), pa.nulls(1, part.column("doc_id").type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.binary()), pa.array([hashes[other].tobytes()], pa.binary())],
                    names=["chunk", "doc_id", "key", "n_words", "ids", "others"])
        give_back()

    return run


def encode(docs: DataFrame, words: Words, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as classes of words, written: one row per document and one per chunk of text with its rarer words.

    `ids` are 16-bit classes; `others` numbers the words without a class of their own within the
    chunk. The row without `ids` holds those words' hashes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(words.frequent)
    return settle(keyed.mapInArrow(
        _encode(shared), f"chunk bigint, doc_id {kind}, key bigint, n_words bigint, ids binary, others binary"), "classes")


def contexts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The PLACES neighbours of each word, SIZE where its document has none."""
    sizes = np.diff(bounds)
    at = np.arange(len(ids)) + WINDOW * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded = np.full(len(ids) + WINDOW * (len(sizes) + 1), SIZE, dtype=np.int16)
    padded[at] = ids
    return np.stack([padded[at + shift] for shift in (*range(-WINDOW, 0), *range(1, WINDOW + 1))])


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Of each column: sums over the first axis run over whole rows of memory."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _log_share(logits: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The logarithm of each column's softmax at its taken row."""
    logits -= logits.max(axis=0)
    own = logits[taken, np.arange(len(taken))]
    return own - np.log(np.exp(logits, out=logits).sum(axis=0))


@dataclass
class Network:
    """Weights, all float32."""

    embed: np.ndarray
    hidden: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    low: np.ndarray
    low_bias: np.ndarray

    @classmethod
    def start(cls) -> Network:
        rng = np.random.default_rng(SEED)
        return cls(*(np.zeros(s, np.float32) if "bias" in name or len(s) == 1 else rng.normal(0, 0.1, s).astype(np.float32)
                     for name, s in SHAPES.items()))

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
        return cls(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), SHAPES.values())))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in SHAPES])

    def see(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embeddings that the neighbours take, and the hidden values."""
        rows = near + (SIZE + 1) * np.arange(PLACES, dtype=np.int16)[:, None]
        total = self.embed[rows[0]]
        total += self.hidden
        for row in rows[1:]:
            total += self.embed[row]
        return rows, np.tanh(total, out=total)

    def by_group(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of words by group, and (group, from, to) in it."""
        group = (ids // SIDE).astype(np.int16)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=SIDE)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if b > a]

    def log_likelihood(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Each word's log-probability of its class, given its neighbours."""
        _, h = self.see(near)
        out = _log_share(self.top.T @ h.T + self.top_bias[:, None], (ids // SIDE).astype(np.int64))
        order, groups = self.by_group(ids)
        member, h = (ids % SIDE).astype(np.int64)[order], h[order]
        for g, a, b in groups:
            out[order[a:b]] += _log_share(self.low[g].T @ h[a:b].T + self.low_bias[g][:, None], member[a:b])
        return out


class Trainer:
    """Adagrad over batches of words: small ones first, a 16th of the words seen after, up to BATCH."""

    def __init__(self, net: Network) -> None:
        self.net, self.seen = net, 0
        self.past = {name: np.full(shape, 0.1, np.float32) for name, shape in SHAPES.items()}

    def _step(self, name: str, gradient: np.ndarray, at=...) -> None:
        past = self.past[name][at] + gradient * gradient
        self.past[name][at] = past
        getattr(self.net, name)[at] -= RATE * gradient / np.sqrt(past)

    def train(self, ids: np.ndarray, near: np.ndarray) -> None:
        a = 0
        while a < len(ids):
            n = min(max(self.seen // 16, FIRST_BATCH), BATCH, len(ids) - a)
            self._batch(ids[a:a + n], near[:, a:a + n])
            self.seen += n
            a += n

    def _batch(self, y: np.ndarray, near: np.ndarray) -> None:
        net, n = self.net, len(y)
        rows, h = net.see(near)
        order, groups = net.by_group(y)
        y, h = y[order], h[order]
        group, member = (y // SIDE).astype(np.int64), (y % SIDE).astype(np.int64)
        miss = _softmax(net.top.T @ h.T + net.top_bias[:, None])
        miss[group, np.arange(n)] -= 1
        back = miss.T @ net.top.T
        steps = []
        for g, a, b in groups:
            off = _softmax(net.low[g].T @ h[a:b].T + net.low_bias[g][:, None])
            off[member[a:b], np.arange(b - a)] -= 1
            back[a:b] += off.T @ net.low[g].T
            steps.append((g, (off @ h[a:b]).T, off.sum(axis=1)))
        self._step("top", (miss @ h).T)
        self._step("top_bias", miss.sum(axis=1))
        met = [g for g, _, _ in steps]
        self._step("low", np.stack([w for _, w, _ in steps]), met)
        self._step("low_bias", np.stack([w for _, _, w in steps]), met)
        back *= 1 - h * h
        self._step("hidden", back.sum(axis=0))
        taken = rows[:, order].ravel()  # sums over equal rows of the embeddings
        by_row = np.argsort(taken, kind="stable")
        taken = taken[by_row]
        first = np.flatnonzero(np.concatenate([[True], taken[1:] != taken[:-1]]))
        self._step("embed", np.add.reduceat(back[by_row % n], first, axis=0), taken[first])


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All classes of a batch one after the other, and each document's bounds."""
    blobs = batch.column("ids").to_pylist()
    return np.frombuffer(b"".join(blobs), dtype=np.int16), np.cumsum([0, *(len(b) // 2 for b in blobs)])


def _train(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, shard, trainer = np.zeros(len(weights.value)), 0, None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a and shards[a] != shard:
                    if trainer:
                        total += trainer.net.flat().astype(np.float64) * trainer.seen
                        seen += trainer.seen
                    shard, trainer = shards[a], Trainer(Network.of(weights.value))
                for part in chunks(batch.slice(a, b - a), "ids", CHUNK_BYTES // 4):
                    ids, bounds = _documents(part)
                    trainer.train(ids, contexts(ids, bounds))
        if trainer:
            total += trainer.net.flat().astype(np.float64) * trainer.seen
            seen += trainer.seen
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), seen))],
                names=["place", "value", "seen"])
        give_back()

    return run


@dataclass
class Model:
    """Counts of words and the network's weights; the counts grow with the training texts, the weights do not."""

    words: Words
    flat: np.ndarray


def train(coded: DataFrame, words: Words) -> Model:
    """Weights from all documents of an encoded table. As many rows as there are weights reach the driver per round."""
    spark = coded.sparkSession
    each = max(1, -(-int(words.totals.sum()) // (SHARD_WORDS * ROUNDS)))  # shards of a round
    flat = Network.start().flat().astype(np.float64)
    shards = coded.where("ids IS NOT NULL AND n_words > 0").select(F.pmod("key", F.lit(each * ROUNDS)).alias("shard"), "key", "ids")
    for part in range(ROUNDS):
        weights = spark.sparkContext.broadcast(flat)
        tasks = min(each, MAX_TASKS)
        mine = shards.where(F.pmod("shard", F.lit(ROUNDS)) == part).repartitionById(
            tasks, F.pmod(F.floor(F.col("shard") / ROUNDS), F.lit(tasks)).cast("int"))
        trained = mine.sortWithinPartitions("shard", "key", "ids").mapInArrow(_train(weights), "place int, value double, seen bigint")
        means = trained.groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("w")).collect()
        flat = flat.copy()
        for row in means:
            flat[row["place"]] = row["w"]
    return Model(words, flat)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Counts of words and weights, trained on every row of `docs`.

    Null and empty texts have no words and train nothing; repeated rows train and count as often as they
    stand; equally frequent words rank by hash. A very long text is one document like others. Other
    columns are not read. An empty table gives the untrained network and no counts.
    """
    words = count_words(docs, text)
    return train(encode(docs, words, doc_id, text), words)


def _class_scores(weights, base):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.of(weights.value)
        for batch in batches:
            for part in chunks(batch, "ids", CHUNK_BYTES // 4):
                ids, bounds = _documents(part)
                near = contexts(ids, bounds)
                logp = base.value[ids]
                for a in range(0, len(ids), BATCH):
                    logp[a:a + BATCH] += net.log_likelihood(ids[a:a + BATCH], near[:, a:a + BATCH])
                total = np.concatenate([[0], np.cumsum(logp)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("chunk"), part.column("doc_id"), part.column("n_words"),
                     pa.array(total[bounds[1:]] - total[bounds[:-1]]), part.column("others")],
                    names=["chunk", "doc_id", "n_words", "pll", "others"])
        give_back()

    return run


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("others").to_pylist()):
            words = np.frombuffer(blob, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), chunk)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words)],
                names=["chunk", "number", "word"])


def _add_words(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Documents of a chunk with the logarithms of their rarer words' counts added."""
    logs = np.zeros(words.num_rows)
    logs[words.column("number").to_numpy()] = np.log(words.column("n").to_numpy())
    blobs = docs.column("others").to_pylist()
    total = np.concatenate([[0], np.cumsum(logs[np.frombuffer(b"".join(blobs), dtype=np.int32)])])
    bounds = np.cumsum([0, *(len(b) // 4 for b in blobs)])
    pll = docs.column("pll").to_numpy() + total[bounds[1:]] - total[bounds[:-1]]
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": docs.column("n_words"), "pll": pa.array(pll)})


def score_encoded(coded: DataFrame, model: Model) -> DataFrame:
    """Scores of an encoded table: classes by the network, then shares of words from the counts, by chunk of text.

    A chunk's rarer words meet their counts once each in a shuffled join; what comes back to a
    chunk is bounded by its text. A word not counted takes the class's place for unseen words,
    the same as that of a word met once.
    """
    sc, totals = coded.sparkSession.sparkContext, model.words.totals
    # share of a word: n / (words of the class + 1); the one left over is for unseen words
    base = np.where(np.arange(SIZE) < FREQUENT, np.log(np.maximum(totals, 1)), 0.0) - np.log(totals + 1.0)
    kind = coded.schema["doc_id"].dataType.simpleString()
    docs = coded.where("ids IS NOT NULL").drop("key").mapInArrow(
        _class_scores(sc.broadcast(model.flat), sc.broadcast(base)), f"chunk bigint, doc_id {kind}, n_words bigint, pll double, others binary")
    rare = coded.where("ids IS NULL").select("chunk", "others").mapInArrow(_chunk_words, "chunk bigint, number int, word bigint")
    counted = rare.join(model.words.counts.select("word", "n"), "word", "left").select(
        "chunk", "number", F.coalesce("n", F.lit(1)).alias("n"))
    scored = docs.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_add_words, f"doc_id {kind}, n_words bigint, pll double")
    return scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("pll") / F.col("n_words"))))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, pll (sum of log-probabilities) and perplexity of every row.

    Null and empty texts have no words, a pll of 0 and no perplexity. Rows are scored one by one, so
    repeated rows score alike; other columns are not read; an empty table gives an empty table.
    """
    return score_encoded(encode(docs, model.words, doc_id, text), model)


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`score` of `docs` under the model that `fit` learns from them, encoding them once."""
    words = count_words(docs, text)
    coded = encode(docs, words, doc_id, text)
    return score_encoded(coded, train(coded, words))
