"""Quality classifier: random-indexing vectors pooled per document, then a small calibrated network.

Every word and every word form (letters, capitals, digits and signs, runs collapsed)
has a sparse random index vector that follows from its hash. The vocabulary is that of
the labelled sample the network is fitted to: its WORDS most frequent words and FORMS
most frequent forms. Over all documents each of these sums the index vectors of its
neighbours, whatever these are; the sums, scaled, are the word vectors, one a word. A
document pools the vectors of its known words and forms, the index vectors of all its
words and forms, and the share that is not known. A network of two layers, written in numpy, is fitted to a
bounded sample of labelled rows and its probabilities are calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import arrow_map, arrow_schema, slices, trim
from modelwatch.llm.words import Words, mix, words

WORDS, FORMS = 1 << 15, 1 << 12  # of the sample that have vectors at most
DIMS = 64
NONZERO = 4  # entries of an index vector
SAMPLE = 20_000  # labelled rows that the vocabulary and the network are fitted to at most
THRESHOLD = 0.7
PRIOR = 20
FAR = 4.0  # standard deviations
FOLDS, HELD_OUT = 4, 2
_BLOCK = 1 << 15  # words whose vectors are in memory at a time

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def forms(found: Words) -> np.ndarray:
    """A hash of each word's form: classes of characters with runs collapsed."""
    kind = _CLASS[found.data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[found.starts] = True
    at = np.concatenate([[0], np.cumsum(fresh)])
    return Words(kind[fresh], found.offsets, at[found.starts], at[found.ends], found.first).hashes()


def index_entries(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the NONZERO entries of each hash's index vector, as rows."""
    bits = mix(hashed ^ np.uint64(0x5851F42D4C957F2D))
    shifts = np.uint64(8) * np.arange(NONZERO, dtype=np.uint64)
    part = (bits[:, None] >> shifts).astype(np.int64)
    return part & (DIMS - 1), 1 - 2 * ((part >> 7) & 1)


def _both(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every word and of every form."""
    return found.hashes(), forms(found)


def _place(vocabulary: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Each hash's place in a sorted vocabulary; its size where it has none."""
    if not len(vocabulary):
        return np.zeros(len(hashed), np.int64)
    at = np.searchsorted(vocabulary, hashed)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashed, at, len(vocabulary))


@dataclass
class Vocabulary:
    """Sorted hashes of words and of forms."""

    words: np.ndarray
    forms: np.ndarray

    def __len__(self) -> int:
        return len(self.words) + len(self.forms)

    def places(self, found: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place, hash) of every word and of every form; words come before forms, and what is not known is at the end."""
        w, f = _both(found)
        at_w, at_f = _place(self.words, w), _place(self.forms, f) + len(self.words)
        return [(np.where(at_w == len(self.words), len(self), at_w), w), (at_f, f)]


def sample_vocabulary(sample: DataFrame, most: tuple[int, int] = (WORDS, FORMS)) -> Vocabulary:
    """The words and forms with the most occurrences in ``sample`` (text, ...), counted in Spark; ties by hash."""
    wide = "form boolean, hash long, n long"
    schema = arrow_schema(wide)

    def make():
        def step(rows: pa.RecordBatch):
            cells = [np.unique(h, return_counts=True) for h in _both(words(rows.column("text")))]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([False, True], [len(h) for h, _ in cells])), pa.array(np.concatenate([h for h, _ in cells]).view(np.int64)), pa.array(np.concatenate([n for _, n in cells]))], schema=schema)

        return step

    counts = arrow_map(sample.select("text"), make, wide, "text").groupBy("form", "hash").agg(F.sum("n").alias("n"))
    kept = [counts.where(F.col("form") == form).orderBy(F.desc("n"), "hash").limit(k).select("hash").toArrow() for form, k in zip((False, True), most, strict=True)]
    return Vocabulary(*(np.sort(rows.column("hash").to_numpy().view(np.uint64)) for rows in kept))


def context_sums(documents: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """[len(vocabulary), DIMS + 1]: for each word and form the sum of its neighbours' index vectors, and its occurrences, over all documents.

    Each task sums its own texts; Spark adds these sums by word, in integers, so the
    order doesn't matter. The result's size follows from WORDS, FORMS and DIMS alone.
    """
    size = len(vocabulary)
    out = np.zeros((size, DIMS + 1), np.int64)
    if not size:
        return out
    columns = [f"d{i}" for i in range(DIMS + 1)]
    wide = "place int, " + ", ".join(f"{c} long" for c in columns)
    schema = arrow_schema(wide)

    def run(batches):
        total = np.zeros((size + 1, DIMS + 1), np.int32)
        flat, many = np.zeros((size + 1) * DIMS, np.int32), 0

        def settled() -> pa.RecordBatch:
            total[:, :DIMS] = flat.reshape(-1, DIMS)
            some = np.flatnonzero(total[:size, DIMS])
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, i].astype(np.int64)) for i in range(DIMS + 1))], schema=schema)

        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                found = words(rows.column("text"))
                if not len(found.starts):
                    continue
                owner = found.owner()
                together = np.flatnonzero(owner[1:] == owner[:-1])
                for place, hashed in vocabulary.places(found):
                    dim, sign = index_entries(hashed)
                    for to, at in ((together, together + 1), (together + 1, together)):
                        known = place[to] < size
                        cell = (place[to[known]][:, None] * DIMS + dim[at[known]]).ravel()
                        np.add.at(flat, cell, sign[at[known]].ravel().astype(np.int32))
                    total[:, DIMS] += np.bincount(place, minlength=size + 1).astype(np.int32)
                many += len(owner)
                if many > 1 << 28:  # before 32 bits could overflow
                    yield settled()
                    total[:], flat[:], many = 0, 0, 0
        yield settled()
        trim()

    sums = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, wide).groupBy("place").agg(*(F.sum(c).alias(c) for c in columns))
    table = sums.toArrow()  # a row a word at most
    place = table.column("place").to_numpy()
    for i, c in enumerate(columns):
        out[place, i] = table.column(c).to_numpy()
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Mean neighbour vector of each word, drawn to zero as if it had PRIOR more occurrences without neighbours; in the last row zeros, for words that are not known."""
    return np.concatenate([sums[:, :DIMS] / (sums[:, DIMS:] + PRIOR), np.zeros((1, DIMS))]).astype(np.float32)


@dataclass
class Space:
    """The vocabulary and its vectors."""

    vocabulary: Vocabulary
    vectors: np.ndarray


_PART = 2 * DIMS + 3
FEATURES = 2 * _PART + 1


def _sums_by_text(place: np.ndarray, vectors: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The sum of each text's vectors, _BLOCK words at a time."""
    out = np.zeros((texts, DIMS))
    for at in range(0, len(place), _BLOCK):
        of = owner[at : at + _BLOCK]
        head = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
        out[of[head]] += np.add.reduceat(vectors[place[at : at + _BLOCK]], head, axis=0)
    return out


def pooled(column: pa.Array, space: Space) -> np.ndarray:
    """[texts, FEATURES]: for words and for forms the mean vector of the known ones, the mean index vector and its length, the
    shares of repeats of the word before and of unknown ones; then the text's length. Texts without words are zeros."""
    found = words(column)
    n = found.counts()
    out = np.zeros((len(n), FEATURES), np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    size = n[some][:, None]
    owner = found.owner()
    again = np.zeros(len(owner), bool)
    again[1:] = owner[1:] == owner[:-1]
    at, unknown = 0, len(space.vocabulary)
    for place, hashed in space.vocabulary.places(found):
        missing = np.bincount(owner[place == unknown], minlength=len(n))[some][:, None]
        dim, sign = index_entries(hashed)
        own = np.bincount((owner[:, None] * DIMS + dim).ravel(), sign.ravel(), len(n) * DIMS).reshape(-1, DIMS)[some] / size
        same = again.copy()
        same[1:] &= hashed[1:] == hashed[:-1]
        parts = [_sums_by_text(place, space.vectors, owner, len(n))[some] / np.maximum(size - missing, 1), own, np.bincount(owner[same], minlength=len(n))[some][:, None] / size, missing / size, np.sqrt((own * own).sum(1, keepdims=True))]
        out[some, at : at + _PART] = np.concatenate(parts, 1)
        at += _PART
    out[some, at] = np.log1p(size[:, 0])
    return out


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh units, a logistic output over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Inputs in standard deviations, FAR at most, so that an odd text can't leave the range that was fitted."""
        return np.clip((x - self.mean) / self.scale, -FAR, FAR)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature on the last fifth.

    Without rows of both classes the score is the share of label 1 (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    z, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(y))
    cut = len(y) // 5
    tune, train = order[:cut], order[cut:]
    mean, scale = z[train].mean(0), z[train].std(0) + 1e-3
    base = np.clip(y[train].mean(), 0.001, 0.999)
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.log(base / (1 - base))]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z -= mean
    z /= scale
    np.clip(z, -FAR, FAR, out=z)
    for epoch in range(epochs):
        shuffled = rng.permutation(train)
        for k in range(0, len(shuffled), batch):
            rows = shuffled[k : k + batch]
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], d.sum()]
            step += 1
            now = rate * (1 - epoch / epochs)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *p)
    if len(tune):
        raw, t = net.logits(x[tune]), np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        q = np.clip(raw / t[:, None], -40, 40)
        net.temperature = float(t[np.argmin((np.logaddexp(0, q) - y[tune] * q).mean(1))])
    return net


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, train_only: bool = True) -> DataFrame:
    """(doc_id, text, label): at most ``bound`` labelled documents, those first in the order of a hash of doc_id.

    A doc_id labelled more than once counts with its smallest label. train_only: without
    the rows that are held out. The broadcast side has ``bound`` rows at most.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    if train_only:
        named = named.where(~held_out(F.col("doc_id")))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def held_out(doc_id):
    """Whether the row's labels are kept from training: the checksum of doc_id decides."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[Space, Network]:
    """(word vectors from all documents, network fitted to the training sample)."""
    chosen = labelled_sample(documents, labels, label, sample).select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), "label")
    vocabulary = sample_vocabulary(chosen)
    space = Space(vocabulary, word_vectors(context_sums(documents, vocabulary)))
    wide = "doc_id long, label int, x binary"
    schema = arrow_schema(wide)

    def make():
        def step(rows: pa.RecordBatch):
            x = pooled(rows.column("text"), space)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

        return step

    rows = arrow_map(chosen, make, wide, "text").toArrow()  # ``sample`` small rows
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "label", "x")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, FEATURES)
    net = fit(x, rows.column("label").to_numpy().astype(np.int64))
    del rows, x
    trim()  # the driver, too, lives on
    return space, net


def score(documents: DataFrame, space: Space, net: Network) -> DataFrame:
    """``documents`` with ``score`` (0 to 1); a null or empty text has a score too. Their column of that name is replaced."""
    keep = [c for c in documents.columns if c != "score"]
    schema_of = documents.select(*keep, F.lit(0.0).alias("score")).schema
    schema = arrow_schema(schema_of)

    def make():
        def step(rows: pa.RecordBatch):
            s = net.score(pooled(rows.column("text"), space))
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(s, pa.float64())], schema=schema)

        return step

    return arrow_map(documents.select(*keep), make, schema_of, "text")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Repeated rows are each scored, equal texts alike. A row without doc_id is scored and not
    held out. Texts without words, null included, have a score. A very long text is a slice
    of its own. Other columns are dropped; an empty table gives an empty table.
    """
    space, net = train(documents, labels)
    scored = score(documents.select("doc_id", "text"), space, net)
    return scored.select(F.col("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that score THRESHOLD at least, as they are, whatever repeats or has no doc_id.

    Texts without words are judged by the score that they have. An empty table gives an empty table.
    """
    space, net = train(documents, labels)
    schema = arrow_schema(documents.schema)

    def make():
        def step(rows: pa.RecordBatch):
            good = net.score(pooled(rows.column("text"), space)) >= THRESHOLD
            return pa.RecordBatch.from_arrays(rows.filter(pa.array(good)).columns, schema=schema)

        return step

    return arrow_map(documents, make, documents.schema, "text")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
