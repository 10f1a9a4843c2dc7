"""Quality rules: base counts, then a conditional random field that labels each line content or boilerplate.

The field is a linear chain over a text's lines with two labels. It is fitted by
maximum likelihood to a bounded sample of documents with quality labels: lines of good
documents are content; lines of bad ones start as boilerplate and are decoded anew
between rounds, as bad documents have good lines too. Viterbi decoding then labels
every line of every text, and the share of words in content lines decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.quality import labelled_sample
from modelwatch.llm.shared import arrow_map, arrow_schema, checkpointed, trim
from modelwatch.llm.substrings import valid_starts, window_hashes
from modelwatch.llm.words import Words, mix, words

SAMPLE = 3000  # labelled documents that the field is fitted to at most
SAMPLE_LINES = 1 << 18  # lines of all of these at most; a document is in the sample with every line or not at all
CHAIN = 64  # consecutive lines of a document that are fitted as one chain; longer documents are several
LEAST_WORDS, MOST_REPEATED, LEAST_CONTENT = 50, 50, 50  # words; percent of words; percent of words
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".!?:;")] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?|#*$%&<>{}=_~^@/\\")] = True
FEATURES = 10


@dataclass
class Measured:
    """Base counts of each text, and of each line the owner, its words and its features."""

    found: Words
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_owner: np.ndarray
    line_first: np.ndarray  # lines [line_first[i], line_first[i + 1]) are those of text i
    line_words: np.ndarray
    x: np.ndarray


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags lie in [bounds[i], bounds[i + 1])."""
    at = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(at[bounds])


def repeated_words(found: Words, hashed: np.ndarray, width: int = 3) -> np.ndarray:
    """Flags of the words in windows of ``width`` words that their text has twice or more."""
    owner, start = valid_starts(found, width)
    covered = np.zeros(len(hashed) + 1, np.int64)
    if len(owner):
        key = mix(window_hashes(hashed, width)[start] ^ mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = start[twice]  # all different
        covered[hit] += 1
        covered[hit + width] -= 1
    return np.cumsum(covered[:-1]) > 0


def measure(column: pa.Array) -> Measured:
    """Counts and line features of whole texts; null counts as empty. A text of n newlines has n + 1 lines."""
    found = words(column)
    data, offsets = found.data, found.offsets
    n = len(offsets) - 1
    hashed = found.hashes()
    head = (data & 0xC0) != 0x80  # first bytes of code points
    inside = np.concatenate([[0], np.cumsum(head)])
    word_at = np.concatenate([[0], np.cumsum(inside[found.ends] - inside[found.starts])])
    symbol = _SYMBOL[data]
    again = repeated_words(found, hashed)
    breaks = np.flatnonzero(data == 10)
    in_text = np.searchsorted(breaks, offsets)
    # Lines begin at each text's start and after each newline of it.
    counts = np.diff(in_text) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    later = np.ones(len(starts), bool)
    later[first[:-1]] = False
    starts[later] = breaks + 1
    ends = np.empty(len(starts), np.int64)
    ends[first[1:] - 1] = offsets[1:]
    earlier = np.ones(len(starts), bool)
    earlier[first[1:] - 1] = False
    ends[earlier] = breaks
    owner = np.repeat(np.arange(n), counts)
    w_lo, w_hi = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
    line_words = w_hi - w_lo
    lines = np.flatnonzero(line_words)
    key = mix(Words(data, offsets, starts[lines], ends[lines], first).hashes() ^ mix(owner[lines].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    doubled = np.zeros(len(starts), bool)
    doubled[lines[order[1:][key[order][1:] == key[order][:-1]]]] = True  # a stable sort keeps the first one first
    share = lambda flags, lo, hi, whole: (np.concatenate([[0], np.cumsum(flags)])[hi] - np.concatenate([[0], np.cumsum(flags)])[lo]) / np.maximum(whole, 1)
    size = ends - starts
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letters = letters[ends] - letters[starts]
    last = data[found.ends - 1] if len(found.ends) else np.zeros(0, np.uint8)
    loud_end = _LOUD[last]
    closing = np.zeros(len(starts), bool)
    closing[lines] = _POINT[last[w_hi[lines] - 1]]
    repeat_next = np.zeros(len(hashed), bool)
    repeat_next[1:] = hashed[1:] == hashed[:-1]
    x = np.stack([
        np.ones(len(starts)),
        np.log1p(line_words) / 3,
        share(symbol, starts, ends, size) * 4,
        share(_UPPER[data], starts, ends, letters),
        share(loud_end, w_lo, w_hi, line_words),
        share(again, w_lo, w_hi, line_words),
        share(repeat_next, w_lo, w_hi, line_words),
        closing,
        doubled,
        np.minimum(size / np.maximum(line_words, 1), 40) / 10,
    ], 1).astype(np.float32)
    return Measured(found, np.diff(word_at[found.first]), _per(symbol, offsets), np.bincount(owner[doubled], minlength=n), _per(again, found.first), owner, first, line_words, x)


@dataclass
class Field:
    """A linear chain with labels 0 (boilerplate) and 1 (content)."""

    weights: np.ndarray  # [2, FEATURES]
    transition: np.ndarray  # [2, 2]: from, to

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi: the best label of each line; ties go to content. All texts take a step at once."""
        unary = x.astype(np.float64) @ self.weights.T
        counts = np.diff(first)
        label = np.ones(len(x), np.int8)
        back = np.zeros((len(x), 2), np.int8)
        order = np.argsort(-counts, kind="stable")
        start, ranked = first[:-1][order], -counts[order]
        live = int(np.searchsorted(ranked, 0))  # texts with a line at least
        best = unary[start[:live]]
        ends = np.empty((live, 2))
        for t in range(int(counts.max(initial=0))):
            live = int(np.searchsorted(ranked, -t))  # texts with a line t
            rows = start[:live] + t
            if t:
                options = best[:live, :, None] + self.transition
                to = (options[:, 1] >= options[:, 0]).astype(np.int8)
                back[rows] = to
                best = np.take_along_axis(options, to[:, None, :].astype(np.int64), 1)[:, 0] + unary[rows]
            ends[:live] = best[:live]
        now = (ends[:, 1] >= ends[:, 0]).astype(np.int8)
        for t in range(int(counts.max(initial=0)) - 1, -1, -1):
            live = int(np.searchsorted(ranked, -t))
            rows = start[:live] + t
            label[rows] = now[:live]
            now[:live] = back[rows, now[:live].astype(np.int64)]
        return label


def fit_field(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward and backward passes with Adam.

    Lines are laid out step by step, texts by descending length, so that the lines of a
    step are a run of rows and texts that have ended cost nothing.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    live = [int((counts > t).sum()) for t in range(int(counts.max(initial=0)))]
    at = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
    rows = np.concatenate([first[:-1][order[:n]] + t for t, n in enumerate(live)])
    x, y = x[rows].astype(np.float64), y[rows]
    # Lines after the first step, and the line before each of them.
    later = np.arange(at[1], len(x))
    prior = np.concatenate([np.arange(at[t], at[t] + n) for t, n in enumerate(live[1:])] or [np.zeros(0, np.int64)])
    target, pair = np.eye(2)[y], np.zeros((2, 2))
    np.add.at(pair, (y[prior], y[later]), 1)
    p = [np.zeros((2, x.shape[1])), np.zeros((2, 2))]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        unary = x @ p[0].T
        ahead, behind = unary.copy(), np.zeros_like(unary)
        for t, n in enumerate(live[1:], 1):
            past = ahead[at[t - 1] : at[t - 1] + n]
            ahead[at[t] : at[t] + n] += np.logaddexp(past[:, :1] + p[1][0], past[:, 1:] + p[1][1])
        for t in range(len(live) - 1, 0, -1):
            n = live[t]
            next_ = unary[at[t] : at[t] + n] + behind[at[t] : at[t] + n]
            behind[at[t - 1] : at[t - 1] + n] = np.logaddexp(next_[:, :1] + p[1][:, 0], next_[:, 1:] + p[1][:, 1])
        both = ahead + behind
        whole = np.logaddexp(both[:, 0], both[:, 1])
        joint = ahead[prior][:, :, None] + p[1] + (unary[later] + behind[later])[:, None, :] - whole[later][:, None, None]
        grads = [(np.exp(both - whole[:, None]) - target).T @ x / max(1, len(x)) + decay * p[0], (np.exp(joint).sum(0) - pair) / max(1, len(x)) + decay * p[1]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*p)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 3) -> Field:
    """A field fitted to all lines of at most ``sample`` labelled documents.

    In the order of a hash of doc_id a document is taken if its lines still fit into SAMPLE_LINES.

    Without documents of both labels every line is content. A doc_id that repeats counts with
    each of its rows; null texts have one empty line.
    """
    wide = "doc_id long, label int, n long, x binary"
    schema = arrow_schema(wide)

    def make():
        def step(rows: pa.RecordBatch):
            got = measure(rows.column("text"))
            x = [got.x[a:b].tobytes() for a, b in zip(got.line_first, got.line_first[1:], strict=False)]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(np.diff(got.line_first), pa.int64()), pa.array(x, pa.binary())], schema=schema)

        return step

    chosen = labelled_sample(documents, labels, "quality", sample).select(F.col("doc_id").cast("long"), "text", "label")
    measured = checkpointed(arrow_map(chosen, make, wide, "text"))
    taken, total = [], 0
    sizes = measured.groupBy("doc_id").agg(F.sum("n").alias("n")).select(F.xxhash64("doc_id"), "doc_id", "n").collect()  # ``sample`` rows at most
    for _, doc, n in sorted(tuple(r) for r in sizes):
        if total + n <= SAMPLE_LINES:
            taken.append(doc)
            total += n
    if len(taken) < len(sizes):
        measured = measured.where(F.col("doc_id").isin(taken))
    rows = measured.toArrow().sort_by([(c, "ascending") for c in ("doc_id", "label", "x")])  # SAMPLE_LINES lines at most
    good = rows.column("label").to_numpy().astype(np.int64)
    if not len(good) or good.min() == good.max():
        return Field(np.zeros((2, FEATURES)), np.zeros((2, 2)))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    n = rows.column("n").to_pylist()
    del rows
    first = np.concatenate([[0], np.cumsum([min(CHAIN, k - at) for k in n for at in range(0, k, CHAIN)])])
    of = np.repeat(good, n)
    y = of.copy()
    for k in range(rounds):
        field = fit_field(x, y, first)
        if k + 1 < rounds:
            y = np.where(of == 1, 1, field.decode(x, first))
    del x
    trim()  # the driver, too, lives on
    return field


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"


def judge(documents: DataFrame, field: Field) -> DataFrame:
    """RESULT of every row: counts over the whole text, whether the base rules fail, and the verdict.

    kept: the base rules hold and half of the words at least are in content lines; of
    labels that score alike content wins. Null, empty and short texts fail the base rules.
    Repeated rows, and rows without doc_id, are each judged by their own text. A very long
    text is a slice of its own; memory follows the longest one. Other columns are dropped; an
    empty table gives an empty table.
    """
    schema = arrow_schema(RESULT)

    def make():
        def step(rows: pa.RecordBatch):
            got = measure(rows.column("text"))
            n = got.found.counts()
            label = field.decode(got.x, got.line_first)
            content = np.bincount(got.line_owner, np.where(label == 1, got.line_words, 0), len(n)).astype(np.int64)
            failed = (n < LEAST_WORDS) | (100 * got.n_repeat_words > MOST_REPEATED * n)
            kept = ~failed & (100 * content >= LEAST_CONTENT * n)
            cells = [n, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, failed, kept, content]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cells, list(schema)[1:], strict=True))], schema=schema)

        return step

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), make, RESULT, "text")


def keep_content(documents: DataFrame, field: Field) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, as they are, with all their columns, whatever repeats or has no doc_id."""
    schema = arrow_schema(documents.schema)

    def make():
        def step(rows: pa.RecordBatch):
            got = measure(rows.column("text"))
            n = got.found.counts()
            content = np.bincount(got.line_owner, np.where(field.decode(got.x, got.line_first) == 1, got.line_words, 0), len(n))
            kept = (n >= LEAST_WORDS) & (100 * got.n_repeat_words <= MOST_REPEATED * n) & (100 * content >= LEAST_CONTENT * n)
            return pa.RecordBatch.from_arrays(rows.filter(pa.array(kept)).columns, schema=schema)

        return step

    return arrow_map(documents, make, documents.schema, "text")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
