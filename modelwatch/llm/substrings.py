"""Substring dedup: word windows that an earlier document has too are merged into intervals and removed.

Every window of ``size`` consecutive words has a Rabin-Karp hash. Windows are grouped
by an anchor, the least hash of the shorter word runs inside them, which depends on
the window's words alone: equal windows meet under one anchor, and neighbouring
windows mostly share it, so they travel as one row of packed hashes. Spark counts the
windows of every anchor first; an anchor with more than GROUP of them, such as a
phrase that a third of the corpus has amid other words, is dealt by window instead.
Each task keeps, of the windows that repeat in its batch, only the first of the
smallest doc_id, so a window that fills the corpus reaches its group once a batch; the
group then keeps the least one seen so far and lets go of the others as they come.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import arrow_map, arrow_schema, plain, trim
from modelwatch.llm.words import BASE, BASE_INVERSE, Words, mix, powers, words

SIZE = 50
GROUP = 1 << 18  # windows of an anchor that are judged together at most
LISTED = 1 << 16  # crowded anchors that every task is told of; with more of them rows meet these in a join
_RUNS = 32  # word runs of an anchor in a window
_BATCH = 4 << 20
_PACKED = 1 << 20  # hashes in a record batch


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` words in a row, across texts; from prefix sums modulo 2**64."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * powers(BASE, len(word_hashes)), out=prefix[1:], dtype=np.uint64)
    return mix((prefix[size:] - prefix[:n]) * powers(BASE_INVERSE, n))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def valid_starts(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window that lies in one text."""
    n = np.maximum(found.counts() - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + found.first[:-1][owner]


def runs(owner: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [a, b) of maximal runs of consecutive starts of one owner that agree in ``same``; (owner, start) must be sorted."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.append(first[1:], len(owner))


#: Windows of a text (doc_id and a hash of the text) from word ``begin`` on, their hashes
#: packed; or, without hashes, windows that begin in [begin, until) and are to go.
_ROW = "anchor long, doc_id long, own long, begin int, until int, hashes binary"
_GONE = "doc_id long, own long, begin int, until int"


def _anchors(found: Words, hashed: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    width = min(_RUNS, size)
    return sliding_least(window_hashes(hashed, size - width + 1), width)[start]


def _identified(documents: DataFrame) -> DataFrame:
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("own", F.xxhash64("text"))


def anchor_counts(documents: DataFrame, size: int) -> DataFrame:
    """(anchor, n): how many windows of all documents each anchor has."""
    schema = arrow_schema("anchor long, n long")

    def make():
        def step(rows: pa.RecordBatch):
            found = words(rows.column("text"))
            owner, start = valid_starts(found, size)
            if not len(owner):
                return None
            anchor = _anchors(found, found.hashes(), start, size)
            a, b = runs(owner, start, anchor)
            return pa.RecordBatch.from_arrays([pa.array(anchor[a].view(np.int64)), pa.array(b - a)], schema=schema)

        return step

    return arrow_map(_identified(documents).select("text"), make, "anchor long, n long", "text", _BATCH).groupBy("anchor").agg(F.sum("n").alias("n"))


def _packed(anchor, doc, own, begin, value, first, ends, schema: pa.Schema) -> list[pa.RecordBatch]:
    """Record batches of rows with the hashes value[first[i]:ends[i]]; no batch has much more than _PACKED of these."""
    out, k = [], 0
    while k < len(first):
        lo = int(first[k])
        end = max(k + 1, int(np.searchsorted(ends, lo + _PACKED, "right")))
        hi = int(ends[end - 1])
        at = first[k:end]
        hashes = pa.Array.from_buffers(pa.binary(), end - k, [None, pa.py_buffer((np.append(at, hi) - lo).astype(np.int32) * np.int32(8)), pa.py_buffer(np.ascontiguousarray(value[lo:hi]))])
        cells = [anchor[at].view(np.int64), doc[at], own[at], begin[at].astype(np.int32), (begin[at] + ends[k:end] - at).astype(np.int32)]
        out.append(pa.RecordBatch.from_arrays([*map(pa.array, cells), hashes], schema=schema))
        k = end
    return out


def _anchored(documents: DataFrame, size: int, crowded: np.ndarray) -> DataFrame:
    """Rows of _ROW: windows by anchor, those of ``crowded`` anchors by window, and what is already decided within a batch."""
    schema = arrow_schema(_ROW)

    def make():
        def step(rows: pa.RecordBatch):
            found = words(rows.column("text"))
            owner, start = valid_starts(found, size)
            if not len(owner):
                return None
            doc, own = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "own"))
            hashed = found.hashes()
            value, anchor = window_hashes(hashed, size)[start], _anchors(found, hashed, start, size)
            del hashed
            # Of equal windows in this batch the first of the smallest doc_id travels on; those of others go, whatever other batches have.
            of = doc[owner]
            order = np.argsort(value, kind="stable")
            same = value[order]
            head = np.concatenate([[0], np.flatnonzero(same[1:] != same[:-1]) + 1])
            size_of = np.diff(np.append(head, len(of)))
            least = np.repeat(np.minimum.reduceat(of[order], head), size_of)
            group = np.repeat(np.arange(len(head)), size_of)
            mine = np.flatnonzero(of[order] == least)
            travels = mine[np.concatenate([[True], group[mine][1:] != group[mine][:-1]])]
            # A row of the same doc_id but another text has windows of its own.
            keep = np.zeros(len(of), bool)
            keep[order[travels]] = True
            twin = mine[own[owner[order[mine]]] != np.repeat(own[owner[order[travels]]], np.diff(np.append(np.searchsorted(mine, travels), len(mine))))]
            keep[order[twin]] = True
            gone = np.zeros(len(of), bool)
            gone[order] = of[order] > least
            del order, same, least, group, mine, twin
            base = start - found.first[:-1][owner]
            g_owner, g_base = owner[gone], base[gone]
            a, b = runs(g_owner, g_base)
            keep = np.flatnonzero(keep)
            owner, base, value, anchor = owner[keep], base[keep], value[keep], anchor[keep]
            if len(crowded):
                at = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                anchor = np.where(crowded[at] == anchor, mix(anchor ^ value), anchor)
            out = _packed(anchor, doc[owner], own[owner], base, value, *runs(owner, base, anchor), schema)
            if len(a):
                cells = [doc[g_owner[a]], doc[g_owner[a]], own[g_owner[a]], g_base[a].astype(np.int32), (g_base[b - 1] + 1).astype(np.int32)]
                out.append(pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array([b""] * len(a), pa.binary())], schema=schema))
            return out

        return step

    return arrow_map(_identified(documents), make, _ROW, "text", _BATCH)


def _unpacked(rows: DataFrame) -> DataFrame:
    """_ROW of rows with ``crowded``: where it is set each window is a row of its own, keyed by the window."""
    schema = arrow_schema(_ROW)

    def run(batches):
        for batch in batches:
            hot = batch.column("crowded").is_valid()
            hot = pa.compute.and_(hot, pa.compute.greater(pa.compute.binary_length(batch.column("hashes")), 0))
            rest = batch.filter(pa.compute.invert(hot)).select(schema.names)
            if rest.num_rows:
                yield rest
            wide = batch.filter(hot)
            if wide.num_rows:
                value = np.frombuffer(b"".join(wide.column("hashes").to_pylist()), np.uint64)
                n = pa.compute.binary_length(wide.column("hashes")).to_numpy() // 8
                row = np.repeat(np.arange(len(n)), n)
                anchor, doc, own, begin = (wide.column(c).to_numpy()[row] for c in ("anchor", "doc_id", "own", "begin"))
                at = np.arange(len(row))
                yield from _packed(mix(anchor.view(np.uint64) ^ value), doc, own, begin + at - np.repeat(np.cumsum(n) - n, n), value, at, at + 1, schema)

    return rows.mapInArrow(run, _ROW)


def keyed_windows(documents: DataFrame, size: int) -> DataFrame:
    """_ROW of all documents; no key but that of a single window has more than GROUP windows."""
    crowded = anchor_counts(documents, size).where(F.col("n") > GROUP).select("anchor")
    found = crowded.limit(LISTED + 1).collect()
    if len(found) <= LISTED:
        return _anchored(documents, size, np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64)))
    rows = _anchored(documents, size, np.zeros(0, np.uint64))
    return _unpacked(rows.join(crowded.withColumn("crowded", F.lit(True)), "anchor", "left"))


def _decided(by_anchor: DataFrame) -> DataFrame:
    """_GONE from rows sorted by anchor in their partitions."""
    schema, packed = arrow_schema(_GONE), arrow_schema(_ROW)

    def judge(rows: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """What goes, and rows with the least windows, against which later ones of the same anchor are judged."""
        table = pa.Table.from_batches(rows).combine_chunks()
        anchor, doc, own, begin, until = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "own", "begin", "until"))
        hashes = plain(table.column("hashes"))
        _, offsets, data = hashes.buffers()
        offsets = np.frombuffer(offsets, np.int64)[hashes.offset : hashes.offset + len(hashes) + 1] // 8
        value = np.frombuffer(data, np.uint64)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint64)
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        at = begin[row].astype(np.int64) + np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n)
        order = np.lexsort((doc[row], value, anchor[row]))
        value, row, at = value[order], row[order], at[order]
        of, group = doc[row], anchor[row]
        head = np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (group[1:] != group[:-1])) + 1])[: len(of)]
        gone = of > np.repeat(of[head], np.diff(np.append(head, len(of))))
        rest = np.flatnonzero(~gone)
        g_row, g_at = row[gone], at[gone]
        order = np.lexsort((g_at, own[g_row], doc[g_row]))
        g_row, g_at = g_row[order], g_at[order]
        a, b = runs(doc[g_row], g_at, own[g_row])
        told = n == 0  # decided within their batch
        cells = [np.append(x, y[told]) for x, y in ((doc[g_row[a]], doc), (own[g_row[a]], own), (g_at[a].astype(np.int32), begin), ((g_at[b - 1] + 1).astype(np.int32), until))]
        out = pa.RecordBatch.from_arrays([*map(pa.array, cells)], schema=schema) if len(cells[0]) else None
        k = np.arange(len(rest))
        return out, _packed(group[rest].view(np.uint64), of[rest], own[row[rest]], at[rest], value[rest], k, k + 1, packed)

    def run(batches):
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            # The last anchor may go on in the next batch; all before it are whole.
            split = int(np.searchsorted(anchor, anchor[-1]))
            if split or (held and held[-1].column("anchor")[0].as_py() != anchor[0]):
                out, _ = judge([*held, batch.slice(0, split)])
                if out is not None:
                    yield out
                held, weight = [], 0
            held.append(batch.slice(split))
            weight += (pa.compute.sum(pa.compute.binary_length(held[-1].column("hashes"))).as_py() or 0) // 8
            if weight > 2 * GROUP:
                out, held = judge(held)
                weight = sum(b.num_rows for b in held)
                if out is not None:
                    yield out
        if held and (out := judge(held)[0]) is not None:
            yield out
        trim()

    return by_anchor.mapInArrow(run, _GONE)


def repeated_windows(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, own, spans): starts of a document's windows that also begin in a document with a smaller doc_id.

    ``own`` is xxhash64 of the text, so that rows that share a doc_id keep apart. spans
    are sorted runs [begin, until) of starts; of a window that a text has several times at
    least one start is named. Documents without any have no row. The spans of one text are
    fewer than its words.
    """
    decided = _decided(keyed_windows(documents, size).repartition("anchor").sortWithinPartitions("anchor"))
    return decided.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set(F.struct("begin", "until"))).alias("spans"))


def covered(found: Words, spans: list, size: int) -> np.ndarray:
    """Flags of the words in the windows that ``spans`` name for each text, and in windows equal to these."""
    edge = np.zeros(len(found.starts) + 1, np.int64)
    for i, runs_of in enumerate(spans):
        for s in runs_of or ():
            edge[found.first[i] + s["begin"]] += 1
            edge[found.first[i] + s["until"]] -= 1
    named = np.cumsum(edge[:-1]) > 0
    if not named.any():
        return named
    owner, start = valid_starts(found, size)
    key = mix(window_hashes(found.hashes(), size)[start] ^ mix(owner.astype(np.uint64)))
    hit = start[np.isin(key, key[named[start]])]
    named[:] = False
    named[hit] = True
    counts = np.cumsum(named)
    counts[size:] -= counts[:-size].copy()
    return counts > 0


def remove_repeats(documents: DataFrame, size: int = SIZE, digests: bool = False) -> DataFrame:
    """Documents without the words in ``repeated_windows``.

    Returns the columns of ``documents`` (n_chars follows the new text if there is one);
    columns of other names pass through. A text that loses words becomes its kept words
    joined by one space, the empty text if none are left; others stay as they are, null
    included. digests: (doc_id, n_words, n_removed, kept_sha256) instead.

    Null, empty and short texts (fewer words than ``size``) lose nothing and take nothing.
    Rows that share a doc_id are one another's equals: neither removes words of the other,
    and each is judged by its own text. A null doc_id takes no part: such rows stay. A very
    long text is a slice of its own; memory follows the longest text. An empty table gives
    an empty table.
    """
    spans = repeated_windows(documents, size)
    joined = documents.select("doc_id", "text") if digests else documents
    own, key = "_spans", "_own"
    while {own, key} & set(joined.columns):
        own, key = own + "_", key + "_"
    spans = spans.select(F.col("doc_id").alias("_doc" + own), F.col("own").alias("_of" + own), F.col("spans").alias(own))
    joined = joined.join(spans, (F.col("doc_id").cast("long") == F.col("_doc" + own)) & (F.xxhash64(F.col("text").cast("string")) == F.col("_of" + own)), "left").drop("_doc" + own, "_of" + own)
    if digests:
        wide = "doc_id long, n_words long, n_removed long, kept_sha256 string"
        joined = joined.withColumn("doc_id", F.col("doc_id").cast("long"))
    else:
        wide = documents.schema
    schema = arrow_schema(wide)

    def make():
        def step(rows: pa.RecordBatch):
            found = words(rows.column("text"))
            spans = rows.column(own).to_pylist()
            gone = covered(found, spans, size)
            stay = np.flatnonzero(~gone)
            first = np.searchsorted(stay, found.first)
            lost = found.counts() - np.diff(first)
            raw = found.data.tobytes()
            starts, ends = found.starts[stay].tolist(), found.ends[stay].tolist()

            def kept(i: int) -> bytes:
                return b" ".join([raw[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)])

            if digests:
                cells = [pa.array(found.counts()), pa.array(lost), pa.array([hashlib.sha256(kept(i)).hexdigest() for i in range(rows.num_rows)], pa.string())]
                return pa.RecordBatch.from_arrays([rows.column("doc_id"), *cells], schema=schema)
            texts = rows.column("text").to_pylist()
            for i in np.flatnonzero(lost).tolist():
                texts[i] = kept(i).decode()
            cells = {f.name: rows.column(f.name) for f in schema} | {"text": pa.array(texts, schema.field("text").type)}
            if "n_chars" in cells:
                sizes = pa.array([len(t) if t is not None else None for t in texts], schema.field("n_chars").type)
                cells["n_chars"] = pa.compute.if_else(pa.array(lost > 0), sizes, rows.column("n_chars"))
            return pa.RecordBatch.from_arrays([cells[f.name] for f in schema], schema=schema)

        return step

    return arrow_map(joined.select(*[c for c in joined.columns if c in schema.names or c in ("text", own)]), make, wide, "text")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's word counts and the digest of what is kept."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
