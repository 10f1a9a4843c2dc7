"""Divergence of sources within a language, from byte tries of terms with a counter for each source at the leaves.

1. Every task counts the terms of its documents by group (language and source) and puts them
   into a radix trie a language: edges are bytes, and a leaf holds a counter for each group
   and the number of documents. Tries that have LEAVES counters are written out in the order
   of their walk, a row a leaf, and the task begins others.
2. Rows are dealt by ranges of (language, term), so a task gets all tries' leaves below a
   range of prefixes; it merges their walks and drops the terms of too few documents.
3. Kept terms give each group's total and each language's number of terms.
4. A walk over the merged tries in the order of UTF-8 streams, for a chunk of terms at a
   time, the addends of every pair of sources and the candidates of every group, of which it
   keeps the best; equal ones come in the order of the walk.

Everything is integer arithmetic. The driver and each task know a row a group: a result has
a row for every two groups of a language, so these are few against the documents.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.shared import Scratch, arrow_schema, plain, slices, trim

LEAVES = 1 << 19  # counters of a task's tries, and a slice's more
CHUNK = 1 << 18  # cells, terms times sources, of which a walk computes at a time
SHORT = 64  # first bytes of terms that are compared with all terms at once
LONG = 1 << 20  # bytes of a text that are split into terms at a time
UNIT, LEAST, FIRST = 1_000_000_000, 3, 200  # of a share; documents of a kept term; ranks of terms

_TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")  # in UTF-8 what isn't ASCII has bytes from 0x80
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# -- tries ------------------------------------------------------------------------------


class Trie:
    """A radix trie over bytes; a node is [label, children by first byte or None, leaf number or -1]."""

    def __init__(self):
        self.root: list = [b"", None, -1]
        self.leaves = 0

    def leaf(self, term: bytes) -> int:
        """The number of ``term``'s leaf, which is made where it isn't there."""
        node, at, size = self.root, 0, len(term)
        while at < size:
            below = node[1].get(term[at]) if node[1] else None
            if below is None:
                below = [term[at:], None, -1]
                if node[1] is None:
                    node[1] = {}
                node[1][term[at]] = below
                at = size
            else:
                label = below[0]
                if term.startswith(label, at):
                    at += len(label)
                else:  # the edge parts where the two differ
                    n = 1
                    while n < len(label) and at + n < size and label[n] == term[at + n]:
                        n += 1
                    upper = [label[:n], {label[n]: below}, -1]
                    below[0] = label[n:]
                    node[1][term[at]] = below = upper
                    at += n
            node = below
        if node[2] < 0:
            node[2] = self.leaves
            self.leaves += 1
        return node[2]

    def grow(self, terms: list[bytes]) -> None:
        """Adds distinct ``terms`` in byte order to an empty trie, so that their leaves have the numbers 0, 1, ...

        Each term leaves the path of the one before where the two differ; nothing is looked
        up from the root.
        """
        path, ends, before = [self.root], [0], b""
        for number, (term, same) in enumerate(zip(terms, prefixes(terms), strict=True)):
            below = None
            while ends[-1] > same:
                below = path.pop()
                ends.pop()
            node, at = path[-1], ends[-1]
            if at < same:  # the edge parts where the two differ
                node[1][before[at]] = node = [before[at:same], {before[same]: below}, -1]
                below[0] = below[0][same - at :]
                path.append(node)
                ends.append(same)
            if same == len(term):  # the empty term
                node[2] = number
            else:
                if node[1] is None:
                    node[1] = {}
                node[1][term[same]] = leaf = [term[same:], None, number]
                path.append(leaf)
                ends.append(len(term))
            before = term
        self.leaves = len(terms)

    def walk(self) -> tuple[list[bytes], list[int]]:
        """Terms and numbers of all leaves in byte order."""
        terms, numbers, stack = [], [], [(b"", self.root)]
        while stack:
            before, (label, children, number) = stack.pop()
            term = before + label
            if number >= 0:
                terms.append(term)
                numbers.append(number)
            if children:
                stack += [(term, children[b]) for b in sorted(children, reverse=True)]
        return terms, numbers


def prefixes(terms: list[bytes]) -> list[int]:
    """How many bytes each term begins with that the one before it begins with as well."""
    if not terms:
        return []
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    data, start = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(size) - size
    same, at, n = np.zeros(len(terms), np.int64), np.arange(1, len(terms)), 0
    most = np.minimum(size[1:], size[:-1])
    while n < SHORT and len(at):
        at = at[most[at - 1] > n]
        at = at[data[start[at] + n] == data[start[at - 1] + n]]
        same[at] += 1
        n += 1
    for i in at.tolist():  # very long terms, from where they are still equal
        m = most[i - 1]
        differ = data[start[i] + n : start[i] + m] != data[start[i - 1] + n : start[i - 1] + m]
        same[i] = n + int(differ.argmax()) if differ.any() else m
    return same.tolist()


def pieces(text: bytes):
    """``text`` with A-Z lower-cased, in pieces of about LONG bytes that part no term."""
    text, at = text.translate(_LOWER), 0
    while len(text) - at > LONG:
        end = at + LONG
        while end < len(text) and (text[end] >= 0x80 or chr(text[end]).isalpha()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


_LEAF = "lang string, term binary, groups array<int>, counts array<long>, documents long"
_LEAF_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("documents", pa.int64())])


def _rows(lang: pa.Array, term: pa.Array, at: np.ndarray, groups: np.ndarray, counts: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    """_LEAF rows; counter j is that of row at[j] and group groups[j], and equal ones are added."""
    width = int(groups.max(initial=0)) + 1
    key = at * width + groups
    order = np.argsort(key, kind="stable")
    key, start = key[order], np.zeros(0, np.int64)
    if len(key):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, counts = key[start], np.add.reduceat(counts[order], start)
    offsets = np.append(0, np.cumsum(np.bincount(key // width, minlength=len(term)))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in ((key % width).astype(np.int32), counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays([lang, term, *lists, pa.array(documents.astype(np.int64))], schema=_LEAF_SCHEMA)


def counted(documents: DataFrame, groups: dict[tuple[str, str], int]) -> DataFrame:
    """_LEAF rows of every task's tries over (lang, source, text); a term comes again with each trie that has it."""

    def run(batches):
        found: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        holders: dict[str, Counter] = defaultdict(Counter)

        def walked_trie(lang: str):
            """A trie of the language's terms, its counters by leaf, and its walk as rows."""
            trie, held = Trie(), holders[lang]
            trie.grow(sorted(held))
            terms, leaves = trie.walk()
            number = dict(zip(terms, leaves, strict=True))
            at, gs, ns = [], [], []
            for source, counts in found[lang].items():
                at.append(np.fromiter(map(number.__getitem__, counts), np.int64, len(counts)))
                ns.append(np.fromiter(counts.values(), np.int64, len(counts)))
                gs.append(np.full(len(counts), groups[lang, source], np.int64))
            seen = np.fromiter(map(held.__getitem__, terms), np.int64, len(terms))
            return _rows(pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()), np.concatenate(at), np.concatenate(gs), np.concatenate(ns), seen)

        def flush():
            for lang in list(holders):
                if holders[lang]:
                    rows = walked_trie(lang)
                    yield from (rows.slice(i, 8192) for i in range(0, rows.num_rows, 8192))
                del holders[lang], found[lang]

        gc.disable()  # tries have many nodes and no cycles
        try:
            for batch in batches:
                for rows in slices(batch, "text"):
                    for lang, source, text in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), plain(rows.column("text")).cast(pa.large_binary()).to_pylist(), strict=True):
                        counts, seen = found[lang][source], set()
                        for piece in pieces(text):
                            terms = _TERM.findall(piece)
                            counts.update(terms)
                            seen.update(terms)
                        holders[lang].update(seen)
                    if sum(len(c) for of in found.values() for c in of.values()) >= LEAVES:
                        yield from flush()
            yield from flush()
        finally:
            gc.enable()
            trim()

    return documents.mapInArrow(run, _LEAF)


def merged(leaves: DataFrame, least: int) -> DataFrame:
    """_LEAF rows with one row a term, of those in ``least`` documents.

    Each task merges what all tries have below a range of prefixes, as their walks interleave:
    equal leaves add their counters. It holds a batch and the newest leaf.
    """

    def run(batches):
        newest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.cast(f.type) for c, f in zip(batch.columns, _LEAF_SCHEMA, strict=True)]
            if newest is not None:
                own = [pa.concat_arrays([a, b]) for a, b in zip(newest.columns, own, strict=True)]
            lang, term, groups, counts, documents = own
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.append(True, ~same))
            row = np.repeat(np.append(0, np.cumsum(~same)), pc.list_value_length(groups).to_numpy(zero_copy_only=False))
            first = pa.array(start)
            rows = _rows(lang.take(first), term.take(first), row, groups.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), np.add.reduceat(documents.to_numpy(), start))
            # What follows can only add to the newest leaf.
            newest, rows = rows.slice(rows.num_rows - 1), rows.slice(0, rows.num_rows - 1)
            yield rows.filter(pc.greater_equal(rows.column("documents"), least))
        if newest is not None:
            yield newest.filter(pc.greater_equal(newest.column("documents"), least))
        trim()

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, _LEAF)


# -- exact shares -----------------------------------------------------------------------


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + 1) / whole); in three steps of a thousand, so that nothing overflows below 2**63 / 1000."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, whole.shape), np.int64)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


_FOUND = "lang string, part string, g int, other int, term binary, value long"


def walked(terms: DataFrame, langs: dict[str, tuple[list[int], list[int], int]], ranks: int) -> DataFrame:
    """_FOUND of each task: sums of every two sources' addends, and the ``ranks`` best terms of every group.

    langs: each language's groups, their totals and its number of terms.
    """
    schema = arrow_schema(_FOUND)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        best: dict[int, list[tuple[int, bytes]]] = {}

        def chunk(lang: str, rows: pa.RecordBatch) -> None:
            groups, totals, terms_of = langs[lang]
            place = {g: i for i, g in enumerate(groups)}
            counts = np.zeros((rows.num_rows, len(groups)), np.int64)
            lists = rows.column("groups")
            at = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            counts[at, [place[g] for g in lists.flatten().to_pylist()]] = rows.column("counts").flatten().to_numpy()
            p = shares(counts, np.array(totals) + terms_of)
            q = shares(counts.sum(1), np.array(sum(totals) + terms_of))[:, None]
            own = sums.setdefault(lang, np.zeros((len(groups), len(groups)), np.int64))
            for i in range(len(groups)):
                own[i] += gaps(p[:, i : i + 1], p).sum(0)
            value = gaps(p, q)
            names = rows.column("term")
            for i, g in enumerate(groups):
                have = best.setdefault(g, [])
                mine = (counts[:, i] > 0) & (p[:, i : i + 1] > q)[:, 0]
                if len(have) == ranks:
                    mine &= value[:, i] >= -have[-1][0]
                if mine.any():
                    new = np.flatnonzero(mine)
                    have += zip((-value[new, i]).tolist(), names.take(pa.array(new)).to_pylist(), strict=True)
                    have.sort()
                    del have[ranks:]

        for batch in batches:
            names, start = batch.column("lang").to_pylist(), 0
            while start < len(names):
                end, most = start + 1, max(1, CHUNK // len(langs[names[start]][0]))
                while end < len(names) and end - start < most and names[end] == names[start]:
                    end += 1
                chunk(names[start], batch.slice(start, end - start))
                start = end
        for lang, own in sums.items():
            groups = langs[lang][0]
            for i, g in enumerate(groups):  # a row of the matrix at a time
                n = len(groups)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(["pair"] * n), pa.array([g] * n, pa.int32()), pa.array(groups, pa.int32()), pa.nulls(n, pa.binary()), pa.array(own[i])], schema=schema)
            for g in groups:
                if n := len(best[g]):
                    values, names = zip(*best[g], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(["term"] * n), pa.array([g] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(names, pa.binary()), pa.array([-v for v in values], pa.int64())], schema=schema)
        trim()

    return terms.mapInArrow(run, _FOUND)


# -- the operator -----------------------------------------------------------------------


def audit(documents: DataFrame, least: int = LEAST, ranks: int = FIRST) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language parts from the others, and by which terms.

    Part ``pair`` has a row for each other source of the language, 0 where no term is kept;
    part ``term`` the ``ranks`` terms that a source has more of than its language has, most
    telling first, equal ones in the order of UTF-8. Null texts, languages and sources count
    as empty, and a text without letters has no terms; its group still has pairs. Repeated
    rows each count. A very long text is split piece by piece, and only its distinct terms
    are held. An empty table gives an empty table; other columns are dropped.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(said("lang"), said("source"), said("text"))
    found = sorted((r["lang"], r["source"]) for r in docs.select("lang", "source").distinct().collect())  # a row a group
    number = {g: i for i, g in enumerate(found)}
    if not number:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    leaves = scratch.save(counted(docs, number), "leaves")
    terms = scratch.save(merged(leaves, least), "terms")
    scratch.drop("leaves")
    total = {r["g"]: r["n"] for r in terms.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy(F.col("x.groups").alias("g")).agg(F.sum("x.counts").alias("n")).collect()}  # a row a group
    size = {r["lang"]: r["n"] for r in terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs: dict[str, tuple[list[int], list[int], int]] = {}
    for (lang, _), g in number.items():
        groups, totals, _ = langs.setdefault(lang, ([], [], size.get(lang, 0)))
        groups.append(g)
        totals.append(total.get(g, 0))

    names = spark.createDataFrame([(g, lang, source) for (lang, source), g in number.items()], "g int, lang string, source string")
    parts = walked(terms, langs, ranks).groupBy("part", "g", "other", "term").agg(F.sum("value").alias("value"))
    parts = scratch.save(parts, "parts")
    one, two = names.select("lang", "g", "source"), names.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = one.join(two, "lang").where("g <> other").join(parts.where("part = 'pair'").select("g", "other", "value"), ["g", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = parts.where("part = 'term'").select("g", "value", F.col("term").cast("string").alias("item")).join(names, "g")
    both = pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= ranks))


def query(spark, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and its 200 most telling terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT c.* FROM c JOIN k USING (lang, term)),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS t FROM g LEFT JOIN kc USING (lang, source) GROUP BY ALL),
p AS (SELECT k.lang, g.source, k.term, coalesce(n, 0) AS n, CAST(1 + (1000000000 * (coalesce(n, 0) + 1)) // (t + v) AS BIGINT) AS p
  FROM k JOIN g USING (lang) JOIN t ON t.lang = g.lang AND t.source = g.source JOIN v ON v.lang = k.lang LEFT JOIN kc ON kc.lang = k.lang AND kc.source = g.source AND kc.term = k.term),
q AS (SELECT x.lang, x.term, CAST(1 + (1000000000 * (x.n + 1)) // (y.t + v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL) x JOIN (SELECT lang, sum(t) AS t FROM t GROUP BY lang) y USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
