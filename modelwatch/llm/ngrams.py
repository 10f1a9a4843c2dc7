"""N-gram Jaccard join by a token-group matrix, and the components of its links.

1. Rows get numbers and their first shingles in a common order, that of rising frequency,
   and rows with equal shingle sets collapse to one representative.
2. A representative has a row for each of its first shingles: a link's two sets share one of
   these. Shingles that one set alone has first fall away.
3. Similar documents find a common group by stars: each holder of a shingle names the holder
   whose own rarest shingle is the most frequent (a document without edits of its own),
   each document has the one named most often verified on full sets, and so grow
   components; one more round names others. Where the first shingles that two sets share are
   too few for any link, no text is read.
4. Components are partitioned into groups of at most BLOCK documents of about the same size.
   The matrix's rows are the first shingles of each group: a document asks only groups of
   other components that have one of its own first shingles and a fitting size.
5. Each such group's union of shingles is stored. A document that shares too little with
   the union for any member of that size is done with the group; the others have it opened,
   and its members compared on full sets until one links.
6. Components over all links; each is named by the smallest doc_id in it.

A document is compared with groups and not with their members, and never with its own
component's, so rows follow the documents and not their pairs. What may still grow faster:
documents that hold a frequent shingle among their rarest and are not linked.

A set is the 64-bit hashes of its shingles, and its equality that of a 128-bit digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.minhash import components, shingle_sets
from modelwatch.llm.shared import Scratch, arrow_map, arrow_schema, slices, trim

WIDTH = 4
NUMERATOR, DENOMINATOR = 17, 20  # a link has at least this Jaccard similarity
BLOCK, SHINGLES = 256, 1 << 20  # documents of a group, and shingles of them all unless it is one document
FOLLOWERS = 256  # documents that one copy of a group is compared with
SLOT_BITS = 18  # frequencies of shingles are counted in so many slots (as a power of two), which every task is told of
ROUNDS = 2  # of stars
RATIO = 1.05  # between the sizes of a group's documents


def prefix_sizes(n: np.ndarray | int) -> tuple:
    """How many of a set's first shingles meet those of sets at least as large, and of smaller ones.

    With x <= y shingles and c common ones a link has 37 c >= 17 (x + y), so c >= 34 x / 37 and
    c >= 17 y / 20. Two sets with c common elements share one of the first x - c + 1 and the
    first y - c + 1 in any order.
    """
    p, q = NUMERATOR, DENOMINATOR
    return n - -(-2 * p * n // (p + q)) + 1, n - -(-p * n // q) + 1


def linked(both: int, n: int, m: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (n + m - both)


def _fits(n: Column, low: Column, high: Column) -> Column:
    """Whether sets of low to high shingles may link with one of n that is no smaller."""
    return (low <= n) & (high * DENOMINATOR >= n * NUMERATOR)


# -- sets and their first shingles ------------------------------------------------------

_ROW = "row long, doc_id long, n_shingles long, digest binary, typical long, last long, keys binary, text string"
_TOKEN = "key long, rep long, indexed boolean"


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def frequencies(documents: DataFrame, width: int) -> np.ndarray:
    """In how many documents the shingles of each slot are; 2**SLOT_BITS numbers for the driver, whatever the documents."""
    schema = arrow_schema("slot int, n long")

    def run(batches):
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                seen += np.bincount(_slots(np.concatenate([*shingle_sets(rows.column("text"), width), np.zeros(0, np.uint64)])), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], schema=schema)
        trim()

    found = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    seen[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return seen


def sized(documents: DataFrame, width: int, seen: np.ndarray) -> DataFrame:
    """_ROW of every row: a number of its own, the digest of its shingle set (null for an empty one) and its first shingles.

    These are ordered by frequency, then hash; ``typical`` and ``last`` are the frequencies
    of the first and the last of them.
    """
    schema = arrow_schema(_ROW)
    known = documents.sparkSession.sparkContext.broadcast(seen)  # 2**SLOT_BITS numbers

    def make():
        seen = known.value

        def step(rows: pa.RecordBatch):
            n, digests, typical, last, keys = [], [], [], [], []
            for s in shingle_sets(rows.column("text"), width):
                often = seen[_slots(s)]
                first = np.lexsort((s, often))[: prefix_sizes(len(s))[1] if len(s) else 0]
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                typical.append(int(often[first[0]]) if len(s) else 0)
                last.append(int(often[first[-1]]) if len(s) else 0)
                keys.append(s[first].tobytes())
            own = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(typical, pa.int64()), pa.array(last, pa.int64()), pa.array(keys, pa.binary())]
            return pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *own, rows.column("text")], schema=schema)

        return step

    return arrow_map(documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), make, _ROW, "text")


def tokens(firsts: DataFrame) -> DataFrame:
    """_TOKEN: a row for each first shingle of (rep, n, keys)."""
    schema = arrow_schema(_TOKEN)

    def make():
        def step(rows: pa.RecordBatch):
            keys = [np.frombuffer(k, np.int64) for k in rows.column("keys").to_pylist()]
            sizes = [len(k) for k in keys]
            index = prefix_sizes(rows.column("n").to_numpy())[0]
            flags = np.arange(sum(sizes)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) < np.repeat(index, sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(rows.column("rep").to_numpy(), sizes)), pa.array(flags)], schema=schema)

        return step

    return arrow_map(firsts.select("rep", "n", "keys"), make, _TOKEN, "keys")


def possible(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The (rep, g) whose sets, by their first shingles alone, may link; g is a representative as well.

    Of the two runs of first shingles one ends earlier in the common order. What both sets
    have up to there is in both runs, so all that they share is at most what the runs share
    and the rest of that set.
    """
    schema = arrow_schema("rep long, g long")
    x = firsts.select("rep", *(F.col(c).alias(f"x_{c}") for c in ("n", "last", "keys"))).hint("merge")
    y = firsts.select(F.col("rep").alias("g"), *(F.col(c).alias(f"y_{c}") for c in ("n", "last", "keys"))).hint("merge")

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "x_keys"):
                out = []
                for rep, g, n, m, a, b, s, t in zip(*(rows.column(c).to_pylist() for c in ("rep", "g", "x_n", "y_n", "x_last", "y_last", "x_keys", "y_keys")), strict=True):
                    s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                    rest = n - len(s) if (a, s[-1]) <= (b, t[-1]) else m - len(t)
                    if (NUMERATOR + DENOMINATOR) * (len(np.intersect1d(s, t, assume_unique=True)) + rest) >= NUMERATOR * (n + m):
                        out.append((rep, g))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        trim()

    return pairs.join(x, "rep").join(y, "g").mapInArrow(run, "rep long, g long")


# -- groups that are compared with documents --------------------------------------------


def dealt(pairs: DataFrame, members: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(g, part, member, rep, text) sorted by group: every FOLLOWERS documents that ask a group get a copy of its members."""
    counts = scratch.save(pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts")), f"{name}_parts")
    asks = pairs.join(counts, "g").select("rep", "g", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("member"))
    owns = members.join(counts, "g").select("rep", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"))
    roles = scratch.save(asks.unionByName(owns), f"{name}_roles")
    return texts.hint("merge").join(roles, "rep").select("g", "part", "member", "rep", "text").repartition("g", "part").sortWithinPartitions("g", "part", F.col("member").desc())


def opened(pairs: DataFrame, members: DataFrame, texts: DataFrame, scratch: Scratch, name: str, width: int) -> DataFrame:
    """(a, b), a > b: a link of each document with a member of the group g that it asks in ``pairs`` (rep, g), if there is one.

    ``members`` (g, rep). Full sets are compared, of sizes that allow a link.
    """
    schema = arrow_schema("a long, b long")

    def run(batches):
        group, of = [], None
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for s, g, part, member, rep in zip(shingle_sets(rows.column("text"), width), *(rows.column(c).to_pylist() for c in ("g", "part", "member", "rep")), strict=True):
                    if of != (g, part):
                        group, of = [], (g, part)
                    if member:
                        group.append((len(s), rep, s))
                        continue
                    for n, other, t in group:
                        if rep != other and min(n, len(s)) * DENOMINATOR >= max(n, len(s)) * NUMERATOR and linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), n):
                            out.append((max(rep, other), min(rep, other)))
                            break
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        trim()

    return dealt(pairs, members, texts, scratch, name).mapInArrow(run, "a long, b long")


def unions(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(g, low, shingles): each group's union of shingles as sorted 64-bit numbers, and the size of its smallest set."""
    schema = arrow_schema("g long, low long, shingles binary")

    def run(batches):
        of, low, held, size = None, 0, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([low], pa.int64()), pa.array([np.unique(np.concatenate(held)).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for rows in slices(batch, "text"):
                for s, g in zip(shingle_sets(rows.column("text"), width), rows.column("g").to_pylist(), strict=True):
                    if g != of:
                        if of is not None:
                            yield done()
                        of, low, held, size = g, len(s), [], 0
                    low, size = min(low, len(s)), size + len(s)
                    held.append(s)
                    if size > 2 * SHINGLES:  # similar sets: their union is much smaller
                        held = [np.unique(np.concatenate(held))]
                        size = len(held[0])
        if of is not None:
            yield done()
        trim()

    return texts.join(members, "rep").select("g", "text").repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, low long, shingles binary")


def qualifying(pairs: DataFrame, stored: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """The (rep, g) of ``pairs`` whose overlap with the group's union allows a link with a member."""
    counts = scratch.save(pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts")), "bound_parts")
    asks = scratch.save(pairs.join(counts, "g").select("rep", "g", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")), "bound_asks")
    told = texts.join(asks, "rep").select("g", "part", "rep", "text", F.lit(None).cast("long").alias("low"), F.lit(None).cast("binary").alias("shingles"))
    owns = stored.join(counts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("string").alias("text"), "low", "shingles")
    cells = owns.unionByName(told).repartition("g", "part").sortWithinPartitions("g", "part", F.col("rep").asc_nulls_first())
    schema = arrow_schema("rep long, g long")

    def run(batches):
        whole, low, of = np.zeros(0, np.uint64), 0, None
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for s, g, part, rep, least, shingles in zip(shingle_sets(rows.column("text"), width), *(rows.column(c).to_pylist() for c in ("g", "part", "rep", "low", "shingles")), strict=True):
                    if rep is None:
                        whole, low, of = np.frombuffer(shingles, np.uint64), least, (g, part)
                    elif of == (g, part):
                        at = np.searchsorted(whole, s)
                        both = int((whole[np.minimum(at, len(whole) - 1)] == s).sum())
                        least = max(low, -(-NUMERATOR * len(s) // DENOMINATOR))
                        if (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (len(s) + least):
                            out.append((rep, g))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        trim()

    return cells.mapInArrow(run, "rep long, g long")


# -- components -------------------------------------------------------------------------


def star_rounds(shared: DataFrame, firsts: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """``shared`` (key, rep, n, typical, indexed) with ``comp``, and the links (a, b) of each round."""
    now, found = shared.withColumn("comp", F.col("rep")), []
    for t in range(ROUNDS):
        first = F.col("typical") if t == 0 else F.xxhash64(F.lit(t), "rep")
        centers = now.groupBy("key").agg(F.max(F.struct(first.alias("h"), (-F.col("rep")).alias("less"), "comp", "n")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        centers = centers.select("key", (-F.col("c.less")).alias("center"), F.col("c.comp").alias("theirs"), F.col("c.n").alias("m"), F.col("c.h").alias("h"))
        votes = now.join(centers, "key").where((F.col("comp") != F.col("theirs")) & (F.least("n", "m") * DENOMINATOR >= F.greatest("n", "m") * NUMERATOR)).groupBy("rep", "center", "h").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("rep").agg(F.max(F.struct("votes", "h", (-F.col("center")).alias("less"))).alias("m")).select("rep", (-F.col("m.less")).alias("g"))
        best = scratch.save(possible(best, firsts), f"best{t}")
        links = scratch.save(opened(best, best.select("g").distinct().withColumn("rep", F.col("g")), texts, scratch, f"star{t}", width), f"links{t}")
        found.append(links)
        comps = now.select("rep", "comp").distinct()
        edges = links.join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a").join(comps.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        merged = components(scratch.save(edges, f"edges{t}")).select(F.col("id").alias("comp"), "root")
        labelled = now.join(merged, "comp", "left").select(*shared.columns, F.coalesce("root", "comp").alias("comp"))
        # Of keys that only one component has nothing more can come.
        labelled = scratch.save(labelled, f"labelled{t}")
        mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("indexed").alias("some")).where("lo <> hi and some").select("key")
        now = scratch.save(labelled.join(mixed, "key", "left_semi"), f"mixed{t}")
        scratch.drop(f"labelled{t}")
    return now, found


def group_links(labelled: DataFrame, firsts: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(a, b): of every document and every group of another component a link, if there is one."""
    docs = labelled.select("rep", "comp", "n").distinct()
    docs = docs.withColumn("band", F.floor(F.log("n") / float(np.log(RATIO))))
    parts = docs.groupBy("comp", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    placed = docs.join(parts, ["comp", "band"]).select("rep", F.xxhash64("comp", "band", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("g"))
    placed = scratch.save(placed, "placed")
    index = labelled.where("indexed").join(placed, "rep").groupBy("key", "comp", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    index = scratch.save(index.withColumnsRenamed({"comp": "theirs"}), "matrix")
    tops = index.groupBy("key", "theirs").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # Components first, then the groups of those that fit: a document never meets its own component's groups.
    other = F.col("comp") != F.col("theirs")
    once = ~((F.col("low") == F.col("n")) & (F.col("high") == F.col("n")) & (F.col("theirs") > F.col("comp")))  # of equal sizes one asks the other
    asks = labelled.select("key", "rep", "n", "comp").join(tops, "key").where(other & once & _fits(F.col("n"), F.col("low"), F.col("high"))).select("key", "rep", "n", "comp", "theirs")
    pairs = asks.join(index, ["key", "theirs"]).where(once & _fits(F.col("n"), F.col("low"), F.col("high"))).select("rep", "g").distinct()
    pairs = scratch.save(pairs, "asked")
    members = placed.join(pairs.select("g").distinct(), "g", "left_semi")
    size = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    many = scratch.save(size.where("size > 1").select("g"), "many")
    bounded = pairs.join(many, "g", "left_semi")
    stored = scratch.save(unions(members.join(many, "g", "left_semi"), texts, width), "unions")
    # A group of one document needs no union: its first shingles are at hand.
    sole = pairs.join(many, "g", "left_anti").join(placed.select("g", F.col("rep").alias("other")), "g")
    near = possible(sole.select("rep", F.col("other").alias("g")), firsts)
    left = qualifying(bounded, stored, texts, scratch, width).unionByName(near.join(placed.select(F.col("rep").alias("g"), F.col("g").alias("of")), "g").select("rep", F.col("of").alias("g")))
    left = scratch.save(left, "left")
    return opened(left, placed.join(left.select("g").distinct(), "g", "left_semi"), texts, scratch, "open", width)


# -- the operator -----------------------------------------------------------------------


def joined(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Shingles are ``width`` words of the text with A-Z lower-cased; a text of fewer words is
    one. Null, empty and blank texts have no shingles and are their own component. Repeated
    rows are each answered; rows that share a doc_id are each classified by their own text.
    Rows without doc_id have the component of equal texts that have one, else null. All links
    count, so ties need no rule. A very long text is a slice, and a group, of its own. An empty
    table gives an empty table; other columns are dropped.
    """
    scratch = Scratch(documents.sparkSession)
    docs = scratch.save(sized(documents, width, frequencies(documents, width)), "docs")
    some = docs.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = scratch.save(some.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("digest", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("least")), "reps")
    of = docs.withColumnsRenamed({"row": "rep", "n_shingles": "n"}).hint("merge")
    every = scratch.save(of.select("rep", "n", "typical", "last", "keys").join(reps, "rep", "left_semi"), "every")
    rows = scratch.save(tokens(every), "tokens")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("some")).where("n > 1 and some").select("key")
    rows = scratch.save(rows.hint("merge").join(keys, "key", "left_semi"), "common")
    scratch.drop("tokens")
    involved = scratch.save(rows.select("rep").distinct(), "involved")
    firsts = scratch.save(every.hint("merge").join(involved, "rep", "left_semi"), "firsts")
    scratch.drop("every")
    shared = scratch.save(rows.join(firsts.select("rep", "n", "typical").hint("merge"), "rep"), "shared")
    texts = scratch.save(of.select("rep", "text").join(involved, "rep", "left_semi"), "texts")
    labelled, links = star_rounds(shared, firsts, texts, scratch, width)
    for more in [*links[1:], scratch.save(group_links(labelled, firsts, texts, scratch, width), "last")]:
        links[0] = links[0].unionByName(more)
    final = components(links[0]).withColumnRenamed("id", "rep")
    held = scratch.save(reps.join(final, "rep").select("digest", "root", "least"), "linked")
    named = held.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = reps.select("digest", "least").join(held.join(named, "root").select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    classes = scratch.save(classes, "classes")
    scratch.keep("docs", "classes")
    return docs.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's component of links between sets of four-word shingles."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
