"""MinHash near-dedup with HyperMinHash sketches, and the components of verified links.

Steps, each a table in the shared folder:

1. Every row gets a number, and rows with equal shingle sets collapse to one
   representative; its sketch keeps 128 registers, each the leading-zero count and ten
   mantissa bits of the least hash in a bucket; empty registers borrow by a probe
   sequence of their own.
2. Bands of four registers (64 bits, so a band's key is the registers themselves) put
   representatives into buckets; only buckets with two or more go on.
3. Stars: the collision-corrected Jaccard estimate of each member and its bucket's
   smallest member; each document's best one is verified on full shingle sets, and the
   verified links, which always lead to a smaller number, are followed to their roots.
   A few more rounds have other members in the centre.
4. What stars can't see: pairs of different components in a bucket. Components of more than
   BLOCK documents are families: a document that shares a bucket with one asks it as a
   whole. A family is a tree of groups, the leaves of at most BLOCK documents, each with the
   union of its shingles; who shares too little with a union for any link is done with all
   below it, and members are compared on full sets only in the leaves that are left.
5. The other documents of a bucket meet in one block where they are at most BLOCK: pairs are
   estimated, only which documents have a partner near the threshold is written, and their
   texts meet in the same block, where pairs whose components aren't linked yet are
   verified on full sets. A pair that shares several bands is looked at in the first of
   these only. Where they are more, as pages of one template, they meet by rare shingles: a
   pair that is similar enough shares one of the first shingles of both in any common
   order, and in the order of rising frequency these are what the template lacks. Pairs that
   share one are estimated and verified.
6. Components over all links; each is named by the smallest doc_id in it.

Large groups of near copies collapse in step 3 with one row per document, so the later
steps meet them as few components. Verification reads a member's and its partner's whole
texts; a partner with many members is sent once to every few hundred of them.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import Scratch, arrow_map, arrow_schema, checkpointed, trim
from modelwatch.llm.words import BASE, mix, words

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
WIDTH, CONTRACT_WIDTH = 5, 2  # words of a shingle: of near-duplicate stages, and of op4_minhash by its contract
NUMERATOR, DENOMINATOR = 4, 5  # a link has at least this Jaccard similarity
MARGIN = 0.18  # below the threshold an estimate still goes to verification: five standard deviations of 128 registers at 0.8
BLOCK = 256  # documents that are compared with as many at a time
SLOT_BITS = 18  # frequencies of shingles are counted in so many slots (as a power of two), which every task is told of
ROUNDS = 2  # of stars with other centres
FOLLOWERS = 128  # texts that one copy of a partner's text is compared with
UNION = 1 << 18  # shingles of a stored union at most; a group with more has none, and its parts are asked instead
ASKERS = 4096  # documents that one copy of a group is compared with
LABELS = 1 << 20  # rows of a table of labels that a task takes


# -- sets and sketches ------------------------------------------------------------------


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than ``width`` are one shingle, none are none."""
    found = words(column, lower=True)
    hashed, n = found.hashes(), found.counts()
    value = hashed.copy()
    for k in range(1, width):
        value[:-k] = value[:-k] * BASE + hashed[k:]
    value = mix(value)
    out = []
    for i, (a, b) in enumerate(pairwise(found.first.tolist())):
        if n[i] >= width:
            out.append(np.unique(value[a : b - width + 1]))
        elif n[i]:
            whole = hashlib.blake2b(b"\0".join(found.data[found.starts[k] : found.ends[k]].tobytes() for k in range(a, b)), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _probes() -> np.ndarray:
    """[REGISTERS, REGISTERS]: for each register the order in which it asks the others."""
    return np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64).reshape(REGISTERS, REGISTERS) * np.uint64(0x2545F4914F6CDD1D)), axis=1)


_PROBES = _probes()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, REGISTERS] of 16 bits: leading zeros of a bucket's least hash, then the MANTISSA bits after its first one."""
    size = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(len(least), bool)
    if size.sum():
        h = mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F))
        cell = np.repeat(np.arange(len(sets)), size) * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64)
        value = mix(h) | np.uint64(1)
        np.minimum.at(least, cell, value)
        filled[cell] = True
    exponent = np.frexp(least.astype(np.float64))[1]  # may round up by one where all bits are set
    exponent = np.where(exponent < 64, exponent, 64)
    exponent -= (least >> (exponent - 1).astype(np.uint64)) == 0
    zeros = (64 - exponent).astype(np.uint64)
    tail = (least << (zeros & np.uint64(63))) << np.uint64(1)  # without the first one
    out = (np.minimum(zeros, 63) << np.uint64(MANTISSA) | tail >> np.uint64(64 - MANTISSA)).astype(np.uint16).reshape(-1, REGISTERS)
    filled = filled.reshape(-1, REGISTERS)
    short = np.flatnonzero(~filled.all(1) & filled.any(1))
    if len(short):
        own, have = out[short], filled[short]
        result, open_ = own.copy(), ~have
        for t in range(REGISTERS):
            take = open_ & have[:, _PROBES[:, t]]
            result[take] = own[:, _PROBES[:, t]][take]
            open_ &= ~take
            if not open_.any():
                break
        out[short] = result
    return out


def estimate(matches, n: np.ndarray, m: np.ndarray):
    """Jaccard similarity from matching registers, less the collisions that different sets would have."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.17 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    share = matches / REGISTERS
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


_SKETCHED = "row long, doc_id long, own long, n_shingles long, digest binary, sketch binary, text string"


def sketched(documents: DataFrame, width: int) -> DataFrame:
    """_SKETCHED of every row: a number of its own, a hash of its text, the digest of its shingle set and its sketch (null for an empty set)."""
    schema = arrow_schema(_SKETCHED)

    def make():
        def step(rows: pa.RecordBatch):
            sets = shingle_sets(rows.column("text"), width)
            regs = registers(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            cells = [rows.column("row"), rows.column("doc_id"), rows.column("own"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()), rows.column("text")]
            return pa.RecordBatch.from_arrays(cells, schema=schema)

        return step

    text = F.col("text").cast("string")
    return arrow_map(documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("own"), text.alias("text")), make, _SKETCHED, "text")


def bands(representatives: DataFrame) -> DataFrame:
    """(key, rep): BANDS rows a representative."""
    schema = arrow_schema("key long, rep long")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                keys = band_keys(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rows.column("rep").to_numpy(), BANDS))], schema=schema)

    return representatives.select("rep", "sketch").mapInArrow(run, "key long, rep long")


# -- verification -----------------------------------------------------------------------


def dealt_roles(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, role) of the pairs' members and centres, with the copy of the centre that a member meets.

    Only centres of more than one copy are looked up, and these are fewer than one in
    FOLLOWERS of the pairs; so no pair is shuffled, and as a table roles are read in as many
    tasks as their rows need and not in one for each shuffle partition.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts"))
    counts = scratch.save(counts, f"{name}_centres")
    member = F.struct(F.col("b"), F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(True).alias("member"))
    center = F.struct(F.col("b"), F.col("part"), F.lit(False).alias("member"))
    roles = pairs.join(F.broadcast(counts.where("parts > 1")), "b", "left").select(F.col("a").alias("doc_id"), member.alias("role"))
    roles = roles.unionByName(counts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("b").alias("doc_id"), center.alias("role")))
    return scratch.save(roles, f"{name}_roles")


def verified(pairs: DataFrame, texts: DataFrame, width: int, scratch: Scratch | None = None, name: str = "verified") -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    b's text meets those of its partners; with more than FOLLOWERS of these it is sent
    once for so many each, so no task gets all of them. ``name`` is that of tables in
    ``scratch``.
    """
    roles = dealt_roles(pairs, scratch or Scratch(pairs.sparkSession), name)
    placed = texts.join(roles, "doc_id").select("role.b", "role.part", "role.member", "doc_id", "text")
    placed = placed.repartition("b", "part").sortWithinPartitions("b", "part", "member")
    schema = arrow_schema("a long, b long")

    def run(batches):
        from modelwatch.llm.shared import slices

        center, of = np.zeros(0, np.uint64), None
        for batch in batches:
            for rows in slices(batch, "text"):
                linked = []
                for s, a, b, part, is_member in zip(shingle_sets(rows.column("text"), width), *(rows.column(c).to_pylist() for c in ("doc_id", "b", "part", "member")), strict=True):
                    if not is_member:
                        center, of = s, (b, part)
                    elif of == (b, part) and len(s) and len(center):
                        both = len(np.intersect1d(s, center, assume_unique=True))
                        if DENOMINATOR * both >= NUMERATOR * (len(s) + len(center) - both):
                            linked.append((a, b))
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linked, strict=True)], schema=schema)
        trim()

    return placed.mapInArrow(run, "a long, b long")


# -- components -------------------------------------------------------------------------


def _compact(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table of about ``rows`` labels, in no more tasks than these need; one of many rows stays as it is."""
    return df.coalesce(max(1, -(-rows // LABELS)))


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, parent) where every parent is smaller: each step follows two links."""
    now = checkpointed(parents.select(F.col("a").alias("id"), F.col("b").alias("root")))
    n = now.count()
    now = _compact(now, n)
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("above"))
        step = checkpointed(_compact(now.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), n))
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def components(links: DataFrame) -> DataFrame:
    """(id, root): for every id in (a, b) the smallest one that links reach, by least neighbours and jumps."""
    links = checkpointed(links.select("a", "b").distinct())
    n = 2 * links.count()
    links = _compact(links, n)
    both = checkpointed(_compact(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n))
    now = checkpointed(_compact(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")), n))
    while True:
        at = now.select(F.col("id").alias("b"), "root")
        near = both.join(at, "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        mid = checkpointed(_compact(now.join(near, "id").select("id", "root", F.least("root", "near").alias("next")), n))
        up = mid.select(F.col("id").alias("next"), F.col("next").alias("above"))
        step = checkpointed(_compact(mid.join(up, "next", "left").select("id", F.least("next", F.coalesce("above", "next")).alias("new"), "root"), n))
        now = step.select("id", F.col("new").alias("root"))
        if not step.where("new <> root").limit(1).count():
            return now


# -- pairs that stars can't see ---------------------------------------------------------

_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[documents, BANDS] of a 64-bit key for each band's registers."""
    return mix(mix(regs.view(np.uint64)) ^ _SALT)


def _near(rows: pa.Table, n: np.ndarray, regs: np.ndarray):
    """(i, j, estimates): for each row i of a block the rows j of other components near the threshold.

    Only pairs whose first shared band is the one of this block's bucket, whose key is the cell.
    """
    comp = rows.column("comp").to_numpy()
    key = np.int64(rows.column("cell")[0].as_py()).view(np.uint64)
    wide = regs.view(np.uint64)
    band = int((band_keys(regs[:1])[0] == key).argmax())
    for i in range(len(comp) - 1):
        j = np.arange(i + 1, len(comp))
        j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * DENOMINATOR >= np.maximum(n[j], n[i]) * NUMERATOR)]
        if len(j):
            j = j[(wide[j] == wide[i]).argmax(1) == band]
        if len(j):
            e = estimate((regs[j] == regs[i]).sum(1), n[j], n[i])
            near = e >= NUMERATOR / DENOMINATOR - MARGIN
            if near.any():
                yield i, j[near], e[near]


def _by_cell(step, schema: pa.Schema):
    """A function for mapInArrow that gives ``step`` whole cells of rows sorted by cell."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            out = step(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            return [pa.RecordBatch.from_arrays(out, schema=schema)] if out is not None else []

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()]
            for a, b in pairwise([*cuts, len(cell)]):
                if held and held[-1].column("cell")[0].as_py() != cell[a]:
                    yield from done()
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()
        trim()

    return run


_CELL = "cell long, rep long, comp long"


def mixed(labelled: DataFrame) -> DataFrame:
    """The rows (key, rep, comp) of buckets with more than one component; nothing more can come of the others."""
    keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return labelled.join(keys, "key", "left_semi")


def still_open(labelled: DataFrame, representatives: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Numbers and sketches (rep, n_shingles, sketch), and texts, of the documents in ``labelled``.

    Later steps join these again and again, and each such join shuffles its table whole; of
    documents whose buckets are all settled they ask nothing more. Texts are not broadcast,
    however small their table is on disk: near copies unpack to many times that.
    """
    reps = scratch.save(labelled.select("rep").distinct(), "open")
    sketches = scratch.save(representatives.select("rep", "n_shingles", "sketch").join(reps, "rep", "left_semi"), "open_reps")
    return sketches, scratch.save(texts.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), "open_texts").hint("merge")


def star_rounds(labelled: DataFrame, representatives: DataFrame, texts: DataFrame, scratch: Scratch, width: int, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """``labelled`` (key, rep, comp) after more rounds of stars, and the links (a, b) of each.

    In every round each bucket has another centre, that of the least hash, and each document
    of another component than a centre's has its best centre verified. So a large
    component takes in what is linked to many of its members before anything is compared
    in blocks. Buckets that one component has left to itself are gone from the result.
    """
    found = []
    for t in range(rounds):
        centers = labelled.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(t), "rep").alias("h"), "rep", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "c")
        pairs = _distinct(labelled.join(centers, "key").where("comp <> c.comp").select(F.col("rep").alias("a"), F.col("c.rep").alias("b")))
        sketch = representatives.select("rep", "n_shingles", "sketch")
        best = scratch.save(_estimated(pairs, sketch).groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("less"))).alias("m")).select("a", (-F.col("m.less")).alias("b")), f"best{t}")
        links = scratch.save(verified(best, texts, width, scratch, f"links{t}"), f"links{t}")
        found.append(links)
        comps = labelled.groupBy("rep").agg(F.min("comp").alias("comp"))  # a document has one
        edges = links.join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a").join(comps.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        merged = components(scratch.save(edges, f"edges{t}")).select(F.col("id").alias("comp"), "root")
        changed = scratch.save(labelled.join(merged, "comp", "left").select("key", "rep", F.coalesce("root", "comp").alias("comp")), f"labelled{t}")
        labelled = scratch.save(mixed(changed), f"mixed{t}")
        scratch.drop(f"labelled{t}")
    return labelled, found


def cross_links(labelled: DataFrame, representatives: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(a, b): verified links between different components that share a bucket, at least as many as connect them."""
    large = scratch.save(labelled.select("rep", "comp").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("comp", F.lit(True).alias("large")), "large")
    marked = scratch.save(labelled.join(large, "comp", "left").select("key", "rep", "comp", F.col("large").isNotNull().alias("large")), "marked")
    by_family = family_links(marked, representatives, texts, scratch, width)
    small = marked.where("not large").drop("large")
    sizes = scratch.save(small.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "n"), "sizes")
    # Where a bucket has more than one block of these, they meet by shingles and not in pairs of blocks.
    wide = scratch.save(sizes.where(F.col("n") > BLOCK).select("key"), "wide")
    crowd = scratch.save(small.join(wide, "key", "left_semi").select("rep", "comp").distinct(), "crowd")
    by_shingle = shingle_links(crowd, representatives, texts, scratch, width)
    dealt = small.join(sizes.where(F.col("n") <= BLOCK).select("key"), "key", "left_semi").select(F.col("key").alias("cell"), "rep", "comp")
    schema, links = arrow_schema(_CELL), arrow_schema("a long, b long")
    names = schema.names

    def involved(rows: pa.Table):
        regs = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        some = np.zeros(rows.num_rows, bool)
        for i, j, _ in _near(rows, rows.column("n_shingles").to_numpy(), regs):
            some[i] = some[j] = True
        if some.any():
            return [c.combine_chunks() for c in rows.select(names).filter(pa.array(some)).columns]
        return None

    def linked(rows: pa.Table):
        sets = shingle_sets(rows.column("text"), width)
        n = np.array([len(x) for x in sets])
        rep, comp = rows.column("rep").to_pylist(), rows.column("comp").to_pylist()
        parent = {c: c for c in comp}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        pairs = [(e, i, k) for i, j, es in _near(rows, n, registers(sets)) for k, e in zip(j.tolist(), es.tolist(), strict=True)]
        out = []
        for _, i, k in sorted(pairs, reverse=True):
            if (p := root(comp[i])) != (q := root(comp[k])):
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (len(sets[i]) + len(sets[k]) - both):
                    parent[p] = q
                    out.append((max(rep[i], rep[k]), min(rep[i], rep[k])))
        return [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else None

    sketch = representatives.select("rep", "n_shingles", "sketch")
    full = scratch.save(dealt, "dealt").join(sketch, "rep").repartition("cell").sortWithinPartitions("cell")
    near = scratch.save(full.mapInArrow(_by_cell(involved, schema), _CELL), "near")
    told = near.join(texts.withColumnRenamed("doc_id", "rep"), "rep").repartition("cell").sortWithinPartitions("cell")
    return told.mapInArrow(_by_cell(linked, links), "a long, b long").unionByName(by_shingle).unionByName(by_family).distinct()


_NODE = "comp long, g long, low long, high long, shingles binary"


def family_links(marked: DataFrame, representatives: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(a, b): of every document and every leaf of a family that it shares a bucket with a link, if there is one.

    ``marked`` (key, rep, comp, large). Of two families the one of the larger number asks. A
    family has a root, asked once by each document, so rows follow the documents; what
    passes a bound asks at most BLOCK nodes below.
    """
    if not marked.where("large").limit(1).count():
        return marked.sparkSession.createDataFrame([], "a long, b long")
    tops = marked.where("large").select("key", F.col("comp").alias("theirs")).distinct()
    other = (F.col("comp") != F.col("theirs")) & (~F.col("large") | (F.col("comp") > F.col("theirs")))
    asks = scratch.save(marked.join(tops, "key").where(other).select("rep", F.col("theirs").alias("comp"), F.lit(0).cast("long").alias("g")).distinct(), "asks")
    members = marked.where("large").select("rep", "comp").distinct().join(representatives.select("rep", F.col("n_shingles").alias("n")), "rep")
    parts = scratch.save(members.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / UNION)).cast("long").alias("parts")), "parts")
    placed = scratch.save(members.join(parts, "comp").select("rep", "comp", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("g")), "placed")
    levels = [scratch.save(leaf_unions(placed, texts, width), "nodes0")]
    most = parts.agg(F.max("parts")).first()[0]
    while most > 1:
        most = -(-most // BLOCK)
        levels.append(scratch.save(node_unions(levels[-1]), f"nodes{len(levels)}"))
    for k in reversed(range(len(levels))):
        asks = scratch.save(qualifying(asks, levels[k], texts, scratch, width, f"copies{k}"), f"asked{k}")
        if k:
            below = levels[k - 1].select("comp", F.col("g").alias("child"), F.floor(F.col("g") / BLOCK).alias("g"))
            asks = asks.join(below, ["comp", "g"]).select("rep", "comp", F.col("child").alias("g"))
    return scratch.save(opened(asks, placed, texts, scratch, width), "opened")


def _united(items, schema: pa.Schema):
    """A node of each run of items (comp, g, low, high, shingles or None) that have one (comp, g)."""
    of, low, high, held, size = None, 0, 0, [], 0

    def node():
        shingles = None if held is None else np.unique(np.concatenate(held)).tobytes()
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*of, low, high, shingles), strict=True))], schema=schema)

    for comp, g, least, greatest, s in items:
        if (comp, g) != of:
            if of is not None:
                yield node()
            of, low, high, held, size = (comp, g), least, greatest, [], 0
        low, high = min(low, least), max(high, greatest)
        if s is None:
            held = None
        elif held is not None:
            held.append(s)
            size += len(s)
            if size > 2 * UNION:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size > UNION:
                    held = None
    if of is not None:
        yield node()
    trim()


def leaf_unions(placed: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """_NODE of every leaf (comp, g) of ``placed``."""
    schema = arrow_schema(_NODE)

    def items(batches):
        from modelwatch.llm.shared import slices

        for batch in batches:
            for rows in slices(batch, "text"):
                for s, comp, g in zip(shingle_sets(rows.column("text"), width), *(rows.column(c).to_pylist() for c in ("comp", "g")), strict=True):
                    yield comp, g, len(s), len(s), s

    read = texts.withColumnRenamed("doc_id", "rep").join(placed, "rep").select("comp", "g", "text")
    return read.repartition("comp", "g").sortWithinPartitions("comp", "g").mapInArrow(lambda batches: _united(items(batches), schema), _NODE)


def node_unions(below: DataFrame) -> DataFrame:
    """_NODE of the nodes above: each joins BLOCK of ``below``."""
    schema = arrow_schema(_NODE)

    def items(batches):
        for batch in batches:
            for comp, g, low, high, shingles in zip(*(batch.column(c) for c in schema.names), strict=True):
                yield comp.as_py(), g.as_py(), low.as_py(), high.as_py(), np.frombuffer(shingles.as_py(), np.uint64) if shingles.is_valid else None

    up = below.withColumn("g", F.floor(F.col("g") / BLOCK))
    return up.repartition("comp", "g").sortWithinPartitions("comp", "g").mapInArrow(lambda batches: _united(items(batches), schema), _NODE)


def _parts(asks: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The asked nodes with the numbers of their copies, (comp, g, part), and the asks with the copy that each meets.

    Nodes are broadcast: there is about one for BLOCK documents or UNION shingles, and a copy for ASKERS asks.
    """
    counts = F.broadcast(scratch.save(asks.groupBy("comp", "g").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("parts")), name))
    copies = F.broadcast(counts.select("comp", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    return copies, asks.join(counts, ["comp", "g"]).select("rep", "comp", "g", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))


def qualifying(asks: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, width: int, name: str) -> DataFrame:
    """The asks (rep, comp, g) whose overlap with the node's union allows a link with a member."""
    copies, placed = _parts(asks, scratch, name)
    told = texts.withColumnRenamed("doc_id", "rep").join(placed, "rep").select("comp", "g", "part", "rep", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("low", "long"), ("high", "long"), ("shingles", "binary"))))
    owns = nodes.join(copies, ["comp", "g"]).select("comp", "g", "part", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("string").alias("text"), "low", "high", "shingles")
    cells = owns.unionByName(told).repartition("comp", "g", "part").sortWithinPartitions("comp", "g", "part", F.col("rep").asc_nulls_first())
    schema = arrow_schema("rep long, comp long, g long")

    def run(batches):
        from modelwatch.llm.shared import slices

        whole, low, high = None, 0, 0
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for s, rep, comp, g, least, greatest, shingles in zip(shingle_sets(rows.column("text"), width), *(rows.column(c).to_pylist() for c in ("rep", "comp", "g", "low", "high", "shingles")), strict=True):
                    if rep is None:
                        whole, low, high = None if shingles is None else np.frombuffer(shingles, np.uint64), least, greatest
                        continue
                    x = max(low, -(-NUMERATOR * len(s) // DENOMINATOR))  # the least size of a member that fits
                    if x > high or x * NUMERATOR > len(s) * DENOMINATOR:
                        continue
                    if whole is not None:
                        at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
                        if (NUMERATOR + DENOMINATOR) * int((whole[at] == s).sum()) < NUMERATOR * (len(s) + x):
                            continue
                    out.append((rep, comp, g))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        trim()

    return cells.mapInArrow(run, "rep long, comp long, g long")


def opened(asks: DataFrame, placed: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(a, b), a > b: a link of each document with a member of the leaf that it asks, if there is one."""
    copies, askers = _parts(asks, scratch, "leaves")
    roles = askers.withColumn("member", F.lit(False)).unionByName(placed.join(copies, ["comp", "g"]).select("rep", "comp", "g", "part", F.lit(True).alias("member")))
    cells = texts.withColumnRenamed("doc_id", "rep").join(roles, "rep").select("comp", "g", "part", "member", "rep", "text")
    cells = cells.repartition("comp", "g", "part").sortWithinPartitions("comp", "g", "part", F.col("member").desc())
    schema = arrow_schema("a long, b long")

    def run(batches):
        from modelwatch.llm.shared import slices

        of, sets, reps, index = None, [], [], None
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for s, comp, g, part, member, rep in zip(shingle_sets(rows.column("text"), width), *(rows.column(c).to_pylist() for c in ("comp", "g", "part", "member", "rep")), strict=True):
                    if of != (comp, g, part):
                        of, sets, reps, index = (comp, g, part), [], [], None
                    if member:
                        sets.append(s)
                        reps.append(rep)
                        continue
                    index = index or _Overlaps(sets)
                    both = index.with_set(s)
                    fit = np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (len(s) + index.sizes - both))
                    if len(fit):
                        out.append((max(rep, reps[fit[0]]), min(rep, reps[fit[0]])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        trim()

    return cells.mapInArrow(run, "a long, b long")


class _Overlaps:
    """How many elements a set shares with each of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, first = np.unique(every[order], return_index=True)
        self.bounds = np.append(first, len(every))

    def with_set(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        n = self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(self.bounds[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[place], minlength=len(self.sizes))


_TOKEN = "key long, rep long, comp long, indexed boolean"


def prefix_sizes(n: int) -> tuple[int, int]:
    """How many of a set's first shingles meet those of sets at least as large, and of smaller ones.

    Of sets with x <= y shingles a link has 9 * common >= 4 * (x + y) >= 8 * x, and x >= 0.8 * y. Two sets with c common
    elements share one of the first x - c + 1 and the first y - c + 1 in any common order.
    """
    return n - -(-8 * n // 9) + 1, n - -(-4 * n // 5) + 1


def shingle_links(crowd: DataFrame, representatives: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(a, b): all links between different components among ``crowd`` (rep, comp), found by rare shingles.

    The order is by frequency in these documents, counted in 2**SLOT_BITS slots over all of
    them, then by hash; any order gives all links, and a good one few candidates. A
    document has a row for each of its first shingles. In a shingle's group each document is
    at home in one part, and those that have it among their index shingles are copied to
    all parts, so rows grow with the group unless many of it have a frequent shingle as rare.
    """
    read = crowd.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "comp", "text")
    counts, tokens, links = arrow_schema("slot int, n long"), arrow_schema(_TOKEN), arrow_schema("a long, b long")

    def slots(s: np.ndarray) -> np.ndarray:
        return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def count():
        def step(rows: pa.RecordBatch):
            slot, n = np.unique(slots(np.concatenate(shingle_sets(rows.column("text"), width))), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], schema=counts)

        return step

    seen = np.zeros(1 << SLOT_BITS, np.int64)
    frequent = arrow_map(read, count, "slot int, n long", "text").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row a slot at most
    seen[frequent.column("slot").to_numpy()] = frequent.column("n").to_numpy()
    if not seen.any():
        return crowd.sparkSession.createDataFrame([], "a long, b long")

    def first():
        def step(rows: pa.RecordBatch):
            out, flags, sizes = [], [], []
            for s in shingle_sets(rows.column("text"), width):
                index, probe = prefix_sizes(len(s))
                out.append(s[np.lexsort((s, seen[slots(s)]))[:probe]])
                sizes.append(len(out[-1]))
                flags.append(np.arange(sizes[-1]) < index)
            rep, comp = (np.repeat(rows.column(c).to_numpy(), sizes) for c in ("rep", "comp"))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(rep), pa.array(comp), pa.array(np.concatenate(flags))], schema=tokens)

        return step

    rows = scratch.save(arrow_map(read, first, _TOKEN, "text"), "tokens")
    groups = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("indexed").alias("some"), F.count(F.lit(1)).alias("n")).where("lo <> hi and some")
    groups = scratch.save(groups.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "groups")
    home = F.struct(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("home"))
    copies = F.when(F.col("indexed"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(False).alias("home")))).otherwise(F.array().cast("array<struct<part: int, home: boolean>>"))
    met = rows.join(groups, "key").select("key", "rep", "comp", F.explode(F.concat(F.array(home), copies)).alias("at"))
    met = scratch.save(met.select(F.xxhash64("key", "at.part").alias("cell"), "rep", "comp", "at.home"), "met")

    def candidates(rows: pa.Table):
        regs = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        rep, comp, n, home = (rows.column(c).to_numpy() for c in ("rep", "comp", "n_shingles", "home"))
        right, out = np.flatnonzero(home), []
        for i in np.flatnonzero(~home).tolist():
            m = n[right]
            j = right[(comp[right] != comp[i]) & ((m > n[i]) | ((m == n[i]) & (rep[right] > rep[i]))) & (n[i] * DENOMINATOR >= m * NUMERATOR)]
            if len(j):
                j = j[estimate((regs[j] == regs[i]).sum(1), n[j], n[i]) >= NUMERATOR / DENOMINATOR - MARGIN]
                out.append((np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])))
        return [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)] if out else None

    full = met.join(representatives.select("rep", "n_shingles", "sketch"), "rep").repartition("cell").sortWithinPartitions("cell")
    pairs = scratch.save(full.mapInArrow(_by_cell(candidates, links), "a long, b long").distinct(), "pairs")
    return verified(pairs, texts, width, scratch, "rare")


# -- the operator -----------------------------------------------------------------------


def near_duplicates(documents: DataFrame, width: int = CONTRACT_WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Shingles are ``width`` words of the text with A-Z lower-cased; a text of fewer words is
    one. Null, empty and blank texts have no shingles and are their own component. Repeated
    rows are each answered, and rows that share a doc_id are each classified by their own
    text: they link nothing by their id. Rows without doc_id have a null ``kept``, and the
    component of the equal texts that have one. Of texts that are equally similar none is
    preferred: all links count. A very long text is sketched as a slice of its own. An empty
    table gives an empty table; other columns are dropped.
    """
    return classified(documents, width).drop("own")


def classified(documents: DataFrame, width: int) -> DataFrame:
    """``near_duplicates`` with ``own``, xxhash64 of the row's text."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = scratch.save(sketched(documents, width), "docs")
    some = docs.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = scratch.save(some.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "n_shingles", "sketch")).alias("r")).select("digest", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("least"), "r.n_shingles", "r.sketch"), "reps")
    keyed = bands(reps)
    pivots = scratch.save(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "pivots")
    members = scratch.save(keyed.join(pivots, "key"), "members")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    # From here to the components, ``doc_id`` of a text is its representative's row number.
    texts = scratch.save(docs.select(F.col("row").alias("doc_id"), "text").join(involved, "doc_id", "left_semi"), "texts")
    sketch = reps.select("rep", "n_shingles", "sketch")

    stars = _distinct(members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    best = scratch.save(_estimated(stars, sketch).groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("less"))).alias("m")).select("a", (-F.col("m.less")).alias("b")), "best")
    first = scratch.save(verified(best, texts.hint("merge"), width, scratch, "first"), "first")
    labels = scratch.save(roots(first), "roots")
    labelled = scratch.save(members.join(labels.select(F.col("id").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp")), "labelled")
    labelled = scratch.save(mixed(labelled), "mixed")
    open_reps, open_texts = still_open(labelled, reps, texts, scratch)
    for name in ("pivots", "members", "best", "labelled", "texts"):
        scratch.drop(name)
    labelled, more = star_rounds(labelled, open_reps, open_texts, scratch, width, ROUNDS)
    second = scratch.save(cross_links(labelled, open_reps, open_texts, scratch, width), "second")
    final = components(reduce(DataFrame.unionByName, more, first.unionByName(second))).withColumnRenamed("id", "rep")

    linked = scratch.save(reps.select("digest", "rep", "least").join(final, "rep").select("digest", "root", "least"), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = reps.select("digest", "least").join(linked.join(named, "root").select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    classes = scratch.save(classes, "classes")
    scratch.keep("docs", "classes")
    of = docs.select("doc_id", "own", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return of.select("doc_id", "own", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` with one document of each component, that of the smallest doc_id; their columns stay.

    Rows equal in doc_id and text are one document, and one of them stays. Rows that share a
    doc_id and have different texts are documents of their own; of those that share it and
    belong to one component all stay if it is the smallest. Rows without doc_id take no part
    and stay, and so do those without words. An empty table gives an empty table.
    """
    kept = classified(documents.select("doc_id", "text"), width).where("kept").select("doc_id", "own").distinct()
    doc, own = "_kept_doc", "_kept_own"
    while {doc, own} & set(documents.columns):
        doc, own = doc + "_", own + "_"
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own))
    whole = documents.where(F.col("doc_id").isNotNull()).join(kept.withColumnsRenamed({"doc_id": doc, "own": own}), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return whole.unionByName(documents.where(F.col("doc_id").isNull()))


def _distinct(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), dealt by a: so they lie as the join with a's sketch needs them."""
    return pairs.repartition("a").distinct()


def _estimated(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(a, b, score) of the pairs whose sizes and estimate allow a link."""
    left = sketch.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x"))
    right = sketch.select(F.col("rep").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(_sizes_allow(F.col("n"), F.col("m")))
    schema = arrow_schema("a long, b long, score double")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
                score = estimate((x == y).sum(1), rows.column("n").to_numpy(), rows.column("m").to_numpy())
                near = np.flatnonzero(score >= NUMERATOR / DENOMINATOR - MARGIN)
                yield pa.RecordBatch.from_arrays([rows.column("a").take(pa.array(near)), rows.column("b").take(pa.array(near)), pa.array(score[near])], schema=schema)

    return both.mapInArrow(run, "a long, b long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), CONTRACT_WIDTH)
