"""The n-gram join, centroid clustering and divergence audit against plain versions, and their defined cases."""

import collections
import hashlib
import math
import random
import re

import brute
import numpy as np
import pytest
from modelwatch.llm import centroids, divergence, ngrams

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = DOCS + ", rep long, g long, key string, cluster int"


# -- n-gram join ------------------------------------------------------------------------


def plain_components(rows, width=4):
    """For each row (shingles, smallest doc_id that links reach); every two rows are compared."""
    sets = [brute.shingles(t, width) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        near = list(base)
        for at in rng.sample(range(len(near)), min(edits, len(near))):
            near[at] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(near))
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_join_equals_all_pairs(rows, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "FOLLOWERS", 3)
    rng = random.Random(block)
    texts = [None, "", " \n\t", "one", "One", "one two", "a b c d", "A b c d", "a b c d e", "x " * 30, "x " * 31, "ä b c d", "Ä b c d"]
    for size, edits in ((40, 1), (60, 1), (100, 2), (120, 1), (300, 3)):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(base), *family(rng, base, 6, edits), " ".join(base[: size - 3]), " ".join(base + ["tail"])]
    chain = [f"c{i}" for i in range(80)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 20, 3)]  # each links with the next
    texts += texts[13:20]  # equal texts
    data = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    data += [(3, texts[20], None, None, None), (3, texts[20], None, None, None), (None, texts[20], None, None, None), (None, "nobody else has this", None, None, None)]
    got = ngrams.joined(rows(data, DOCS)).collect()
    assert len(got) == len(data)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == plain_components([(d, t) for d, t, *_ in data])
    assert [r["component_id"] for r in got if r["doc_id"] is None].count(None) == 1


def test_join_of_odd_tables(rows):
    assert ngrams.joined(rows([], DOCS)).collect() == []
    assert ngrams.joined(rows([(1, None, None, None, None)], DOCS)).collect() == [(1, 0, 1)]
    words = [f"w{i}" for i in range(60_000)]
    data = [(i, t, None, None, None, 1, 2, "k", 3) for i, t in enumerate([" ".join(words), " ".join(words[1:]), "short"])]
    assert sorted(map(tuple, ngrams.joined(rows(data, MORE)).collect())) == [(0, 59_997, 0), (1, 59_996, 0), (2, 1, 2)]


def test_rows_follow_documents(spark, rows, monkeypatch):
    """A large component among unlinked pages of its template: what is asked doesn't grow with the square."""
    monkeypatch.setattr(ngrams, "BLOCK", 16)
    asked = {}
    save = ngrams.Scratch.save

    def counting(self, df, name):
        out = save(self, df, name)
        if name in ("asked", "left", "open_roles"):
            asked[name] = out.count()
        return out

    monkeypatch.setattr(ngrams.Scratch, "save", counting)
    seen = []
    for m in (60, 120):
        rng = random.Random(m)
        base = [f"t{i}" for i in range(200)]
        pages = [base[:150] + [f"p{rng.randrange(10**7)}" for _ in range(50)] for _ in range(m)]
        texts = family(rng, base, m, 1) + [" ".join(p) for p in pages]
        asked.clear()
        got = ngrams.joined(rows([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)).collect()
        assert sorted(tuple(r) for r in got) == plain_components(list(enumerate(texts)))
        seen.append(dict(asked))
    for name in seen[0]:
        assert seen[1][name] <= 2.6 * seen[0][name] + 8, (name, seen)


def test_first_shingles_bound():
    for n in range(1, 400):
        index, probe = ngrams.prefix_sizes(n)
        for m in range(n, int(n / 0.85) + 1):
            need = next(c for c in range(n + 1) if ngrams.linked(c, n, m)) if ngrams.linked(n, n, m) else None
            if need is not None:
                assert index >= n - need + 1 and ngrams.prefix_sizes(m)[1] >= m - need + 1 and probe >= index


# -- centroids --------------------------------------------------------------------------


def plain_clusters(rows, dimensions, scale, k, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centers = [v for _, v in sorted(named)][:k]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (apart(v, centers[c]), c))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        for c, vs in groups.items():
            centers[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, nearest(v), apart(v, centers[nearest(v)])) for i, v in kept]
    own = collections.Counter()
    for _, c, d in found:
        own[c] += d
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in found]


def test_clusters_equal_plain(rows, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    monkeypatch.setattr(centroids, "LEAF", 4)
    rng = random.Random(3)
    hot = [0.25] * 6
    data = [(i, [rng.gauss(3 * (i % 3), 0.4) for _ in range(6)]) for i in range(150)] + [(i, hot) for i in range(150, 200)] + [(7, hot), (7, hot)]
    data += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, [math.nan] + [0.0] * 5), (906, [math.inf] * 6)]
    got = centroids.clusters(rows([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, cluster int"), dimensions=6, scale=8, k=5)
    assert sorted(map(tuple, got.collect())) == sorted(plain_clusters(data, 6, 8, 5, 3))


def test_clusters_of_odd_tables(rows):
    kind = "vec_id long, embedding array<float>"
    assert centroids.clusters(rows([], kind)).collect() == []
    one = centroids.clusters(rows([(5, [0.5] * 64), (None, [0.5] * 64), (6, [1e30] * 64)], kind)).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in sorted(one, key=str)] == [(5, 0, 0, 0), (None, 0, 0, 0)]


def test_pruning_keeps_owners(monkeypatch):
    monkeypatch.setattr(centroids, "LEAF", 4)
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (700, 3)).astype(np.int32)
    order, low, high, sums = centroids.grown(x)
    centers = rng.integers(-40, 40, (9, 3))
    whole, rows, of = centroids.assigned(x[order], low, high, centers)
    got = np.empty(len(x), int)
    for node, first, last, c in whole:
        got[first:last] = c
        assert (x[order][first:last].sum(0) == sums[node]).all()
    got[rows] = of
    assert (got == ((x[order].astype(int)[:, None] - centers) ** 2).sum(2).argmin(1)).all() and len(whole) > 20
    big = centers * (1 << 20)  # beyond what doubles hold exactly
    order, low, high, _ = centroids.grown(x * (1 << 20))
    whole, rows, of = centroids.assigned((x * (1 << 20))[order], low, high, big)
    assert (of == ((x[order[rows]].astype(int)[:, None] - centers) ** 2).sum(2).argmin(1)).all()


# -- divergence -------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least, ranks):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(brute.LOWER))) for text, lang, source in rows]
    holders, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, terms in docs:
        holders[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in holders[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (of, s), c in counts.items() if of == lang}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p = {s: share(c) for s, c in groups.items()}
        q = share({t: sum(c[t] for c in groups.values()) for t in kept})
        gap = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            parts = {"pair": [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s], "term": [(t, gap(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                for rank, (item, value) in enumerate(sorted(found, key=lambda f: (-f[1], f[0].encode())), 1):
                    if part == "pair" or rank <= ranks:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("leaves", [20, 1 << 18])
def test_audit_equals_plain(rows, monkeypatch, leaves):
    monkeypatch.setattr(divergence, "LEAVES", leaves)
    monkeypatch.setattr(divergence, "CHUNK", 64)
    rng = random.Random(leaves)
    stock = ["the", "The", "THE", "a", "an", "and", "Ärger", "ärger", "naïve", "naïf", "日本", "日", "é", "x1y", "don't", "×", "zz\x00top", "k\x7fk"]
    data = []
    for i in range(120):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "日"])
        data.append((" ".join(rng.choices(stock + [f"t{rng.randrange(9) * 'q'}"], k=rng.randrange(40))), lang, source))
    data += [(None, "fr", "s1"), ("", "fr", "s2"), ("12 34", "fr", None), ("solo", "it", "s1"), ("hot " * 5000, "en", "s1"), ("same words here", "en", "s2"), ("same words here", "en", "s2")]
    docs = rows([(t, lang, s, 1, "x") for t, lang, s in data], "text string, lang string, source string, g int, term string").repartition(5)
    assert sorted(map(tuple, divergence.audit(docs, 3, 4).collect())) == plain_audit(data, 3, 4)


def test_audit_of_odd_tables(rows, monkeypatch):
    kind = "text string, lang string, source string"
    assert divergence.audit(rows([], kind)).collect() == []
    assert divergence.audit(rows([(None, None, None)], kind)).collect() == []
    monkeypatch.setattr(divergence, "LONG", 64)
    long = ("Wort" * 50 + " ") * 300
    data = [(long, "de", "a"), (long, "de", "b"), ("wort" * 50, "de", "b")]
    assert sorted(map(tuple, divergence.audit(rows(data, kind)).collect())) == plain_audit(data, 3, 200)


def test_trie_walks_in_byte_order():
    rng = random.Random(9)
    terms = list({bytes(rng.choices(b"ab\xc3\xa4", k=rng.randrange(1, 7))) for _ in range(500)})
    trie = divergence.Trie()
    number = {t: trie.leaf(t) for t in terms}
    assert all(trie.leaf(t) == n for t, n in number.items()) and trie.leaves == len(terms)
    walked, leaves = trie.walk()
    assert walked == sorted(terms) and [number[t] for t in walked] == leaves


def test_shares_are_exact():
    counts = np.array([0, 5, 10**12, 9 * 10**14, 123456789012345])
    whole = 9 * 10**15
    assert divergence.shares(counts, np.array(whole)).tolist() == [1 + 10**9 * (int(c) + 1) // whole for c in counts]
