"""Classifier, line rules, near-dedup, substring dedup and the pipeline against plain versions."""

import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from modelwatch.llm import lines, minhash, quality, substrings
from modelwatch.llm.words import span_hashes, words

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "one", "One", "a b", "ü é", "x" * 3000, "w " * 4000, "a\nb\na\n\n b", "\x85 non\xa0break", "ünï cödé #*| <tag>\nünï cödé #*| <tag>"]


def _frame(rows, texts, first=0):
    return rows([(first + i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(texts)], TEXTS)


def _vocabulary(rng, n):
    return ["".join(rng.choice("abcdefgü") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def _copies(seed, groups=12):
    """Texts with exact and near copies, chains of near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = _vocabulary(rng, 400)
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = make(90), list(ODD)
    for g in range(groups):
        base = make(rng.choice([3, 8, 60, 150]))
        for _ in range(rng.randint(1, 8)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  "]).join(near))
            if g % 3 == 0:
                base = near
        if g % 4 == 1:
            out += [" ".join(make(70) + passage + make(5)), " ".join(make(10) + passage[10:80])]
    rng.shuffle(out)
    return out


def test_words_and_hashes():
    texts = [*ODD, "the last one"]
    found = words(pa.array(texts, pa.string()))
    got = [[bytes(found.data[found.starts[k] : found.ends[k]]).decode() for k in range(a, b)] for a, b in itertools.pairwise(found.first.tolist())]
    assert got == [brute.words(t) for t in texts]
    hashed = dict(zip(itertools.chain(*got), found.hashes().tolist()))
    assert len(set(hashed.values())) == len(hashed)
    sliced = words(pa.array(["skip me", *texts], pa.string()).slice(1))
    assert np.array_equal(sliced.hashes(), found.hashes())
    assert len(words(pa.array([], pa.string())).starts) == 0
    x = np.arange(1, 50, dtype=np.uint64)
    assert len(set(span_hashes(np.tile(x, 2), np.array([3, 52]), np.array([9, 58])).tolist())) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(rows, seed, monkeypatch):
    if seed == 2:  # many cells even in small buckets
        monkeypatch.setattr(minhash, "BLOCK", 3)
        monkeypatch.setattr(minhash, "FOLLOWERS", 2)
    texts = _copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(_frame(rows, texts).repartition(5)).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute.components(list(enumerate(texts))).items()}


def test_near_duplicates_of_nothing_and_repeated_rows(rows):
    assert minhash.near_duplicates(_frame(rows, [])).count() == 0
    twice = _frame(rows, ["a b c d", "a b c d"]).unionByName(_frame(rows, ["a b c d", "z"])).unionByName(rows([(None, "a b c d", None, None, None)], TEXTS))
    got = sorted((tuple(r) for r in minhash.near_duplicates(twice).collect()), key=repr)
    assert got == sorted([(0, 3, 0, True), (1, 3, 0, False), (0, 3, 0, True), (1, 1, 1, True), (None, 3, 0, None)], key=repr)
    assert sorted((r["doc_id"], r["text"]) for r in minhash.deduplicated(twice.where("doc_id is not null")).collect()) == [(0, "a b c d"), (1, "z")]


def test_rows_that_share_an_id_link_nothing_by_it(rows):
    x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    four = rows([(0, x, None, None, None), (1, x + " more", None, None, None), (1, y, None, None, None), (2, y + " other", None, None, None)], TEXTS)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(four).collect())
    assert got == [(0, 59, 0, True), (1, 59, 1, True), (1, 60, 0, False), (2, 60, 1, False)]
    assert sorted((r["doc_id"], r["text"]) for r in minhash.deduplicated(four).collect()) == [(0, x), (1, y)]


def test_settled_documents_are_not_joined_again(rows, monkeypatch):
    """Texts and sketches of documents whose buckets the first stars settled go into no later step."""
    pairs = [f"{' '.join(f'p{i}w{k}' for k in range(60))} {end}" for i in range(20) for end in "xy"]
    texts, asked = pairs + _template(3, 40), []

    def seen(step):
        def run(labelled, representatives, own, *rest):
            asked.append((labelled.select("rep").distinct().count(), representatives.count(), own.count()))
            return step(labelled, representatives, own, *rest)

        return run

    for name in ("star_rounds", "cross_links"):
        monkeypatch.setattr(minhash, name, seen(getattr(minhash, name)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(_frame(rows, texts)).collect()}
    assert got == brute.components(list(enumerate(texts)))
    (reps, sketches, own), (later, *_) = asked
    assert 0 < later <= reps == sketches == own <= 40


def _template(seed, m, content=48, size=300):
    """Pages that share most of their words, so that no two are linked but for a few near copies."""
    rng = random.Random(seed)
    frame, out = [f"t{i}" for i in range(size - content)], []
    for i in range(m):
        own = [f"p{i}w{k}" for k in range(content)] if i % 10 else [f"p{i // 50}w{k}" for k in range(content - 4)] + [f"p{i}x{k}" for k in range(4)]
        out.append(" ".join(frame[:100] + own[:24] + frame[100:] + own[24:]))
    rng.shuffle(out)
    return out


def test_pages_of_a_template(rows, monkeypatch):
    """Buckets full of unlinked documents: all links are found, and rows grow as the documents do."""
    monkeypatch.setattr(minhash, "BLOCK", 24)
    monkeypatch.setattr(minhash, "FOLLOWERS", 8)
    made = {}
    save = minhash.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "save", counted)
    seen = []
    for m in (150, 300):
        texts = _template(m, m)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(_frame(rows, texts).repartition(3)).collect()}
        assert got == brute.components(list(enumerate(texts))) and len({c for _, c in got.values()}) < m
        seen.append(dict(made))
    assert seen[0]["wide"] > 0 and seen[1]["crowd"] == 300
    for name in ("dealt", "near", "tokens", "met", "pairs"):
        assert seen[1][name] <= 2.6 * max(seen[0][name], 150), (name, seen)


def _family(seed, m, linked=3):
    """Near copies of one page beside as many unlinked pages of its template, and a few documents that link with copies only."""
    rng = random.Random(seed)
    frame, own = [f"t{i}" for i in range(252)], [f"base{k}" for k in range(48)]
    page = lambda words: " ".join(frame[:100] + words[:24] + frame[100:] + words[24:])
    out = [page([w if k != i % 48 else f"c{i}" for k, w in enumerate(own)]) for i in range(m)]
    out += [page([f"p{i}w{k}" for k in range(48)]) for i in range(m)]
    out += [page(own[:20] + [f"l{i}w{k}" for k in range(28)]) for i in range(linked)]
    rng.shuffle(out)
    return out


def test_a_family_among_pages_of_its_template(rows, monkeypatch):
    """A component larger than a block beside unlinked pages of its template: rows grow as the documents do."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "ASKERS", 50)
    made, seen = {}, []
    save = minhash.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "save", counted)
    for m in (120, 240):
        made.clear()
        texts = _family(m, m)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(_frame(rows, texts).repartition(3)).collect()}
        assert got == brute.components(list(enumerate(texts)))
        assert max(sum(c == d for _, d in got.values()) for _, c in got.values()) >= m
        seen.append(dict(made))
    assert seen[0]["large"] == 1 and seen[0]["asks"] > 100 and "nodes1" in seen[0]
    for name in seen[1]:  # tables of a row a document at most may fill up
        assert seen[1][name] <= 2.6 * max(seen[0].get(name, 0), seen[0]["docs"]), (name, seen)


@pytest.mark.parametrize("stored", [40, 1 << 18])
def test_families_link_through_their_trees(rows, stored, monkeypatch):
    """Without stars of other centres, families meet one another and single documents; also where unions are too long to store."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "UNION", stored)
    monkeypatch.setattr(minhash, "ASKERS", 2)
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    texts = _copies(5, 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(_frame(rows, texts)).collect()}
    assert got == brute.components(list(enumerate(texts)))


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (1, 5, 40, 80)]
    index = minhash._Overlaps(sets)
    for s in [*sets, np.array([99], np.uint64)]:
        assert index.with_set(s).tolist() == [len(np.intersect1d(s, t)) for t in sets]


@pytest.mark.parametrize("n", range(1, 60))
def test_similar_sets_share_a_first_shingle(n):
    """The first elements of both sets, in any common order, have one in common wherever a link is possible."""
    for m in range(n, 5 * n // 4 + 1):
        for both in range(n + 1):
            if 9 * both >= 4 * (n + m):  # the worst order has what they don't share first
                index, probe = minhash.prefix_sizes(n)[0], minhash.prefix_sizes(m)[1]
                assert index > n - both and probe > m - both


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        off = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 700).astype(np.uint64)
            both = int(2 * 350 * share / (1 + share))
            a, b = np.unique(pool[:350]), np.unique(np.concatenate([pool[:both], pool[350 : 700 - both]]))
            r = minhash.registers([a, b])
            off.append(float(minhash.estimate((r[0] == r[1]).sum(), np.array(len(a)), np.array(len(b)))) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < minhash.MARGIN


@pytest.mark.parametrize("size", [3, 50])
def test_substrings(rows, size):
    texts = _copies(size)
    want = brute.removed(list(enumerate(texts)), size)
    got = sorted(tuple(r) for r in substrings.remove_repeats(_frame(rows, texts).repartition(6), size, digests=True).collect())
    assert got == sorted((d, n, k, brute.digest(kept)) for d, n, k, kept in want) and sum(w[2] for w in want) > 100
    whole = {r["doc_id"]: r for r in substrings.remove_repeats(_frame(rows, texts), size).collect()}
    for d, _, gone, kept in want:
        assert whole[d]["text"] == (" ".join(kept) if gone else texts[d])
        assert whole[d]["n_chars"] == (None if whole[d]["text"] is None else len(whole[d]["text"]))


def test_substrings_without_rows_and_with_equal_ids(rows):
    assert substrings.remove_repeats(_frame(rows, []), digests=True).count() == 0
    text = " ".join(map(str, range(80)))
    twice = rows([(1, text, None, None, None), (1, text, None, None, None), (2, text, None, None, None), (None, text, None, None, None)], TEXTS)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(twice, digests=True).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 0), (2, 80), (None, 0)], key=repr)


@pytest.mark.parametrize("listed", [substrings.LISTED, 0])
def test_substrings_of_crowded_anchors(rows, listed, monkeypatch):
    """A phrase amid other words, and a passage in every batch: dealt by window, and judged in bounded groups."""
    monkeypatch.setattr(substrings, "GROUP", 4)
    monkeypatch.setattr(substrings, "LISTED", listed)
    monkeypatch.setattr(substrings, "_BATCH", 500)
    rng = random.Random(9)
    vocabulary = _vocabulary(rng, 3000)
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    phrase, passage = make(12), make(30)
    texts = [" ".join(make(20) + (passage if i % 2 else phrase) + make(20)) for i in range(60)] + ["a " * 400, "b " * 300 + "a " * 50, " ".join(passage * 4)]
    rng.shuffle(texts)
    docs = _frame(rows, texts)
    counts = {r["anchor"]: r["n"] for r in substrings.anchor_counts(docs, 15).collect()}
    assert sum(counts.values()) == sum(max(0, len(t.split()) - 14) for t in texts) and sum(n > 4 for n in counts.values()) > 3
    want = sorted((d, n, k, brute.digest(kept)) for d, n, k, kept in brute.removed(list(enumerate(texts)), 15))
    assert sorted(tuple(r) for r in substrings.remove_repeats(docs.repartition(5), 15, digests=True).collect()) == want


def test_substrings_of_one_group_are_judged_in_bounded_memory(monkeypatch):
    """A window that every batch sends: the group holds the least one, whatever comes."""
    monkeypatch.setattr(substrings, "GROUP", 50)
    most = []
    schema = substrings.arrow_schema(substrings._ROW)
    ids = list(range(1, 4001))
    random.Random(3).shuffle(ids)
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 20), pa.array(ids[k : k + 20]), pa.array([0] * 20), pa.array([5] * 20, pa.int32()), pa.array([6] * 20, pa.int32()), pa.array([b"windowed"] * 20, pa.binary())], schema=schema) for k in range(0, 4000, 20)]

    class Frame:
        def mapInArrow(self, run, _):
            def watched():
                for b in batches:
                    most.append(pa.total_allocated_bytes())
                    yield b

            return list(run(watched()))

    out = substrings._decided(Frame())
    assert sorted(i for b in out for i in b.column("doc_id").to_pylist()) == list(range(2, 4001)) and len(out) > 20
    assert max(most[20:]) < 2 * max(most[:20])


def test_substrings_of_rows_that_share_an_id(rows):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "xyz")
    docs = rows([(0, one, None, None, None), (5, two + " " + one, None, None, None), (5, three, None, None, None), (5, one, None, None, None), (7, three + " " + two, None, None, None)], TEXTS)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs, digests=True).collect())
    assert got == [(0, 60, 0), (5, 60, 0), (5, 60, 60), (5, 120, 60), (7, 120, 120)]


def test_extra_columns_with_clashing_names(rows):
    from pyspark.sql import functions as F

    texts, labels = _labelled(rows, 24)
    names = ["_spans", "spans", "score", "label", "x", "key", "rep", "digest", "sketch", "begin", "until", "anchor", "kept", "comp", "cell", "n"]
    docs = _frame(rows, texts + texts[:3]).withColumns({n: F.lit(n) for n in names})
    for out in (substrings.remove_repeats(docs, 5), minhash.deduplicated(docs), quality.keep_good(docs, labels), lines.keep_content(docs, lines.train(docs, labels))):
        assert out.columns == docs.columns and out.count() > 0 and out.where("_spans <> '_spans' or kept <> 'kept'").count() == 0
    assert minhash.near_duplicates(docs).count() == 27 and quality.classify(docs, labels).count() == 27


def test_base_counts(rows):
    texts = _copies(4)
    field = lines.Field(np.zeros((2, lines.FEATURES)), np.zeros((2, 2)))
    for r in lines.judge(_frame(rows, texts), field).collect():
        n, *rest = brute.base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n) and r["kept"] != r["base_failed"] and r["content_words"] == n
    assert lines.judge(_frame(rows, []), field).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = rng.integers(1, 6, 4)
        first = np.concatenate([[0], np.cumsum(counts)])
        x = rng.normal(size=(first[-1], lines.FEATURES)).astype(np.float32)
        field = lines.Field(rng.normal(size=(2, lines.FEATURES)), rng.normal(size=(2, 2)))
        label = field.decode(x, first)
        for a, b in itertools.pairwise(first):
            unary = x[a:b].astype(float) @ field.weights.T
            score = lambda path: sum(unary[i, c] for i, c in enumerate(path)) + sum(field.transition[p, q] for p, q in itertools.pairwise(path))  # noqa: B023, E731
            assert tuple(label[a:b]) == max(itertools.product((0, 1), repeat=int(b - a)), key=score)


def test_field_learns_a_chain():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 12, 300)
    first = np.concatenate([[0], np.cumsum(counts)])
    y = rng.integers(0, 2, 300).repeat(counts)
    x = np.zeros((len(y), lines.FEATURES), np.float32)
    x[:, 0], x[:, 1] = 1, y + rng.normal(0, 0.8, len(y))
    field = lines.fit_field(x, y, first)
    assert (field.decode(x, first) == y).mean() > 0.9 and field.transition[0, 0] > field.transition[0, 1]


def _labelled(rows, n):
    rng = random.Random(n)
    vocabulary = _vocabulary(rng, 300)
    good = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20))).capitalize() + "." for _ in range(8))
    bad = lambda: "\n".join(" ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(10)) for _ in range(8))
    texts = [bad() if i % 4 == 0 else good() for i in range(n)]
    return texts, rows([(i, int(i % 4 != 0), 0) for i in range(n)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_classifier_and_rules(rows):
    texts, labels = _labelled(rows, 240)
    docs = _frame(rows, texts).unionByName(_frame(rows, ODD, 1000)).repartition(4)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 240 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [r for d, r in got.items() if r["held_out"] and d < 240]
    assert len(held) > 30 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {d for d, r in got.items() if r["predicted"]}
    field = lines.train(docs, labels)
    verdict = {r["doc_id"]: r for r in lines.judge(docs, field).collect()}
    assert np.mean([verdict[i]["kept"] == (i % 4 != 0) for i in range(240)]) > 0.95
    assert {r["doc_id"] for r in lines.keep_content(docs, field).collect()} == {d for d, r in verdict.items() if r["kept"]}


def _plain_space(texts, vocabulary):
    """Context sums and features, word by word."""
    hashes = {}
    for t in texts:
        found = words(pa.array([t], pa.string()))
        for w, h, f in zip(brute.words(t), *quality._both(found)):
            hashes[w] = (int(h), int(f))
    index = lambda h: dict_sum(zip(*(x[0].tolist() for x in quality.index_entries(np.array([h], np.uint64)))))

    def dict_sum(pairs):
        out = np.zeros(quality.DIMS)
        for d, s in pairs:
            out[d] += s
        return out

    known = [{int(h): i for i, h in enumerate(vocabulary.words)}, {int(h): i + len(vocabulary.words) for i, h in enumerate(vocabulary.forms)}]
    sums = np.zeros((len(vocabulary), quality.DIMS + 1))
    for t in texts:
        w = [hashes[x] for x in brute.words(t)]
        for i, pair in enumerate(w):
            for kind in (0, 1):
                if (at := known[kind].get(pair[kind])) is not None:
                    sums[at, -1] += 1
                    for k in (i - 1, i + 1):
                        if 0 <= k < len(w):
                            sums[at, :-1] += index(w[k][kind])
    vectors = np.concatenate([sums[:, :-1] / (sums[:, -1:] + quality.PRIOR), np.zeros((1, quality.DIMS))])
    features = []
    for t in texts:
        w, row = [hashes[x] for x in brute.words(t)], []
        if not w:
            features.append(np.zeros(quality.FEATURES))
            continue
        for kind in (0, 1):
            at = [known[kind].get(p[kind]) for p in w]
            have = [vectors[k] for k in at if k is not None]
            own = sum(index(p[kind]) for p in w) / len(w)
            repeats = sum(a[kind] == b[kind] for a, b in itertools.pairwise(w))
            row += [*(np.mean(have, 0) if have else np.zeros(quality.DIMS)), *own, repeats / len(w), at.count(None) / len(w), np.sqrt(own @ own)]
        features.append(np.array([*row, np.log1p(len(w))]))
    return sums, np.array(features)


def test_word_vectors_and_features(rows, monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK", 7)
    texts = [t or "" for t in _copies(11)[:40]]
    docs = _frame(rows, texts).repartition(3)
    vocabulary = quality.sample_vocabulary(_frame(rows, texts[:25]), (60, 5))
    counts = {}
    for t in texts[:25]:
        for h in words(pa.array([t], pa.string())).hashes().tolist():
            counts[h] = counts.get(h, 0) + 1
    ranked = sorted(counts, key=lambda h: (-counts[h], np.uint64(h).view(np.int64)))
    assert sorted(ranked[:60]) == vocabulary.words.tolist() and 1 < len(vocabulary.forms) <= 5
    sums = quality.context_sums(docs, vocabulary)
    want, features = _plain_space(texts, vocabulary)
    assert np.array_equal(sums, want) and sums[:, -1].min() > 0
    got = quality.pooled(pa.array(texts, pa.string()), quality.Space(vocabulary, quality.word_vectors(sums)))
    assert np.allclose(got, features, atol=1e-4)


def test_network_learns_and_its_temperature_is_the_best():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(np.int64)
    loss = lambda net, rows: float(np.mean(np.logaddexp(0, net.logits(x[rows]) / net.temperature) - y[rows] * net.logits(x[rows]) / net.temperature))
    order = np.random.default_rng(7).permutation(400)
    short, long = quality.fit(x, y, epochs=2), quality.fit(x, y, epochs=60)
    assert loss(long, order[80:]) < 0.7 * loss(short, order[80:])
    best = min(np.exp(np.linspace(np.log(0.25), np.log(8), 101)), key=lambda t: float(np.mean(np.logaddexp(0, long.logits(x[order[:80]]) / t) - y[order[:80]] * long.logits(x[order[:80]]) / t)))
    assert abs(best - long.temperature) < 1e-9


def test_classifier_without_labels(rows):
    none = rows([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.classify(_frame(rows, ["a b", None]), none).collect()] == [0.5, 0.5]
    assert quality.classify(_frame(rows, []), none).count() == 0
    assert lines.judge(_frame(rows, ["w%d " % i for i in range(2)]), lines.train(_frame(rows, []), none)).where("kept").count() == 0


def test_held_out_rows_do_not_train(rows):
    texts, labels = _labelled(rows, 40)
    chosen = quality.labelled_sample(_frame(rows, texts), labels, "quality", 1000)
    import zlib

    assert {r["doc_id"] for r in chosen.collect()} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert quality.labelled_sample(_frame(rows, texts), labels, "quality", 7).count() == 7


def test_pipeline(spark):
    """Each stage against a plain version of its step on the rows that the stage before kept."""
    import corpus_pipeline

    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    columns = out[0].columns
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    assert all(df.columns == columns for df in out[:-1])
    kept = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in out[:-1]]
    assert set(kept[0]) > set(kept[1]) > set(kept[2]) > set(kept[3]) == set(kept[4])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sum(labels[d] == 1 for d in set(kept[0]) - set(kept[1]) if d in labels) <= 2
    for d, text in kept[2].items():
        n, *_, again = brute.base_counts(text)
        assert n >= 50 and 100 * again <= 50 * n and text == kept[0][d]
    assert set(kept[3]) == {c for _, c in brute.components(list(kept[2].items()), 5).values()}
    want = {d: " ".join(words) if gone else kept[3][d] for d, _, gone, words in brute.removed(list(kept[3].items()), 50)}
    assert kept[4] == want
    pieces = out[-1].collect()
    assert {p["doc_id"] for p in pieces} == set(kept[4])
    full = {}
    for p in pieces:
        full[p["doc_id"]] = full.get(p["doc_id"], 0) + p["length"]
        assert p["length"] <= 4096
    assert all(full[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_pipeline_of_odd_rows(spark, rows, tmp_path):
    """Nulls in every column, repeated rows, a shared doc_id, very long texts, a text that loses all its words, and no rows at all."""
    import corpus_pipeline

    texts, labels = _labelled(rows, 60)
    rng = random.Random(6)
    words_of = sorted({w.strip(".").lower() for i, t in enumerate(texts) if i % 4 for w in t.split()})
    story = lambda n: "\n".join(" ".join(rng.choice(words_of) for _ in range(12)).capitalize() + "." for _ in range(n))
    long, part = story(2500), story(9)
    odd = [(None, texts[1], "en", "s", 5), (1, texts[1], "en", "s", None), (1, texts[1], "en", "s", None), (70, None, None, None, None), (71, "", None, None, 0), (72, long, "en", None, len(long)), (73, part, "en", "s", len(part)), (73, story(9), "en", "s", 1), (74, story(30) + "\n" + part, "en", "s", 1), (75, part + "\n" + story(60), "en", "s", 1)]
    docs = _frame(rows, texts).unionByName(rows(odd, TEXTS))
    for name, table in (("whole", docs), ("none", docs.limit(0))):
        table.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/whole")
    pieces = out.collect()
    kept = {p["doc_id"] for p in pieces}
    assert {72, 73, 74, 75, None} <= kept and not {70, 71} & kept and len([p for p in pieces if p["doc_id"] == 72]) > 2
    assert sum(p["start"] == 0 for p in pieces if p["doc_id"] == 73) == 2 and sum(p["start"] == 0 for p in pieces if p["doc_id"] == 1) == 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    gone = rows([(1, part, None, None, None), (2, " ".join(part.split()[5:80]), None, None, None)], TEXTS)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, gone, "").collect()}
    assert left == {1: part, 2: ""} and corpus_pipeline.packed(spark, rows([(2, "", None, None, None)], TEXTS), "").first()["doc_tokens"] == 1


@pytest.mark.parametrize("name", ["op1_warc", "op2_media", "op3_bpe", "op4_minhash", "op5_quality", "op6_packing", "op7_sharding", "op8_substrings", "op9_lines", "op10_chat"])
def test_query_runs_over_its_whole_table(spark, name):
    from modelwatch.llm import queries

    table = {"op1_warc": "pages", "op10_chat": None}.get(name, "documents")
    df = queries.queries()[name](spark, DATA)
    if table:
        assert df.select(df.columns[0]).distinct().count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    else:
        assert df.count() > 0
