"""The pipeline's near-dedup stage against every pair of five-word shingle sets."""

import random

import brute
import corpus_pipeline
from modelwatch.llm import minhash

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(5)
    out = [None, "", "one", "One", "a b c d", "A b c d", "a b c d e", "a b c d e f", "a b c d f"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 100, 300]))]
        for changed in (0, 1, 1, 2, 5):
            near = list(base)
            for at in rng.sample(range(len(near)), min(changed, len(near))):
                near[at] = f"v{rng.randrange(400)}"
            out.append(" ".join(near))
    return out


def test_stage_takes_five_words(spark, rows):
    texts = _texts()
    docs = rows([(i, t, None, "s", None) for i, t in enumerate(texts)], TEXTS)
    two = {c for _, c in brute.components(list(enumerate(texts))).values()}
    want = brute.components(list(enumerate(texts)), 5)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert kept == {c for _, c in want.values()} and len(kept) > len(two)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 5).collect()}
    assert got == want
