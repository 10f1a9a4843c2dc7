"""The matcher on cases whose verdict follows from its rules, and on texts made so that the verdict is known."""

import random
import time

import pytest
from pyspark.sql import functions as F

from modelwatch.functions import matching
from modelwatch.operators import textfeat
from modelwatch.plans import catalogue

LEXICON = {"breath": ["short of breath", "breathless"], "chest": ["chest pain"], "faint": ["collapsed", "passed out"], "rash": ["rash"]}

#: text, categories by the first tier, by all three, and why.
CASES = [
    ("chest pain since noon", "chest", "chest", "verbatim"),
    ("CHEST PAIN", "chest", "chest", "case is lowered"),
    ("chest, pain", "", "", "a phrase lies in one clause"),
    ("chest paaain", "", "chest", "runs collapse in the second tier"),
    ("pain in the chest", "", "chest", "the third tier asks no order, only each word"),
    ("chest", "", "", "each word of the phrase must be there"),
    ("breathles", "", "breath", "six letters shared: a truncation"),
    ("braethless", "", "", "only two letters shared, so neither a truncation nor an edit"),
    ("brexthless", "", "breath", "three letters shared and one edit"),
    ("brexthlesx", "", "", "two edits"),
    ("rush", "", "", "words under five letters are taken as they are"),
    ("crash", "rash", "rash", "the first tier looks for characters, not words"),
    ("no chest pain", "", "", "a cue right before"),
    ("no sign of chest pain", "", "", "the cue is the third token before"),
    ("no sign at all of chest pain", "chest", "chest", "the cue is the fifth token before: out of sight"),
    ("no fever and chest pain", "chest", "chest", "nothing before a conjunction counts"),
    ("no fever but chest pain", "chest", "chest", "the other conjunction"),
    ("no and chest pain", "chest", "chest", "the cue lies before the conjunction"),
    ("doesn't have chest pain", "", "", "tokens that end in n't are cues"),
    ("can't stop chest pain", "chest", "chest", "the last token stops the denial"),
    ("never had chest pain like this", "chest", "chest", "never with a comparison is no denial"),
    ("never had chest pain", "", "", "never alone is one"),
    ("this bad, never had chest pain", "", "", "the comparison is in another clause"),
    ("before that never had chest pain", "", "", "the comparison must follow the phrase"),
    ("no chest pain like this", "", "", "a comparison lifts never, not no"),
    ("no chest pain yesterday then chest pain", "chest", "chest", "one place that isn't denied is enough"),
    ("no chest pain. chest pain", "chest", "chest", "one clause that isn't denied is enough"),
    ("no rash rash", "", "", "both places have the cue among three tokens"),
    ("no rash a b c rash", "rash", "rash", "the later place is too far from the cue"),
    ("not crash", "", "", "the piece of a word before a place is a token, and the cue is still near"),
    ("snot rash", "rash", "rash", "a cue must be a whole token"),
    ("n't rash", "", "", "n't itself"),
    ("collapsed", "faint", "faint", "verbatim"),
    ("colapsed", "", "faint", "collapsed on both sides these are equal"),
    ("out and passed", "", "faint", "words apart, in any order"),
    ("no passed way out", "", "", "the first word of the phrase is denied"),
    ("passed no out", "", "faint", "a cue before another word of the phrase is none"),
    ("short breath of", "", "breath", "all three words"),
    ("", "", "", "nothing"),
    ("  .;  ", "", "", "blank clauses"),
    (None, "", "", "null"),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, text string")
    for tiers, at in ((1, 1), (3, 2)):
        got = {r["id"]: ",".join(r["flags"]) for r in textfeat.category_flags(docs, LEXICON, tiers=tiers).collect()}
        wrong = [(c[0], got[i], c[at], c[3]) for i, c in enumerate(CASES) if got[i] != c[at]]
        assert not wrong, (tiers, wrong)


def test_edits_made_by_hand(spark):
    """Words are spoilt on purpose, so whether they still count is known from how."""
    rng = random.Random(8)
    word, data = "tachycardia", []
    for k in range(len(word)):
        for letter in "qz":
            data += [(word[:k] + letter + word[k + 1 :], k >= 3), (word[:k] + letter + word[k:], k >= 3)]
        data.append((word[:k] + word[k + 1 :], k >= 3))
        far = list(word)
        for at in rng.sample(range(3, 6), 2):
            far[at] = "q"
        data.append(("".join(far), False))
    data += [(word[:n], n >= 6) for n in range(1, len(word))] + [(word[:6] + "qqqqqq", True), ("tachy", False)]
    # Where a letter repeats, taking one of the two away at the edge of the first three leaves them as they are.
    rows = spark.createDataFrame([(t, w) for t, w in data], "t string, w boolean")
    got = rows.select("t", "w", matching.same_word(F.lit(word), F.col("t"), ["tachycardic"]).alias("s")).collect()
    assert [r["t"] for r in got if r["w"] != r["s"]] == []
    known = spark.createDataFrame([("tachycardic",)], "t string").select(matching.same_word(F.lit(word), F.col("t"), ["tachycardic"])).first()[0]
    assert known is False  # another keyword's token is never a typo


def test_long_clauses(spark):
    """One clause of 100,000 words, each third one a denied phrase: read in one walk."""
    began = time.time()
    many = "no rash here " * 33_333
    docs = spark.createDataFrame([(0, many), (1, many + "a b c rash"), (2, "r" * 300_000 + "ash"), (3, "rash" * 50_000), (4, "no " + "rash" * 50_000)], "id long, text string")
    got = {r["id"]: r["flags"] for r in textfeat.category_flags(docs, {"rash": ["rash"]}, tiers=1).collect()}
    assert got == {0: [], 1: ["rash"], 2: ["rash"], 3: ["rash"], 4: []}
    assert time.time() - began < 90


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    texts = ["the station was full", "the sta-tionn wass full", "not the station was full", "three plain words", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_queries_over_documents(spark, folder):
    run = lambda name: catalogue.queries()[name](spark, folder).collect()
    flags = {r["doc_id"]: r["flags"] for r in run("fuzzy_document_flags")}
    assert flags == {0: "motion", 1: "motion", 2: "", 3: "", 4: "", 5: ""}
    assert run("fuzzy_coverage_rate")[0][0] == pytest.approx(4 / 6, abs=1e-4)
    got = {r["doc_id"]: (r["symptom_count"], r["uncovered"]) for r in run("fuzzy_text_features")}
    assert got == {0: (1 / 6, False), 1: (1 / 6, False), 2: (0.0, True), 3: (0.0, True), 4: (0.0, False), 5: (0.0, False)}
    assert {r["doc_id"]: r["flags"] for r in run("keyword_flags")} == flags | {1: ""}
