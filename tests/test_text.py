import pytest

from modelwatch.operators import redaction, textfeat

LEXICON = {
    "chest pain": ("chest pain", "crushing chest"),
    "breathless": ("shortness of breath", "breathless"),
    "fever": ("fever", "high temperature"),
    "cough": ("cough", "coughing"),
    "sore throat": ("sore throat", "scratchy throat"),
    "stroke": ("confusion",),
    "bruise": ("contusion",),
    "rash": ("rash",),
}


def flags(rows, text, tiers=3):
    return textfeat.category_flags(rows([(text,)], "text string"), LEXICON, tiers=tiers).first()["flags"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("severe crushing chest pain and shortness of breath", ["breathless", "chest pain"]),
        ("no fever, but severe chest pain", ["chest pain"]),
        ("no fever and a dry cough", ["cough"]),
        ("not improving and scratchy throat", ["sore throat"]),
        ("no fever or cough", []),
        ("I can't stop coughing", ["cough"]),
        ("never had chest pain like this before", ["chest pain"]),
        ("never had chest pain", []),
        ("I don't have a fever", []),
        ("feverr and coughh", ["cough", "fever"]),
        ("chest paiin", ["chest pain"]),
        ("shortnes of breathh", ["breathless"]),
        ("breathles today", ["breathless"]),
        ("confusion", ["stroke"]),
        ("contusin on my arm", ["bruise"]),
        ("never lives on a couch", []),
        ("", []),
        (None, []),
        ("...!?", []),
    ],
)
def test_flags(rows, text, expected):
    assert flags(rows, text) == expected


def test_tiers(rows):
    assert flags(rows, "feverr paiin", 1) == ["fever"] and flags(rows, "ffever", 1) == ["fever"] and flags(rows, "feeever", 1) == [] and flags(rows, "feeever", 2) == ["fever"]


def test_coverage(rows):
    df = rows([("bad fever today",)] + [("xqz wvu plm kjh",)] * 3, "text string")
    flagged = textfeat.category_flags(df, LEXICON)
    assert textfeat.coverage_rate(flagged).first()["zero_coverage_rate"] == 0.75
    assert textfeat.coverage_rate(flagged.limit(0)).first()["zero_coverage_rate"] == 0.0
    short = textfeat.category_flags(rows([("hi",), ("a b c d",), (" ",)], "text string"), LEXICON)
    assert [r[0] for r in short.select(textfeat.uncovered(short["text"], short["flags"])).collect()] == [False, True, False]


def test_vector_round_trip(rows):
    df = rows([("bad fever", "65+", "Female"), (None, "??", None)], "text string, age string, sex string")
    out = textfeat.features(textfeat.category_flags(df, LEXICON), age="age", sex="sex")
    vec = textfeat.vector(out, list(LEXICON))
    got = vec.select("x", textfeat.vector_valid(vec["x"], len(LEXICON)).alias("ok"), textfeat.group_of_vector(vec["x"], len(LEXICON)).alias("g")).collect()
    assert [(r["ok"], r["g"]) for r in got] == [(True, "65+ · Female"), (True, "40-64 · Male")]
    assert got[0]["x"] == [0, 0, 1, 0, 0, 0, 0, 0, 1 / 6, 9 / 400, 0, 0, 0, 1, 1]


@pytest.mark.parametrize(
    ("text", "masked", "kinds"),
    [
        ("blood pressure 140 90 110 70", "blood pressure 140 90 110 70", []),
        ("pain since 12-05-2026", "pain since 12-05-2026", []),
        ("call 91234567", "call [REDACTED_PHONE]", ["PHONE"]),
        ("call +65 9123 4567 now", "call [REDACTED_PHONE] now", ["PHONE"]),
        ("mrn 123456789012", "mrn [REDACTED_MRN]", ["MRN"]),
        ("id s1234567d mail a.b@c.org", "id [REDACTED_NRIC] mail [REDACTED_EMAIL]", ["NRIC", "EMAIL"]),
        ("", "", []),
        ("write é.ü@exämple.org!", "write [REDACTED_EMAIL]!", ["EMAIL"]),
        ("file ٣٣٣٣٣٣٣٣٣ here", "file [REDACTED_MRN] here", ["MRN"]),
        ("call +٦٥ ٩١٢٣ ٤٥٦٧", "call [REDACTED_PHONE]", ["PHONE"]),
        ("ring 9123\u00a04567 now", "ring [REDACTED_PHONE] now", ["PHONE"]),
        ("éS1234567A and S1234567Aé", "éS1234567A and S1234567Aé", []),
        ("ø12345678", "ø12345678", []),
        ("-a.b@c.de-", "-[REDACTED_EMAIL]-", ["EMAIL"]),
        ("s1234567a 91234567 91234568 1234567", "[REDACTED_NRIC] [REDACTED_PHONE] [REDACTED_PHONE] [REDACTED_MRN]", ["NRIC", "PHONE", "MRN"]),
    ],
)
def test_redaction(rows, text, masked, kinds):
    out = redaction.redact(rows([(text,)], "text string")).first()
    assert (out["masked"], out["kinds"]) == (masked, kinds)


def test_spans(rows):
    df = rows([("call Ann or Bob", [(5, 8, "PERSON"), (12, 15, "PERSON")])], "t string, s array<struct<start:int,end:int,label:string>>")
    assert df.select(redaction.mask_spans(df["t"], df["s"]).alias("m")).first()["m"] == "call [PERSON] or [PERSON]"


def test_json_leaves_and_scan(rows):
    docs = rows(
        [("a.json", '{"caseId": "case_69837191d0", "notes": ["call 91234567", {"x": "fine"}], "n": 12345678}'), ("b.json", "{broken\nmail a@b.org"), ("c.jsonl", '{"id": "S1234567D"}\n{"t": "ok"}\nmail d@e.org'), ("d.txt", "ok"), ("e.json", '{"a": 1}\nmail f@g.org')],
        "name string, body string",
    )
    found = sorted((r["name"], r["line"], r["field"], r["kind"]) for r in redaction.scan_documents(docs).collect())
    assert found == [("a.json", 0, "notes", "PHONE"), ("b.json", 2, None, "EMAIL"), ("c.jsonl", 1, "id", "NRIC"), ("c.jsonl", 3, None, "EMAIL"), ("e.json", 2, None, "EMAIL")]
    gate = redaction.egress_gate(redaction.scan_documents(docs), rows([("a.json",), ("z.json",)], "name string"), docs).first()
    assert (gate["verdict"], gate["findings"], gate["skipped"]) == ("FAIL", 5, "z.json")


def test_machine_tokens_of_versions(rows):
    df = rows([("rf-0123456789ab",), ("rf-0123456789ab (a, b)",), ("john-smith-0123456789ab",), ("2024-01-02T03:04:05Z",), ("case_12345678",)], "v string")
    got = [tuple(r) for r in df.select(redaction.machine_token(df["v"]), redaction.machine_token(df["v"], prefixes=("rf",))).collect()]
    assert got == [(False, True), (False, True), (False, False), (True, True), (True, True)]


def test_synthetic_texts(spark):
    """Every text, word by word, from the draws that its number gives."""
    import hashlib

    from modelwatch.plans.catalogue import PHRASES, PROFILES
    from modelwatch.sources import synth

    def u(i, purpose, *more):
        return int(hashlib.md5(":".join(map(str, (42, purpose, i, *more))).encode()).hexdigest()[:7], 16) / (1 << 28)

    def pick(xs, x):
        return xs[int(x * len(xs))]

    for shift in (False, True):
        prior = synth.SHIFTED if shift else synth.PRIOR
        for r in synth.cases(spark, 400, PROFILES, PHRASES, shift=shift).collect():
            i, base = r["id"], 0
            while base < 4 and u(r["id"], "class") >= round(sum(prior[: base + 1]), 10):
                base += 1
            chosen = list(pick(PROFILES[base], u(i, "combo")))
            if u(i, "extra") < (0.30 if shift else 0.15):
                chosen.append(pick(sorted({c for k in (base - 1, base, base + 1) for combo in PROFILES.get(k, []) for c in combo}), u(i, "distractor")))
            text = "not feeling well" if u(i, "vague") < 0.08 else " and ".join(_phrase(i, k, PHRASES[c]) for k, c in enumerate(chosen))
            assert r["text"] == text
            assert r["y"] == (base - 1 if r["band"] == "65+" and base in (2, 3) and u(i, "escalate") < 0.85 else base)


def _phrase(i, k, phrases):
    import hashlib

    return phrases[int(int(hashlib.md5(f"42:phrase:{i}:{k}".encode()).hexdigest()[:7], 16) / (1 << 28) * len(phrases))]
