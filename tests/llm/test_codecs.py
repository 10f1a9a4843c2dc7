"""WARC, media, BPE, packing, sharding and chat against plain versions."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modelwatch.llm import bpe, chat, media, packing, sharding, warc
from modelwatch.llm.shared import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
TEXTS = "doc_id long, text string, lang string, source string"
SAMPLE = [(1, "Hello  world\n it's 12 o'clock"), (2, None), (3, ""), (4, "ü" * 5000 + " x" * 3000), (5, "Hello  world\n it's 12 o'clock"), (6, " \t\n "), (7, "a<|endoftext|>b 😀́ \x1c x")]


@pytest.fixture
def documents(rows):
    return rows([(i, t, None, "s") for i, t in SAMPLE], TEXTS)


def test_archive_round_trip(spark, rows):
    html = "<p>" + "x" * 500
    pages = rows([(5, "u", html), (2, None, html), (9, "u 1\n", None), (8, "", ""), (3, "ü", "other"), (2, "again", html), (None, "n", html)], "page_id long, url string, html string").withColumnRenamed("x", "y")
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    manifest = scratch.save(warc.write_archives(pages, folder), "manifest")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest, folder).collect()), key=repr)
    d = lambda t: warc.sha1_label(t.encode())
    n = len(html)
    want = [(2, n, d(html), "response", None)] * 2 + [(5, n, d(html), "revisit", 2), (None, n, d(html), "revisit", 2), (3, 5, d("other"), "response", None), (8, 0, d(""), "response", None), (9, 0, d(""), "revisit", 8)]
    assert got == sorted(want, key=repr)
    assert warc.read_archives(scratch.save(warc.write_archives(pages.limit(0), folder), "none"), folder).count() == 0
    big = scratch.save(warc.write_archives(pages, folder, min_bytes=n + 1), "big")
    assert warc.read_archives(big, folder).where("record_type = 'revisit'").count() == 0


def test_archive_damage():
    good = b"".join(warc.page_record(i, "u", b"payload %d" % i, None, False) for i in range(3))
    assert [r.http()[1] for r in warc.read_records(io.BytesIO(good), 7)] == [b"payload 0", b"payload 1", b"payload 2"]
    with pytest.raises(warc.WarcError, match="cut off"):
        list(warc.read_records(io.BytesIO(good[:-3])))
    raw = zlib.decompress(warc.page_record(1, "u", b"abc", None, False), 31)
    for bad, why in ((raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"), "digest"), (raw + b"x", "content length"), (b"x" + raw, "record header")):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError, match=why):
            list(warc.read_records(io.BytesIO(z.compress(bad) + z.flush())))


def test_reader_is_bounded_by_the_content_length():
    """What follows a record in its member is not inflated, however much it is."""
    raw = zlib.decompress(warc.page_record(1, "u", b"abc", None, False), 31)
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = z.compress(raw) + b"".join(z.compress(bytes(1 << 20)) for _ in range(64)) + z.flush()
    import tracemalloc

    tracemalloc.start()
    with pytest.raises(warc.WarcError, match="content length"):
        list(warc.read_records(io.BytesIO(bomb)))
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    for head in (b"WARC/1.1\r\nContent-Length: -5\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n"):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError, match="content length"):
            list(warc.read_records(io.BytesIO(z.compress(head) + z.flush())))


def test_folders_of_archives(spark, tmp_path):
    from modelwatch.llm import shared

    assert shared.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and shared.shared_dir(spark).startswith("file:")
    where, path = warc._open(shared.qualified(spark, f"file://{tmp_path}/a"))
    assert path == f"{tmp_path}/a" and where.type_name == "local"
    for bad in (str(tmp_path), "viewfs://store/x", "nosuch://x/y"):
        with pytest.raises(ValueError, match="scheme|can't be written"):
            warc._open(bad)


def test_revisits_are_held_against_their_responses(rows):
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 3, "A", "response", None), (2, 3, "A", "revisit", 1), (3, 3, "A", "revisit", 1), (None, 0, "B", "response", None), (None, 0, "B", "revisit", None)]
    assert warc.dangling_revisits(rows(good, kind)).count() == 0
    bad = [(4, 3, "C", "revisit", 1), (5, 4, "A", "revisit", 1), (6, 3, "A", "revisit", 9), (7, 3, "A", "revisit", 9)]
    assert warc.dangling_revisits(rows(good + bad, kind)).count() == 3


def test_pages_with_more_columns(spark, rows):
    from pyspark.sql import functions as F

    pages = rows([(1, "u", "<p>"), (2, "u", "<p>"), (2, "u", "<p>")], "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("same", "first", "n", "size", "revisit", "path")})
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    manifest = scratch.save(warc.write_archives(pages, folder), "manifest")
    assert sorted(r["record_type"] for r in warc.read_archives(manifest, folder).collect()) == ["response", "revisit", "revisit"]
    scratch.close()
    import os

    assert not os.path.exists(folder.removeprefix("file:"))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.integers(0, 70_000).map(lambda n: bytes(i * 7 & 255 for i in range(n)))))
def test_stream_round_trip(raw):
    s = media.demux(m := media.mux(raw))
    assert s.payload == raw and s.counter_errors == 0 and len(m) % 188 == 0
    units = max(1, -(-len(raw) // media.UNIT))
    assert len(s.timestamps) == units and len(s.access_points) == -(-units // media.UNITS_PER_POINT)


def test_stream_damage():
    m = bytearray(media.mux(bytes(5000)))
    lost = bytes(m[: 188 * 5] + m[188 * 6 :])
    with pytest.raises(media.MediaError, match="incomplete"):
        media.demux(lost)
    with pytest.raises(media.MediaError, match="sync"):
        media.demux(b"x" + bytes(m[1:]))
    m[20] ^= 1
    with pytest.raises(media.MediaError, match="table"):
        media.demux(bytes(m))
    two = bytearray(media.mux(bytes(i * 7 & 255 for i in range(5000))))  # packets that differ: an equal one may come twice
    two[188 * 4 + 3] ^= 3
    assert media.demux(bytes(two)).counter_errors == 2


def _without_payload(packet):
    """A packet of the same stream and counter that has an adaptation field only."""
    return packet[:3] + bytes([0x20 | packet[3] & 15, 183, 0]) + b"\xff" * 182


def test_streams_as_others_write_them():
    """Packets that come twice or without a payload, a marked discontinuity, tables over several packets, several programs."""
    raw = bytes(i * 11 & 255 for i in range(40_000))
    m = media.mux(raw)
    packets = [m[k : k + 188] for k in range(0, len(m), 188)]
    odd = [q for i, p in enumerate(packets) for q in ([p, p] if i % 7 == 3 else [p, _without_payload(p)] if i % 7 == 5 and p[1] & 0x1F else [p])]
    s = media.demux(b"".join(odd))
    assert s.payload == raw and s.counter_errors == 0 and s.packets == len(odd) > len(packets)
    thrice = packets[:5] + [packets[4]] * 2 + packets[5:]
    with pytest.raises(media.MediaError, match="incomplete"):
        media.demux(b"".join(thrice))
    streams = [(0x1B, 0x200 + k) for k in range(60)] + [(0x06, 0x100)]
    body = (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x03\x0a\x01e" for kind, pid in streams)
    mapped, pieces = b"\0" + media._section(0x02, 2, body), []
    for k in range(0, len(mapped), 184):
        pieces.append((bytes([0x47, 0x40 * (k == 0) | 0x11, 0, 0x10 | k // 184 & 15]) + mapped[k : k + 184]).ljust(188, b"\xff"))
    listed = media._table_packet(0, media._section(0, 1, b"\0\0\xe0\x10" + (1).to_bytes(2, "big") + (0xE000 | media.MAP_PID).to_bytes(2, "big") + (2).to_bytes(2, "big") + (0xE000 | 0x1100).to_bytes(2, "big"))).tobytes()
    several = listed + b"".join(pieces) + b"".join(packets[1:])
    array = np.frombuffer(several, np.uint8).reshape(-1, 188)
    found = dict(media.programs(array, (array[:, 1] & 0x1F).astype(int) << 8 | array[:, 2]))
    assert found == {1: [(media.STREAM_TYPE, 0x100)], 2: streams} and len(pieces) > 2
    assert media.demux(several).program == 1 and media.demux(several, program=2, pid=0x100).payload == raw
    with pytest.raises(media.MediaError, match="no packets"):
        media.demux(several, program=2, pid=0x200)
    with pytest.raises(media.MediaError, match="no table"):
        media.demux(several, program=9)


def test_media_without_a_cell_and_with_more_columns(rows):
    from pyspark.sql import functions as F

    docs = rows([(1, "a", None, "s"), (1, "a", None, "s"), (None, None, None, None)], TEXTS).withColumns({c: F.lit("z") for c in ("media", "n_bytes", "payload", "feature")})
    cells = media.encode_media(docs)
    assert cells.count() == 3
    none = cells.withColumns({"media": F.when(F.col("doc_id").isNull(), F.col("media")), "feature": F.lit(1)})
    for only in (True, False):
        got = media.decode_media(none, digest_only=only).collect()
        assert [r["feature"] is None for r in got] == [r["doc_id"] is not None for r in got] and len(got) == 3
        assert all(r["timestamps"] == [0] and r["access_points"][0]["pts"] == 0 for r in got if r["doc_id"] is None)


def test_media_columns(documents):
    got = {r["doc_id"]: r for r in media.decode_media(media.encode_media(documents), digest_only=True).collect()}
    for i, t in SAMPLE:
        raw = (t or "").encode()
        p = media.padded(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(p) % 64 == 0 and len(p) > 0
    assert got[1]["feature"] == got[5]["feature"] and got[2]["media_sha256"] == got[3]["media_sha256"]
    wide = {r["doc_id"]: r for r in media.decode_media(media.encode_media(documents)).collect()}
    assert bytes(wide[4]["payload"]) == media.padded(SAMPLE[3][1].encode()) and wide[4]["access_points"][0]["offset"] == 0
    assert media.decode_media(media.encode_media(documents.limit(0)), digest_only=True).count() == 0


def _odd_texts(n):
    rng = random.Random(5)
    out = ["".join(rng.choice(" \n\t'sabéñ<>|!12  \x1c中😀́ſKΣ") for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_library(path):
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path)
    texts = [t or "" for _, t in SAMPLE] + _odd_texts(400) + ["aaaaaaa aaaa", "don't we'll 's", "x<|endoftext|> y", "\x00\x01", "՘a՘!"]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = own.encode(texts)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [w.ids for w in want]
    if path == BYTES:
        assert [own.decode(w.ids) for w in want] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_unassigned_characters_go_through_the_index(path, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path)
    merged = []
    merge = bpe.PairIndex.merge
    monkeypatch.setattr(bpe.PairIndex, "merge", lambda self, symbols, first: merged.append(len(first) - 1) or merge(self, symbols, first))
    rng = random.Random(8)
    odd = [c for c in map(chr, range(0x300, 0x1FFFF)) if bpe.unicodedata.category(c) == "Cn"]
    texts = ["".join(rng.choice([rng.choice(odd), "Hello", " ", "é", "\n", "12", "<|endoftext|>"]) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    texts += ["\uffff", "a\U0003ffffb", "x" * 50 + odd[0] + " tail"]
    assert [np.frombuffer(g, np.uint32).tolist() for g in own.encode(texts)] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(merged) > 300 and not hasattr(own, "by_library")


def test_tokens_with_more_columns(rows):
    from pyspark.sql import functions as F

    docs = rows([(1, "a b", None, "s"), (1, "a b", None, "s"), (None, None, None, None)], TEXTS).withColumns({c: F.lit("z") for c in ("ids", "n_tokens", "start", "length", "sequence_id", "offset")})
    tokens = bpe.encode(docs, BYTES)
    assert sorted((r["text"], r["doc_id"]) for r in bpe.decode(tokens.withColumn("text", F.lit(1)), BYTES).collect() if r["doc_id"]) == [("a b", 1)] * 2
    none = tokens.withColumn("ids", F.when(F.col("doc_id") == 1, F.col("ids")))
    assert {r["text"] for r in bpe.decode(none, BYTES).where("doc_id is null").collect()} == {""}
    assert packing.pack(docs, WORDS).count() == 3


def test_padding_of_many_small_partitions(rows):
    """Each partition leaves about one window part empty, and no more."""
    rng = random.Random(2)
    docs = rows([(i, "word " * rng.randint(1, 60), None, "s") for i in range(600)], TEXTS)
    for parts in (1, 12):
        got = packing.pack(docs.repartition(parts), WORDS, window=64).collect()
        used, sequences = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
        assert sequences * 64 - used <= 64 * (parts + 0.05 * sequences)


def test_known_pretokens_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    own = bpe.Bpe(BYTES)
    for k in range(5):
        own.encode([f"word{chr(97 + i % 26)}{i} " * 2 for i in range(k * 40, k * 40 + 40)])
    assert len(own.known) < 400 and own.decode(np.frombuffer(own.encode(["a b"])[0], np.uint32).tolist()) == "a b"


def test_bpe_query(documents):
    tokens = bpe.encode(documents, BYTES)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(tokens, BYTES).collect()}
    assert back == {i: t or "" for i, t in SAMPLE}
    row = {r["doc_id"]: r for r in bpe.decode(tokens, BYTES, digests=True).collect()}[1]
    ids = {r["doc_id"]: r["ids"] for r in tokens.collect()}[1]
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.decode(bpe.encode(documents.limit(0), BYTES), BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    size = np.array(lengths, np.int64)
    window, offset, n = packing.best_fit_decreasing(size, 32)
    rooms, plain = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [i for i, room in enumerate(rooms) if room >= lengths[k]]
        if not fits:
            rooms.append(32)
            fits = [len(rooms) - 1]
        i = min(fits, key=lambda i: rooms[i])
        rooms[i] -= lengths[k]
        plain.setdefault(i, 0)
    assert n == len(rooms)
    for w in range(n):
        own = sorted((int(offset[k]), lengths[k]) for k in range(len(lengths)) if window[k] == w)
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([x for _, x in own])])[:-1].tolist() and sum(x for _, x in own) <= 32


def test_packing(documents):
    tokens = {i: len(bpe.Bpe(WORDS).encode([t or ""])[0]) // 4 + 1 for i, t in SAMPLE}
    got = packing.pack(documents, WORDS, window=64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], np.uint32).tobytes()) and r["length"] == len(r["ids"])
    for i, n in tokens.items():
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == list(range(0, n, 64)) and sum(p["length"] for p in pieces) == n and pieces[-1]["ids"][-1] == 2
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert packing.pack(documents.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 40, 1000])
def test_sharding(spark, rows, n):
    rng = random.Random(n)
    docs = rows([(i // 2 if i % 10 == 0 else i, None if i % 7 == 0 else "x" * rng.randint(0, 300), None) for i in range(n)], "doc_id long, text string, size string").repartition(5)
    got = sorted(sharding.assign_shards(sharding.sized(docs), 8).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert len(got) == n
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    total, largest = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for k in range(8):
        own = [r for r in got if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= largest
    assert all(r["text_crc32"] == zlib.crc32(b"x" * (r["size"] - 16)) for r in got)


def test_chat(rows):
    conv = lambda i, turns: [(i, k, r, t) for k, (r, t) in enumerate(turns)]
    a = [("user", "hi"), ("assistant", "yes")]
    data = conv(1, a[:1]) + conv(2, a) + conv(3, a + [("user", None)]) + conv(4, a) + conv(5, [("user", "ho")]) + conv(7, [("user", "ho")]) + conv(6, [("us", "erhi")]) + [(None, 0, "user", "x")]
    df = rows(data, "conv_id long, turn int, role string, text string").repartition(3)
    got = {r["conv_id"]: (r["n_copies"], r["rendered"]) for r in chat.render(chat.maximal_conversations(df)).collect()}
    assert got == {3: (1, "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\n\n"), 5: (2, "<|user|>\nho\n"), 6: (1, "<|us|>\nerhi\n")}
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_chat_with_more_columns_and_repeats(rows):
    from pyspark.sql import functions as F

    data = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, None, None, None), (4, 0, "user", "<|x|>")]
    df = rows(data, "conv_id long, turn int, role string, text string").withColumns({c: F.lit("z") for c in ("turns", "prefixes", "whole", "n_copies", "rendered")})
    got = {r["conv_id"]: r["rendered"] for r in chat.render(chat.maximal_conversations(df)).collect()}
    assert got == {1: "<|user|>\na\n" * 2, 3: "<||>\n\n", 4: "<|user|>\n<|x|>\n"}  # 2 is a prefix of 1
    safe = {r["conv_id"]: r["rendered"] for r in chat.render(chat.maximal_conversations(df), escape="\\").collect()}
    assert safe[4] == "<|user|>\n<|\\x|>\n" and safe[1] == got[1]


def test_sharding_of_a_hot_row(rows):
    """Equal rows in one partition: slots and shares hold."""
    docs = rows([(7, "x" * 84)] * 900 + [(i, "y" * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(6)
    got = sharding.assign_shards(sharding.sized(docs), 8).collect()
    total = sum(r["size"] for r in got)
    for k in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own))) and abs(sum(r["size"] for r in got if r["shard"] == k) - total / 8) <= 100
