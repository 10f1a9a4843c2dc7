"""Byte-pair encoding and decoding of whole texts with a public tokenizer file.

Texts fall into pre-tokens, which no merge crosses, and each worker keeps the ids of
those it has met. The new ones of a slice of a partition are encoded together: a pair
occurrence index holds, for each adjacent pair that some merge joins, all its
positions; active merges are applied in ascending rank, each at all its positions at
once, and the positions of the pairs that come and go are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import arrow_map, arrow_schema, plain

_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
# The same for texts of ASCII alone, without tables of Unicode.
_ASCII = r"\t-\r "
_ASCII_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII}A-Za-z0-9]+|[{_ASCII}]+(?![^{_ASCII}])|[{_ASCII}]+")
_ASCII_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^{_ASCII}A-Za-z0-9]+")
_SPECIAL = "\0\0 "  # begins the keys of special tokens; no pre-token has a space after other characters
KNOWN = 200_000  # pre-tokens whose ids a worker keeps, half of them of older slices


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class PairIndex:
    """Merges many words at once; ``table`` maps a pair of ids to rank and joined id."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        left, right, joined = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.ranks = (left << 32 | right)[order], order
        self.left, self.right, self.joined = left.tolist(), right.tolist(), joined.tolist()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where no merge joins it."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges and each word's first place among them; word i is symbols[first[i]:first[i + 1]]."""
        n = len(symbols)
        sym = symbols.astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:] - 1], before[first[:-1]] = -1, -1  # a word's ends; no word is empty
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            at, ranks = at[known], ranks[known]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in places:
                    places[r].append(group)
                else:
                    places[r] = [group]
                    heapq.heappush(active, r)

        pairs = np.flatnonzero(after >= 0)
        add(pairs, self.rank(sym[pairs], sym[pairs + 1]))
        while active:
            r = heapq.heappop(active)
            groups = places.pop(r)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping places the left one wins
                taken, free = set(), []
                for p in at.tolist():
                    if p not in taken:
                        free.append(p)
                        taken.add(int(after[p]))
                at = np.array(free, np.int64)
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = self.joined[r], -1
            follow = after[gone]
            after[at] = follow
            linked = follow >= 0
            before[follow[linked]] = at[linked]
            prior = before[at]
            prior = prior[prior >= 0]
            spots = np.concatenate([prior, at[linked]])  # of the pairs that came about
            add(spots, self.rank(sym[spots], sym[after[spots]]))
        kept = sym >= 0
        return sym[kept], np.concatenate([[0], np.cumsum(kept)])[first]


class Bpe:
    """Encodes and decodes as a tokenizer file says, for the two kinds of files that pre-split with a pattern.

    Byte-level files take texts as they are; word files compose and lower-case them,
    drop white space and mark the last symbol of each word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or bool(spec["normalizer"]) != bool(self.suffix):
            raise ValueError(f"{path} is neither a byte-level nor a word file")
        self.pattern = _WORD if self.suffix else _PRETOKEN
        chars = byte_characters()
        self.first_ids = np.array([vocab[c] for c in chars], np.int64)
        self.last_ids = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {i: bytes(value[c] for c in t.removesuffix(self.suffix)) + b" " * t.endswith(self.suffix or "\0") for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fixed = {_SPECIAL + t: np.array([i], np.uint32).tobytes() for t, i in self.special.items()}
        self.known: dict[str, bytes] = dict(self.fixed)
        self.older: dict[str, bytes] = {}
        self.newer: set[str] = set()  # known ones with characters that are not assigned in this Python's Unicode tables
        self.value = {ord(c): b for b, c in enumerate(chars)}
        self.path, self.library = path, None

    def pretokens(self, text: str, plain: Callable[[str], list[str]]) -> list[str]:
        if self.split is None or not self.split.search(text):
            return plain(text)
        return [c for part in self.split.split(text) for c in ([_SPECIAL + part] if part in self.special else plain(part))]

    def plain_pretokens(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORD.findall(text.lower()) if self.suffix else _ASCII_PRETOKEN.findall(text)
        if self.suffix:  # sigma: letter by letter, as at no word's end
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return self.pattern.findall(text)

    def learn(self, new: list[str]) -> None:
        """Encodes pre-tokens that aren't known yet, all in one index."""
        raw = [p.encode() for p in new]
        first = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first_ids[data]
        symbols[first[1:] - 1] = self.last_ids[data[first[1:] - 1]]
        ids, at = self.index.merge(symbols, first)
        packed, at = ids.astype(np.uint32).tobytes(), (at * 4).tolist()
        self.known.update((p, packed[a:b]) for p, a, b in zip(new, at, at[1:], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit integers in a row."""
        if 2 * len(self.known) > KNOWN:  # what the last slices had stays; what none of them had goes
            self.older, self.known = self.known, dict(self.fixed)
            self.newer.intersection_update(self.older)
        parts = [self.pretokens(t, self.plain_pretokens) for t in texts]
        new = self.unknown(parts)
        self.newer.update(p for p in new if not p.isascii() and any(unicodedata.category(c) == "Cn" for c in p))
        if self.newer:
            again = [i for i, p in enumerate(parts) if not self.newer.isdisjoint(p)]
            for i in again:
                parts[i] = self.pretokens(texts[i], self.library_pretokens)
            new.update(self.unknown([parts[i] for i in again]))
        if new:
            self.learn(list(new))
        known = self.known
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def unknown(self, parts: list[list[str]]) -> set[str]:
        """Pre-tokens that aren't known; those of older slices become known again."""
        new = set().union(*parts).difference(self.known)
        if self.older:
            back = new.intersection(self.older)
            self.known.update((p, self.older[p]) for p in back)
            new -= back
        return new

    def library_pretokens(self, text: str) -> list[str]:
        """For characters that Unicode got lately: the pattern's tables may know them, those of the library don't, so it splits such texts."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(self.value[ord(c)] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; word files' text has a space after each word."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text (null: empty); special tokens' strings become their ids.

    A row out per row in, whatever repeats or has no doc_id; other columns are dropped. An
    empty text has no ids. A very long text is a slice of its own; memory follows the longest
    text and KNOWN. An empty table gives an empty table. ``path``: a tokenizer file that
    every machine has.
    """
    schema = arrow_schema("doc_id long, ids array<int>")

    def make():
        bpe = loaded(path)

        def step(rows: pa.RecordBatch):
            ids = bpe.encode(plain(rows.column("text")).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], schema=schema)

        return step

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids array<int>", "text", 4 << 20)


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder and its known pre-tokens for all tasks of a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def decode(tokens: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text, repeated rows are each decoded, other columns are dropped.

    digests: n_tokens, ids_sha256 and decoded_sha256 instead of the text.
    """
    wide = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, text string"
    schema = arrow_schema(wide)

    def run(batches):
        bpe = loaded(path)
        numerals = {i: b"%d" % i for i in bpe.bytes_of}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(len(schema) - 1)]
                for x in rows.column("ids"):
                    ids = x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []
                    text = bpe.decode(ids)
                    cells = [len(ids), hashlib.sha256(b",".join(map(numerals.__getitem__, ids))).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] if digests else [text]
                    for o, c in zip(out, cells, strict=True):
                        o.append(c)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(o, f.type) for o, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, wide)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: token count and digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path, digests=True)
