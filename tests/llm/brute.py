"""Plain versions of the text operators, one document at a time and without hashes."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=2):
    w = words((text or "").translate(LOWER))
    return (frozenset([tuple(w)]) if w else frozenset()) if len(w) < width else frozenset(zip(*(w[k:] for k in range(width))))


def components(rows, width=2):
    """doc_id -> (shingles, smallest reachable doc_id); every pair is compared."""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def removed(rows, size):
    """(doc_id, words, removed, kept words) of each row."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def digest(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    threes = collections.Counter(zip(w, w[1:], w[2:]))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if threes[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(again)
