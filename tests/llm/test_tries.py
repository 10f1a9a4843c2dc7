"""Tries that are built in byte order."""

import random

from modelwatch.llm import divergence


def shape(node):
    return node[0], node[2] >= 0, tuple(shape(node[1][k]) for k in sorted(node[1])) if node[1] else ()


def test_trie_in_byte_order_is_the_same():
    rng = random.Random(3)
    many = list({bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(0, 6))) for _ in range(400)})
    long = [b"a" * 300, b"a" * 300 + b"b", b"a" * 299 + b"c", b"a" * 64, b"a" * 65, b"b" * 64, b"b" * 64 + b"c"]
    for terms in ([], [b""], [b"", b"a"], [b"ab", b"a", b"abc", b"abd", b"b"], long, many):
        one, other = divergence.Trie(), divergence.Trie()
        one.grow(sorted(terms))
        for t in terms:
            other.leaf(t)
        assert shape(one.root) == shape(other.root) and one.leaves == other.leaves == len(terms)
        assert one.walk() == (sorted(terms), list(range(len(terms))))
