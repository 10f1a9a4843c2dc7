"""Phrase matching in clauses of free text, with denials and typo tolerance, as Column expressions.

A phrase is *reported* in a clause when it occurs there and isn't denied: no cue among
the last tokens before it, counted from the last conjunction on. Three tiers, the first
hit counts: verbatim; with runs of a character collapsed on both sides; and token by
token, where longer tokens tolerate truncation or one edit.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues, conjunctions, intensifiers and bounds.
CUES = ("no", "not", "without", "denies", "denied", "deny", "never", "negative")
CONJUNCTIONS = ("and", "but")
STOPPERS = ("stop", "stopping", "stopped")
COMPARISONS = ("like this", "this bad", "so bad", "before", "as bad")
WINDOW = 3
FUZZY_LENGTH, PREFIX, EDIT_LENGTH, EDIT_PREFIX = 5, 6, 6, 3
_LONGEST = 1 + max(map(len, CUES + CONJUNCTIONS + STOPPERS))  # of a token in a look-back; cut to it, none is taken for one of these


def _words(*items: str) -> Column:
    return F.array(*map(F.lit, items))


def clauses(text: Column) -> Column:
    """Lower-cased text cut at . , ; : ! ? without blank clauses; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[.,;:!?]"), lambda c: F.trim(F.regexp_replace(c, r"\s", " ")) != "")


def collapse(text: Column) -> Column:
    """Runs of a character become one."""
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


TOKEN = "[a-z']+"  # a fixed value


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def phrase_tokens(phrase: str) -> list[str]:
    """The tokens of a phrase as a token of a text is compared with them."""
    return [token.replace("'", "") for token in re.findall(TOKEN, phrase)]


def _last_marker(text: Column) -> Column:
    """Where, from 0, the last of COMPARISONS begins in the text; -1 if there is none."""
    from_end = F.reverse(text)
    return F.greatest(*[F.when(F.contains(text, F.lit(m)), F.length(text) - F.instr(from_end, m[::-1]) - len(m) + 1).otherwise(-1) for m in COMPARISONS])


def denied(before: Column, compared: Column) -> Column:
    """Whether the tokens before a phrase deny it; no more than the last WINDOW of them count. ``compared``: a comparison follows the phrase."""
    back = F.reverse(before)
    stops = F.filter(F.transform(_words(*CONJUNCTIONS), lambda w: F.array_position(back, w)), lambda p: p > 0)
    span = F.when(F.size(stops) > 0, F.array_min(stops).cast("int") - 1).otherwise(F.size(back))
    window = F.slice(back, F.lit(1), F.least(span, F.lit(WINDOW)))
    cue = F.exists(window, lambda w: w.isin(*CUES) | w.endswith("n't"))
    stopper = F.coalesce(F.get(window, F.lit(0)).isin(*STOPPERS), F.lit(False))
    return cue & ~stopper & ~(F.array_contains(window, "never") & compared)


def _look_back(seen: Column, part: Column) -> Column:
    """The last WINDOW tokens of a text that goes on with ``part``; a token that goes on is one, and of a long one the end is enough."""
    new = tokens(part)
    joins = seen["open"] & F.coalesce(F.left(part, F.lit(1)).rlike("[a-z']"), F.lit(False)) & (F.size(seen["last"]) > 0)
    whole = F.when(joins, F.concat(F.slice(seen["last"], F.lit(1), F.size(seen["last"]) - 1), F.array(F.concat(F.element_at(seen["last"], -1), F.get(new, F.lit(0)))), F.slice(new, F.lit(2), F.size(new)))).otherwise(F.concat(seen["last"], new))
    recent = F.slice(whole, F.greatest(F.size(whole) - WINDOW + 1, F.lit(1)), F.lit(WINDOW))
    return F.transform(recent, lambda t: F.right(t, F.lit(_LONGEST)))


def may_deny(clause: Column) -> Column:
    """Whether a token of the clause begins like a cue; what a place cuts off a token may be one."""
    return clause.rlike("(?<![a-z'])(?:" + "|".join(CUES) + ")|n't")


def reported(needle: Column, hay: Column, cued: Column | None = None) -> Column:
    """``needle`` occurs in ``hay`` at some place where it isn't denied; overlapping places count.

    The clause is cut before each place by a pattern, and one walk over the parts carries
    the few tokens that a denial can lie in, so the work is that of reading the clause.
    Without cues (``cued``: ``may_deny`` of it) there is no walk.
    """
    parts = F.split(hay, F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)")))
    first = F.when(F.startswith(hay, needle), 0).otherwise(1)
    marker = _last_marker(hay)
    each = F.transform(parts, lambda p, k: F.struct(p.alias("p"), (k >= first).alias("place")))
    start = F.struct(F.array().cast("array<string>").alias("last"), F.lit(False).alias("open"), F.lit(0).alias("at"), F.lit(False).alias("hit"))

    def walk(seen: Column, e: Column) -> Column:
        free = e["place"] & ~denied(seen["last"], marker >= seen["at"] + F.length(needle))
        return F.struct(_look_back(seen, e["p"]).alias("last"), F.coalesce(F.right(e["p"], F.lit(1)).rlike("[a-z']"), F.lit(False)).alias("open"), (seen["at"] + F.length(e["p"])).alias("at"), (seen["hit"] | free).alias("hit"))

    cued = may_deny(hay) if cued is None else cued
    return F.contains(hay, needle) & F.when(cued, F.aggregate(each, start, walk, lambda seen: seen["hit"])).otherwise(True)


def same_word(keyword: Column, token: Column, exact: Sequence[str]) -> Column:
    """Equal, a truncation, or one edit away; a token that is a keyword's token elsewhere is never a typo."""
    shared = lambda n: (F.length(keyword) >= n) & (F.length(token) >= n) & (F.left(keyword, F.lit(n)) == F.left(token, F.lit(n)))
    near = (F.length(token) >= EDIT_LENGTH) & shared(EDIT_PREFIX) & (F.levenshtein(keyword, token, 1) >= 0)
    known = F.array_contains(_words(*exact), token) if exact else F.lit(False)
    return (token == keyword) | ((F.length(token) >= FUZZY_LENGTH) & ~known & (shared(PREFIX) | near))


def fuzzy(phrase_tokens: Column, clause_tokens: Column, exact: Sequence[str]) -> Column:
    """Every phrase token has its word in the clause, and a match of the first one isn't denied."""
    bare = F.transform(clause_tokens, lambda t: F.replace(t, F.lit("'"), F.lit("")))
    every = F.forall(phrase_tokens, lambda k: F.when(F.length(k) < FUZZY_LENGTH, F.array_contains(bare, k)).otherwise(F.exists(bare, lambda t: same_word(k, t, exact))))
    first = F.get(phrase_tokens, F.lit(0))
    joined = F.array_join(bare, " ")
    marker = _last_marker(joined)
    # The last comparison begins in this token, counted from 0.
    last = F.when(marker >= 0, F.size(F.split(F.left(joined, marker), " ")) - 1).otherwise(-1)
    at = F.sequence(F.lit(1), F.greatest(F.size(bare), F.lit(1)))
    before = lambda i: F.slice(clause_tokens, F.greatest(i - WINDOW, F.lit(1)), F.least(i - 1, F.lit(WINDOW)))
    free = F.exists(at, lambda i: same_word(first, F.try_element_at(bare, i), exact) & ~denied(before(i), last >= i))
    return (F.size(phrase_tokens) > 0) & (F.size(bare) > 0) & every & F.coalesce(free, F.lit(False))
