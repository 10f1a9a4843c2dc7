"""The field is fitted to whole documents, however many lines they have."""

import numpy as np
import pyarrow as pa
import pytest

from modelwatch.llm import lines

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def seen(monkeypatch):
    """(features, labels, bounds) of every fit."""
    got, fit = [], lines.fit_field
    monkeypatch.setattr(lines, "fit_field", lambda x, y, first: got.append((x, y, first)) or fit(x, y, first))
    return got


def _train(rows):
    opening = [f"this is line number w{k} of the text." for k in range(100)]
    texts = ["\n".join(opening + ["BUY NOW!! ### $$$ !!!"] * (30 if i % 2 else 0)) for i in range(40)]
    docs = rows([(i, t, None, "s", None) for i, t in enumerate(texts)], TEXTS)
    return lines.train(docs, rows([(i, int(i % 2 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int"))


def test_every_line_of_the_sample_is_fitted(rows, seen):
    _train(rows)
    x, _, first = seen[0]
    loud = lines.measure(pa.array(["BUY NOW!! ### $$$ !!!"])).x[0, 4]
    assert len(x) == first[-1] and np.diff(first).max() <= lines.CHAIN
    junk = int((x[:, 4] == loud).sum())
    assert loud > 0 and junk > 200 and junk % 30 == 0 and (len(x) - junk) % 100 == 0


def test_lines_in_total_are_bounded(rows, seen, monkeypatch):
    monkeypatch.setattr(lines, "SAMPLE_LINES", 1000)
    _train(rows)
    assert all(500 < len(x) <= 1000 for x, _, _ in seen) and seen
