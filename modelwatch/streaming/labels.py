"""Predictions and labels that arrive in any order, joined over a stream with a state for each case.

The state of a case is its latest valid label and the predictions that still wait for one.
What it emits are facts: a prediction, a label, or a prediction with the label known at the
time. ``current`` reads the join off these facts, so neither the order of arrival nor a cut
state changes its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modelwatch.operators.joins import class_index

OPEN = 1000  # predictions of a case that wait in its state; older ones are emitted without a label
FACTS = "case_id string, seq long, y_pred int, label_seq long, y_true int"
_STATE = "label_seq long, y_true int, seqs array<long>, preds array<int>"


def events(log: DataFrame, truth: DataFrame, codes: list[str], parts: int = 1, frequent: list[str] | None = None) -> DataFrame:
    """(part, case_id, seq, class, is_label) of both streams, without nulls: predictions and labels of known codes.

    Rows without a case or a sequence go. A case's predictions are dealt into parts, and its labels are told to all of them;
    where ``frequent`` cases are named, all others have one part.
    """
    known = lambda rows, code: rows.withColumn("_class", class_index(F.col(code), codes)).where("_class is not null and case_id is not null and seq is not null")
    told = lambda rows, part, label: rows.select(part, F.col("case_id").cast("string").alias("case_id"), F.col("seq").cast("long").alias("seq"), F.col("_class").alias("class"), F.lit(label).alias("is_label"))
    dealt = F.lit(True) if frequent is None else F.col("case_id").cast("string").isin(frequent)
    part = F.when(dealt, F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int")).otherwise(0).alias("part")
    every = F.explode(F.sequence(F.lit(0), F.when(dealt, parts - 1).otherwise(0))).alias("part")
    return told(known(log, "pred_code"), part, False).unionByName(told(known(truth, "label_code"), every, True))


def _step():
    """The function of one case: its rows of a batch in, its facts out. Cases are many and small, so that frames are made only of what is emitted."""

    def facts(case: str, rows: list[tuple]) -> pd.DataFrame:
        cells = np.empty((len(rows), 5), object)  # whole numbers and None
        cells[:, 0] = case
        cells[:, 1:] = rows
        return pd.DataFrame(cells, columns=["case_id", "seq", "y_pred", "label_seq", "y_true"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label_seq, y_true, seqs, preds = state.get if state.exists else (None, None, [], [])
        waiting = list(zip(seqs, preds, strict=True))
        for rows in frames:
            out = []
            seq, of, label = (rows[c].to_numpy() for c in ("seq", "class", "is_label"))
            told = np.flatnonzero(label)
            if len(told):
                newest = told[seq[told].argmax()]
                if label_seq is None or int(seq[newest]) > label_seq:
                    label_seq, y_true = int(seq[newest]), int(of[newest])
                    out.append((None, None, label_seq, y_true))
            waiting += zip(seq[~label].tolist(), of[~label].tolist(), strict=True)
            cut = len(waiting) if label_seq is not None else max(0, len(waiting) - OPEN)
            out += [(s, p, label_seq, y_true) for s, p in waiting[:cut]]
            waiting = waiting[cut:]
            if out:
                yield facts(key[0], out)
        state.update((label_seq, y_true, [s for s, _ in waiting], [p for _, p in waiting]))

    return run


def labelled_facts(log: DataFrame, truth: DataFrame, codes: list[str], parts: int = 8, frequent: list[str] | None = None) -> DataFrame:
    """FACTS of two streams: (case_id, seq, pred_code) and (case_id, seq, label_code).

    A label that is newer than its case's is a fact of its own. A prediction is emitted once: with the label that its
    case has or gets, or without one when more than OPEN wait. No row is too late, and no state expires: it has
    a label and at most OPEN predictions a case and part. Null and unknown codes are no rows, so they don't erase a label. A case has a state for each of ``parts``, so that a frequent one is no
    work of one task alone; a query keeps its number of parts. A state costs far more than a row, so where ``frequent`` cases
    are named only these have ``parts`` of them and all others one; over restarts such a list may grow but not shrink.
    """
    both = events(log, truth, codes, parts, frequent)
    return both.groupBy("case_id", "part").applyInPandasWithState(_step(), FACTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def current(facts: DataFrame) -> DataFrame:
    """(case_id, seq, y_pred, y_true): the join of predictions with their case's latest label, of all facts so far.

    A fact that was written twice counts once. Predictions whose case has no label yet are left out.
    """
    labels = facts.where("label_seq is not null").groupBy("case_id").agg(F.max_by("y_true", "label_seq").alias("y_true"))
    predictions = facts.where("seq is not null").select("case_id", "seq", "y_pred").distinct()
    return predictions.join(labels, "case_id").select("case_id", "seq", "y_pred", "y_true")
