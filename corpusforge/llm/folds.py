"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo `folds`; a null id counts as the empty text, whose fold is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample_by_label(labelled: DataFrame, label: str, bounds: dict) -> DataFrame:
    """For each value of `label`, the bound's number of rows, first in the order of a hash of doc_id."""
    out = None
    for value, bound in bounds.items():
        part = labelled.filter(F.col(label) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        out = part if out is None else out.union(part)
    return out
