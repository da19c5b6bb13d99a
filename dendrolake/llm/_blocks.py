"""Bounded blocks of candidate pairs: dealing members of a bucket to blocks, and reading blocks in tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator, key: list[str]) -> Iterator:
    """Arrow batches sorted by key -> one Arrow table for each run of equal keys. A run may go over any
    number of batches; the dealer of the rows bounds its size."""
    import numpy as np
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def deal(members: DataFrame, chunks: Column, member: str, salt: str = "") -> DataFrame:
    """members with a column __chunks (how many chunks the bucket has). Every member goes to the blocks
    (lo, hi), lo <= hi, of its chunk with each other; two members of a bucket meet in exactly one block."""
    own = F.pmod(F.xxhash64(F.col(member), F.lit(salt)), chunks).cast("int")
    return (
        members.withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
        .withColumn("__lo", F.least("__own", "__other"))
        .withColumn("__hi", F.greatest("__own", "__other"))
        .drop("__other")
    )


def local_labels(left, right, size: int):
    """Connected components of `size` members by the pairs (left, right): each member's smallest index."""
    import numpy as np

    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
