"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens, in an arbitrary but fixed order. A round fills one window.
Queues are the leaves of a balanced tree, and a round's grains are dealt from the root down: after t grains
of a node its first child has had floor(t * its share) of them and the other child the rest, so what rounding
withheld from a queue is its deficit, carried to later rounds, windows and partitions. All queues so end
together, every window is full, and after any window a queue has had its share of all grains so far, give
or take one grain for each level of the tree (log2 of the number of queues). The round and the place of any
grain follow from the totals along its queue's path in closed form: no task waits for another. What is left
of each queue, less than a grain, fills the last windows.

Pass 1 tokenizes each partition once and stores the ids with their running offset in (partition, queue).
Totals of (partition, queue) give each partition's base, totals of the nodes each queue's path, both by joins;
pass 2 cuts documents at windows, and where a queue's grains in a window end.

Defined results: null and empty texts are one token, the end id; null doc_id and repeated rows are packed
like any others; a null source is a queue of its own, and so is each other source, however many there are;
special tokens written in a text are those tokens, as the tokenizer has it; an empty table gives no pieces.
A text is held whole in one task with its ids, so very long ones need memory in proportion. Only doc_id,
source and text are read, so other columns may have any names.
"""

from __future__ import annotations

import os
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

WINDOW, GRAIN, END_ID = 2048, 32, 1
SLICE_BYTES = 4 << 20  # of text at once
KNOWN = 1_000_000  # distinct parts whose ids a task keeps
MARKS = ".,;:!?#$%&*|"
#: Latin letters without composed or special forms, then marks: the ids of such a word are those of its lower-cased letters and those of its marks
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]*[.,;:!?#$%&*|]*$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Ids of many texts at once. The tokenizer's pieces never hold white space, so a text's ids are those of
    its words. Distinct words are split into parts (letters, marks) and each part is encoded once."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.parts = pa.array([""], pa.string())
        self.ids, self.upto = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _learn(self, new) -> None:
        """new: an Arrow array of distinct parts that aren't known."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(new, PLAIN)
        one = new.filter(plain)
        ids, cuts = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(one):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(one):  # some part isn't a single piece after all: one by one
                plain, one, ids, cuts = pa.array(np.zeros(len(new), bool)), one.slice(0, 0), ids[:0], cuts[:0]
        other = new.filter(pc.invert(plain))
        if len(other):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)]
            cuts = np.concatenate([cuts, len(ids) + np.cumsum([len(x) for x in found])])
            ids = np.concatenate([ids, np.array([i for x in found for i in x], np.uint32)])
        self.parts = pa.concat_arrays([self.parts, one, other])
        self.upto = np.concatenate([self.upto, len(self.ids) + cuts])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts, end: int) -> tuple:
        """texts: an Arrow string array without nulls. Returns the ids of all texts, `end` after each, as one
        array, and each text's number of ids."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.parts) > KNOWN:
            # those met first stay, as frequent words are among them
            half = KNOWN // 2
            self.parts, self.ids, self.upto = pa.concat_arrays([self.parts.slice(0, half)]), self.ids[: self.upto[half]].copy(), self.upto[: half + 1].copy()
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, PLAIN)
        letters = pc.utf8_rtrim(words, MARKS)
        # the marks of a plain word are its bytes after the letters
        marks = np.where(plain.to_numpy(zero_copy_only=False), pc.subtract(pc.binary_length(words), pc.binary_length(letters)).to_numpy(), 0)
        letters = pc.if_else(plain, pc.utf8_lower(letters), words)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1: words.offset + len(words) + 1]
        upto = np.concatenate([[0], np.cumsum(marks)])
        chosen = np.frombuffer(words.buffers()[2] or b"", np.uint8)[np.repeat(ends - upto[1:], marks) + np.arange(upto[-1])]
        tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(chosen))
        both = pa.concat_arrays([letters, tails]).dictionary_encode()
        at = pc.index_in(both.dictionary, self.parts)
        if at.null_count:
            self._learn(both.dictionary.filter(at.is_null()))
            at = pc.index_in(both.dictionary, self.parts)
        part = at.to_numpy()[both.indices.to_numpy()]
        # letters and marks of each word, and the end id (part -1) after each text
        index, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        sequence = np.full(2 * len(index) + len(texts), -1, np.int32)
        place = 2 * np.arange(len(index)) + np.repeat(np.arange(len(texts)), np.diff(bounds))
        sequence[place], sequence[place + 1] = part[index], part[len(words) + index]
        lengths, starts = np.append(np.diff(self.upto), 1), np.append(self.upto[:-1], len(self.ids))
        each = lengths[sequence]
        total = np.cumsum(each)
        ids = np.append(self.ids, np.uint32(end))[np.repeat(starts[sequence] - (total - each), each) + np.arange(each.sum())]
        return ids, np.diff(total[2 * bounds[1:] + np.arange(len(texts))], prepend=0)


_IDS: dict[str, Ids] = {}


STORED = "doc_id long, part int, queue string, local long, n long, ids binary"


def _binary(ids, bounds):
    """Runs of ids as one Arrow array of bytes (little-endian unsigned 32-bit)."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])


def _tokenize(path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ._shingles import slices

        coder = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        local: dict = {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, lengths = coder.encode(batch.column("text"), END_ID)
                offsets = []
                for queue, k in zip(batch.column("queue").to_pylist(), lengths.tolist()):
                    offsets.append(local.get(queue, 0))
                    local[queue] = offsets[-1] + k
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("part"), batch.column("queue"), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), _binary(ids, np.append(0, np.cumsum(lengths)))],
                    names=["doc_id", "part", "queue", "local", "n", "ids"],
                )

    return run


def divided(t, part, whole) -> tuple:
    """Quotient and remainder of t * part / whole for integers, exact where the quotient is below 2**50: it is
    off by one at most in floating point, and what that leaves is small, so it's right modulo 2**64."""
    import numpy as np

    q = np.floor(t.astype(float) * part / whole).astype(np.int64)
    rest = t * part - q * whole
    return q + rest // whole, rest % whole


def grain_places(u, total, first, other, per_window: int):
    """u: numbers of grains in their queues. total, first, other: a row for each, and a column for each level from
    the root down: the node's grains, its first child's, and whether the path goes to the other child.
    Returns each grain's place among all; the grains of a queue in a window stand together."""
    import numpy as np

    t, levels = u, range(total.shape[1])
    for d in reversed(levels):  # up to the root: in which turn of the node the grain is dealt
        n, side = total[:, d], other[:, d]
        q, rest = divided(np.where(side, t, t + 1), n, np.where(side, n - first[:, d], first[:, d]))
        t = np.where(side | (rest > 0), q, q - 1)
    window = t // per_window
    since, upto, at = window * per_window, (window + 1) * per_window, window * per_window
    for d in levels:  # down again: what the queue has had before this window, and what stands before it there
        n, side = total[:, d], other[:, d]
        upto = np.minimum(upto, n)
        x, y = divided(since, first[:, d], n)[0], divided(upto, first[:, d], n)[0]
        at = at + np.where(side, y - x, 0)
        since, upto = np.where(side, since - x, x), np.where(side, upto - y, y)
    return at + u - since


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _cut(window: int, grain: int):
    def places(s, k, columns, path):
        """Places of the grains k of the rows s: grains of the common stream, then what is left of each queue."""
        import numpy as np

        grains, tail = columns
        total, first, other = path
        common = k < grains[s]
        at = total[s, 0] * grain + tail[s]
        i = s[common]
        at[common] = grain * grain_places(k[common], total[i], first[i], other[i], window // grain)
        return at

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            a, n, grains, tail = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("pos", "n", "grains", "tail"))
            path = [batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("total", "first", "other")]
            # grains of each document; all that lies beyond a queue's last whole grain is one
            begin, end = np.minimum(a // grain, grains), np.minimum((a + n - 1) // grain, grains) + 1
            row = np.repeat(np.arange(len(a)), end - begin)
            k = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
            lo, hi = np.maximum(a[row], k * grain), np.where(k < grains[row], np.minimum((a + n)[row], (k + 1) * grain), (a + n)[row])
            at = np.concatenate([places(row[i: i + (1 << 17)], k[i: i + (1 << 17)], (grains, tail), path) for i in range(0, len(row), 1 << 17)])
            at += lo - k * grain
            over = at % window + hi - lo > window  # the rest of a queue goes on in the next window
            cut = lo + window - at % window
            order = np.argsort(np.concatenate([np.arange(len(row)), np.flatnonzero(over)]), kind="stable")
            row, lo, at = (np.concatenate(x)[order] for x in ((row, row[over]), (lo, cut[over]), (at, (at + cut - lo)[over])))
            hi = np.append(lo[1:], 0)
            last = np.append(row[1:] != row[:-1], True)
            hi[last] = (a + n)[row[last]]
            # grains that stand together in a window are one piece
            new = np.append(True, last[:-1] | (at[1:] != at[:-1] + hi[:-1] - lo[:-1]) | (at[1:] // window != at[:-1] // window))
            head = np.flatnonzero(new)
            row, at, lo, hi = row[head], at[head], lo[head], hi[np.append(head[1:], len(new)) - 1]
            stored = batch.column(batch.schema.get_field_index("ids"))
            offsets = np.frombuffer(stored.buffers()[1], np.int32)[stored.offset: stored.offset + len(batch) + 1]
            ids = np.frombuffer(stored.buffers()[2], "<u4", count=(offsets[-1] - offsets[0]) // 4, offset=offsets[0])
            yield pa.record_batch(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row)), pa.array(lo - a[row]), pa.array(hi - lo), _binary(ids, np.append(0, np.cumsum(hi - lo))),
                    pa.array(n[row]), pa.array(at // window), pa.array(at % window),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def paths(totals: DataFrame, grain: int) -> DataFrame:
    """totals: queue, sum. Returns one row for each queue: queue, grains (whole ones), tail (its place among what is
    left of all queues), and for each level of the tree total, first, other as grain_places has them."""
    levels = max(1, (totals.count() - 1).bit_length())
    nth = F.row_number().over(Window.orderBy("queue")) - 1  # one row for each queue
    leaves = totals.select("queue", nth.alias("nth"), F.expr(f"sum div {grain}").alias("grains"), (F.col("sum") % grain).alias("left"))
    steps = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).selectExpr(
        "*", f"shiftright(nth, {levels} - level) AS node", f"(shiftright(nth, {levels} - level - 1) & 1) = 1 AS other"
    )
    nodes = steps.groupBy("level", "node").agg(F.sum("grains").alias("total"), F.sum(F.expr("if(other, 0, grains)")).alias("first"), F.sum(F.expr("if(other, 0, left)")).alias("before"))
    step = F.struct("level", "total", "first", "other")
    return (
        steps.join(nodes, ["level", "node"]).groupBy("queue", "grains")
        .agg(F.sum(F.expr("if(other, before, 0)")).alias("tail"), F.array_sort(F.collect_list(step)).alias("path"))
        .select("queue", "grains", "tail", "path.total", "path.first", "path.other")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. All sequences but the last are full. The grain must divide the window."""
    if window % grain:
        raise ValueError("the grain must divide the window")
    scratch = Scratch(docs.sparkSession, "packing")
    queue = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    stored = scratch.cut(rows.mapInArrow(_tokenize(tokenizer or default_tokenizer()), STORED), "ids")
    sums = scratch.cut(stored.groupBy("part", "queue").agg(F.sum("n").alias("sum")), "sums")
    path = scratch.cut(paths(scratch.cut(sums.groupBy("queue").agg(F.sum("sum").alias("sum")), "totals"), grain), "paths")
    upto = F.sum("sum").over(Window.partitionBy("queue").orderBy("part"))
    # written, so that Spark knows how small it is and doesn't shuffle the ids for it
    bases = scratch.cut(sums.select("part", "queue", (upto - F.col("sum")).alias("base")).join(path, "queue"), "bases")
    placed = stored.join(bases, ["part", "queue"]).select("doc_id", (F.col("base") + F.col("local")).alias("pos"), "n", "ids", "grains", "tail", "total", "first", "other")
    return placed.mapInArrow(_cut(window, grain), PIECES)


def digests(docs: DataFrame) -> DataFrame:
    """The result contract: crc32 of each piece's ids in place of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
