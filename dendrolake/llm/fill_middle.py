r"""Fill-in-the-middle transformation on ropes.

A text is a rope: a binary tree whose leaves hold whole units (lines, `[^\n]*\n|[^\n]+`) and whose nodes cache how many units
and how many code points are below. Splitting at the ranks of two units gives prefix, middle and suffix; the output is a
concatenation of these subtrees with sentinels, prefix first (psm) or suffix first (spm). Going back, the output is a rope
again, split at the code points where its two inner sentinels stand. Splitting and joining touch the nodes of one path each.

The draws of a document are the first four groups of 32 bits of the SHA-256 of its seed and doc_id: two unit ranks, whether
the text stays plain, and the order. A text that contains a sentinel stays plain, so sentinels in an output are the written
ones: `<` can't be the second or third character of a sentinel, so none arises where a text and a sentinel meet.

Defined results: a null text counts as empty and stays plain, with no units; a null doc_id draws as an empty one; repeated rows
are transformed alike; very long texts are handled whole, each by itself in one task; an empty table gives no rows. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import columns, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF = 1024  # code points of a leaf, to the end of its last unit
SEED, RATE, SPM = 7, 100, 50
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


class Rope:
    """A leaf with its text, or a node with two parts."""

    __slots__ = ("text", "left", "right", "units", "chars")

    def __init__(self, text: str | None, units: int, chars: int, left: Rope | None = None, right: Rope | None = None):
        self.text, self.units, self.chars, self.left, self.right = text, units, chars, left, right


def leaf(text: str) -> Rope:
    return Rope(text, text.count("\n") + (text != "" and text[-1] != "\n"), len(text))


def joined(a: Rope, b: Rope) -> Rope:
    if not a.chars or not b.chars:
        return a if a.chars else b
    return Rope(None, a.units + b.units, a.chars + b.chars, a, b)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope; leaves end with a unit."""
    parts, at = [], 0
    while at < len(text):
        end = text.find("\n", at + size - 1) + 1 or len(text)
        parts.append(leaf(text[at:end]))
        at = end
    while len(parts) > 1:
        parts = [joined(*parts[i: i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else leaf("")


def _unit_end(text: str, rank: int) -> int:
    at = 0
    for _ in range(rank):
        at = text.find("\n", at) + 1 or len(text)
    return at


def split(tree: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The parts before and after a rank, which counts `units` or `chars`."""
    if rank <= 0 or rank >= getattr(tree, by):
        return (leaf(""), tree) if rank <= 0 else (tree, leaf(""))
    if tree.left is None:
        at = rank if by == "chars" else _unit_end(tree.text, rank)
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    before = getattr(tree.left, by)
    if rank <= before:
        a, b = split(tree.left, rank, by)
        return a, joined(b, tree.right)
    a, b = split(tree.right, rank - before, by)
    return joined(tree.left, a), b


def written(tree: Rope) -> str:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            out.append(node.text)
        else:
            todo += [node.right, node.left]
    return "".join(out)


def rearranged(text: str, h1: int, h2: int, h3: int, h4: int, rate: int, spm: int, size: int = LEAF) -> tuple:
    """MADE of one text."""
    whole = rope(text, size)
    if not text or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return whole.units, "plain", None, None, text
    ranks = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    upper, suffix = split(whole, ranks[1], "units")
    prefix, middle = split(upper, ranks[0], "units")
    form, order = ("spm", ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))) if h4 % 100 < spm else ("psm", ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    out = leaf("")
    for sentinel, part in order:
        out = joined(out, joined(leaf(sentinel), part))
    return whole.units, form, prefix.chars, middle.chars, written(out)


def original(output: str, form: str, size: int = LEAF) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    rest = split(rope(output, size), len(first), "chars")[1]
    inner, last = output.index(second, len(first)), output.index(MIDDLE, len(first))
    one, rest = split(rest, inner - len(first), "chars")
    two, rest = split(split(rest, len(second), "chars")[1], last - inner - len(second), "chars")
    middle = split(rest, len(MIDDLE), "chars")[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return written(joined(joined(prefix, middle), suffix))


def draw(group: int, doc_id: Column, seed: int) -> Column:
    """The group-th 32 bits (from one) of the hash of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def _apply(df: DataFrame, text: str, schema: str, make) -> DataFrame:
    """df with the columns of schema, made from each row's text and the others of df by `make`, which gets lists."""
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(schema)
    kept = df.columns

    def run(batches):
        import pyarrow as pa

        from ._shingles import slices

        kinds = [{"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in added]
        for whole in batches:
            for batch in slices(whole, text):
                found = list(zip(*make(*(batch.column(kept.index(c)).to_pylist() for c in kept if c.startswith("__"))))) or [[] for _ in kinds]
                yield pa.record_batch([*batch.columns, *(pa.array(x, k) for x, k in zip(found, kinds))], names=[*kept, *added.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, size: int = LEAF) -> DataFrame:
    """row (all columns of docs) and MADE. rate: percent of texts that are rearranged; spm: percent of these with the suffix first."""

    def make(text, h1, h2, h3, h4):
        return [rearranged(*x, rate, spm, size) for x in zip(text, h1, h2, h3, h4)]

    source = docs.select(F.struct(*columns(docs)).alias("row"), text_or_empty().alias("__text"), *(draw(k, F.col("doc_id").cast("long"), seed).alias(f"__h{k}") for k in range(1, 5)))
    return _apply(source, "__text", MADE, make).drop("__text", "__h1", "__h2", "__h3", "__h4")


def restore(outputs: DataFrame, size: int = LEAF) -> DataFrame:
    """outputs (with output and form) with one column more, restored: the text before."""

    def make(output, form):
        return [(original(*x, size),) for x in zip(output, form)]

    source = outputs.withColumns({"__output": F.col("output"), "__form": F.col("form")})
    return _apply(source.drop("output"), "__output", "restored string", make).withColumnRenamed("__output", "output").drop("__form")


def digests(docs: DataFrame) -> DataFrame:
    """The result contract; the restored text is made from output and form alone."""
    made = transform(docs.select("doc_id", "text")).select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
r AS (SELECT doc_id, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
