"""Language identification by compression.

Each language has a zstandard compressor primed with a raw-content dictionary, made of its sampled texts.
A text gets the language whose compressor makes it smallest. Texts are lower-cased and reduced to their
letters; long ones are compressed whole, chunk after chunk, so that the dictionary counts in every part.

The dictionaries are learned from a bounded sample: for each language the SAMPLE_ROWS training rows of
smallest hash, of each a stretch of SAMPLE_CHARS characters that begins anywhere in the text, by a hash. The
driver holds no more than that for each language, and each text is compressed once for each language, so this
is meant for labels of up to some hundred languages.

Columns added: lang_pred, score (0 to 1: softmax of saved bytes), margin (relative lead in size over the
runner-up) and rejected (`und`, or the margin is below MIN_MARGIN). Columns of these names are replaced.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language with
more sampled rows, then by code point, and are rejected; a null lang is never learned; with nothing to
learn from all texts are `und`; an empty table gives no rows; repeated rows are judged alike; a very long text
is compressed whole by the task that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS, SAMPLE_CHARS = 256, 512
LEVEL, CHUNK_BYTES = 6, 4096
MIN_MARGIN = 0.001
ADDED = T.StructType().add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def _letters(text: str) -> bytes:
    import re

    return re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """rows: doc_id, text, lang. Returns each language's dictionary, languages with most samples first."""
    by_hash = F.xxhash64(F.col("doc_id").cast("string"))
    order = Window.partitionBy("lang").orderBy(by_hash, "doc_id", "text")
    begin = 1 + F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("begin")), F.greatest(F.lit(1), F.length("text") - sample_chars + 1))
    sample = (
        rows.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", "lang", F.substring(F.col("text"), begin.cast("int"), F.lit(sample_chars)).alias("text"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= sample_rows)
    )
    texts: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "nth").toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text)
    return {x: b" ".join(map(_letters, texts[x])) for x in sorted(texts, key=lambda x: (-len(texts[x]), x))}


class _Judge:
    def __init__(self, dictionaries: dict[str, bytes], level: int, chunk: int, min_margin: float):
        import zstandard

        self.names, self.chunk, self.min_margin, self.compress = list(dictionaries), chunk, min_margin, []
        for content in dictionaries.values():
            primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        from math import exp

        letters = _letters(text or "")
        if not self.names or not any(map(str.isalpha, letters.decode())):
            return "und", 0.0, 0.0, True
        chunks = [letters[i: i + self.chunk] for i in range(0, len(letters), self.chunk)]
        sizes = [sum(len(compress(x)) for x in chunks) for compress in self.compress]
        least = min(sizes)
        best = sizes.index(least)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * least)
        margin = (second - least) / second
        return self.names[best], 1 / sum(exp(max(-700.0, (least - s) * 0.7)) for s in sizes), margin, margin < self.min_margin


def classify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = LEVEL, chunk: int = CHUNK_BYTES, min_margin: float = MIN_MARGIN) -> DataFrame:
    """df with ADDED's columns."""
    kept = [c for c in df.columns if c not in ADDED.names]

    def run(batches):
        import pyarrow as pa

        from ._shingles import slices

        judge = _Judge(dictionaries, level, chunk, min_margin)
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for whole in batches:
            for batch in slices(whole, text):
                found = zip(*map(judge, batch.column(kept.index(text)).to_pylist()))
                yield pa.record_batch([*batch.columns, *(pa.array(x, k) for x, k in zip(found, kinds))], names=[*kept, *ADDED.names])

    source = df.select(*kept)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, *ADDED.fields]))


def identify(docs: DataFrame) -> DataFrame:
    """The result contract: learn from the rows that aren't held out, predict all."""
    slim = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(slim.where("NOT held_out"))
    return classify(slim.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def identified_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is told with a clear margin, with their columns."""
    model, at = learn(docs.where(~held_out()).select("doc_id", "text", "lang")), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        from ._shingles import slices

        judge = _Judge(model, LEVEL, CHUNK_BYTES, MIN_MARGIN)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array([not judge(x)[3] for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
