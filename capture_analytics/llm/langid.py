"""Language identification by compression.

Fit: for each language up to `SAMPLES` training documents (one for each remainder of a hash of
the id, so the choice needs no ordering of all rows) give excerpts, which become a zstandard
raw-content dictionary of at most `DICTIONARY` bytes. Both bounds are parameters; all else reads
every document. Predict: the whole text, in lower case and with everything but letters made
blank, is compressed in blocks with each dictionary; the language of the smallest total wins.
Blocks keep a long text from outgrowing its dictionary.

Cases: null text, or one without a letter, is `und` with score 0, as is everything when no
language could be learned; ties go to the alphabetically first language; null languages are not
learned from. A margin below `MARGIN` of the size is marked `rejected`; the named language stays. Each row of
a repeated document gets its row and may be learned from; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_analytics.llm.tables import documents, id_and_text, pieces, remainder, shared

SAMPLES = 128
DICTIONARY = 1 << 16
BLOCK = 2048
LEVEL = 6
MARGIN = 0.005
# Bytes by which a total must be smaller for odds of e against another language.
SCALE = 8.0
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    """The text in lower case with single blanks for all that is no letter."""
    return regex.sub(r"\P{L}+", " ", text.lower()).strip().encode() if text else b""


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from a bounded sample of the training documents."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast(
        "string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        remainder(FOLDS) != HELD_OUT)
    key = F.xxhash64("doc_id")
    picks = named.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).groupBy(
        "lang", F.pmod(key, F.lit(SAMPLES)).alias("slot")).agg(
        F.min(F.struct(F.xxhash64(key).alias("order"), "doc_id")).alias("first")).select(
        "lang", F.col("first.doc_id").alias("pick"))
    # SAMPLES rows for each language
    size = F.ceil(DICTIONARY / F.count("*").over(Window.partitionBy("lang"))).cast("int")
    sized = picks.withColumn("size", size)
    begin = F.greatest(F.lit(1), ((F.length("text") - F.col("size")) / 2).cast("int"))
    rows = named.join(F.broadcast(sized.withColumnRenamed("lang", "pick_lang")),
                      F.col("doc_id").eqNullSafe(F.col("pick"))
                      & (F.col("lang") == F.col("pick_lang"))).select(
        "lang", "doc_id", F.substring("text", begin, F.col("size")).alias("excerpt")).collect()
    content: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"],
                                           r["excerpt"])):
        content.setdefault(row["lang"], []).append(letters(row["excerpt"]))
    return {lang: b" ".join(parts)[:DICTIONARY] for lang, parts in content.items()}


class Sizer:
    """Compressed sizes of a text with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(lang for lang, content in dictionaries.items() if content)
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(
                dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False,
                write_dict_id=False))

    def sizes(self, content: bytes) -> list[int]:
        blocks = [content[i:i + BLOCK] for i in range(0, len(content), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        content = letters(text)
        if not content or not self.languages:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(content)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        odds = sum(math.exp(-min(s - sizes[best], 1000) / SCALE) for s in sizes)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        narrow = rest is not None and rest - sizes[best] < MARGIN * rest
        return self.languages[best], 1 / odds, narrow


def languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""
    get = shared(docs.sparkSession, dictionaries)

    def predict(batches):
        sizer = Sizer(get())
        for ids, texts in pieces(batches):
            found = [sizer.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()),
                pa.array(np.array([f[1] for f in found], float)),
                pa.array([f[2] for f in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])
    return id_and_text(docs).mapInArrow(
        predict, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages(docs, fit(docs)).withColumn("held_out", remainder(FOLDS) == HELD_OUT)
