"""Tables written to the shared folder, documents as plain columns, connected components."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tokens import U, mix, signed
from capture_analytics.session import checkpoint_dir

# Texts of a batch are worked on in pieces of about this many characters.
PIECE_CHARS = 1 << 19
PIECE_ROWS = 512

_scratch: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read; other columns may have any names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def remainder(divisor: int):
    """crc32 of the document id as text, modulo `divisor`; a null id counts as empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of `key`. A threshold on the hash, from the
    number of rows, leaves little more than that, so no task meets more as the table grows."""
    n, order = df.count(), F.xxhash64(F.lit(most), F.col(key))
    if n > most:
        df = df.where(F.shiftrightunsigned(order, 2) < int(2 ** 62 * min(1.0, 1.25 * most / n)))
    return df.orderBy(order, key).limit(most)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """A list that after the block holds the folders made in it."""
    before, own = len(_scratch), []
    yield own
    own.extend(_scratch[before:])
    del _scratch[before:]


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, and empty the list; nothing that still reads them may be left."""
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared(spark: SparkSession, value):
    """A function that gives `value` inside tasks: a broadcast that carries its classes along."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def pieces(batches, limit: int = PIECE_CHARS, rows: int = PIECE_ROWS):
    """(doc ids, texts) of at most `rows` rows and about `limit` characters from batches whose
    first two columns are those; only so much of a batch becomes Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            begin = size = 0
            for i, text in enumerate(texts):
                long = len(text) if text else 0
                if i > begin and size + long > limit:
                    yield ids[begin:i], texts[begin:i]
                    begin, size = i, 0
                size += long
            yield ids[begin:], texts[begin:]
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what it holds on
    to counts against the executor in all later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it reaches.

    Alternates two star operations until nothing changes: every node hooks its larger
    neighbours, then its smaller ones, to its smallest neighbour. The number of rounds grows with
    the logarithm of the longest path. A node with very many neighbours meets them in a plain
    aggregate and a join that Spark can split.
    """
    links = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # The second key asks for a shuffle of its own on either side of a join: a join right on top of
    # an aggregate's partitions could not be split where one node has very many neighbours.
    part = F.pmod(F.xxhash64("a"), F.lit(64)).alias("part")
    same = (F.col("a") == F.col("k")) & (F.col("part") == F.col("k_part"))
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), part.alias("k_part"), F.least("a", "m").alias("m"))
        large = both.where("b > a").select("a", "b", part).join(least, same).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), part.alias("k_part"), "m")
        hooked = large.select("a", "b", part).join(small, same).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b")).where("a <> b").distinct()
        links = written(hooked)
        found = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast(
            "decimal(38,0)")).alias("h")).first()
        if found == state:
            break
        state = found
    roots = links.select(F.col("b").alias("a"), "b").distinct()
    return links.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))


BITS = 1 << 24


class BitSet:
    """A bit set of fixed size over hashed numbers: never misses a member, may let others pass."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.view(np.uint64)
        slot = ((hashes >> np.uint64(6)) & np.uint64(len(self.words) - 1)).astype(np.int64)
        return (self.words[slot] >> (hashes & np.uint64(63))) & np.uint64(1) == 1


def _slot(h, bits: int):
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(bits // 64 - 1))


def _bits(hashes: DataFrame, bits: int) -> DataFrame:
    """slot, bits: the words of the bit set of a column `h`, at most bits / 64 rows."""
    return hashes.groupBy(_slot("h", bits).alias("slot")).agg(F.bit_or(F.expr(
        "shiftleft(1L, cast(h & 63 as int))")).alias("bits"))


def bit_set(hashes: DataFrame, bits: int = BITS) -> BitSet:
    """The bit set of a column `h` of hashes, to be sent to tasks. Its size is `bits` whatever the
    input, a power of two; it only saves shuffling rows that an exact join would drop, and a full
    one saves none."""
    rows = _bits(hashes, bits).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return BitSet(words)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def marked_by_id(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The documents with a column `name`: whether their id may be in the only column of `ids`. A
    bit set of the ids is broadcast, a table of at most BITS / 64 rows."""
    slot, bits = fresh(docs, "id_slot"), fresh(docs, "id_bits")
    own = F.xxhash64(F.col(ids.columns[0]).cast("long"))
    table = _bits(ids.select(own.alias("h")), BITS).select(
        F.col("slot").alias(slot), F.col("bits").alias(bits))
    h = F.xxhash64(F.col("doc_id").cast("long"))
    held = F.call_function("shiftrightunsigned", F.col(bits), h.bitwiseAND(F.lit(63)).cast(
        "int")).bitwiseAND(F.lit(1)) == 1
    joined = docs.join(F.broadcast(table), _slot(h, BITS) == F.col(slot), "left")
    return joined.withColumn(name, F.coalesce(held, F.lit(False))).drop(slot, bits)


def filtered_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id may be in the only column of `ids`, without a shuffle of texts."""
    name = fresh(docs, "may_have")
    return marked_by_id(docs, ids, name).where(F.col(name)).drop(name)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that are not among the rows (doc_id, text_hash) of `gone`, with all their
    columns. Only documents whose id may be among them are shuffled."""
    mark, gone_id, gone_hash = (fresh(docs, c) for c in ("may_go", "gone_id", "gone_hash"))
    gone = written(gone.select(F.col("doc_id").alias(gone_id),
                               F.col("text_hash").alias(gone_hash)).distinct())
    marked = marked_by_id(docs, gone.select(gone_id), mark)
    left = marked.where(F.col(mark)).join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (
        F.xxhash64("text") == F.col(gone_hash)), "left_anti")
    return marked.where(~F.col(mark)).unionByName(left).drop(mark)
