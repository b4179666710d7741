"""Byte-level BPE by a shuffle of distinct words.

Documents of a partition are gathered into chunks. In a chunk every distinct pre-token gets a
local number, and the texts become sequences of these numbers: the pre-tokens with their
positions. Only the distinct words are dealt out, by a hash of the word, in packed rows; there
each is encoded once, wherever it comes from, and the ids go back to the chunks that asked.
There the sequences are read again and the ids put together by position. Decoding joins the
table of the vocabulary's bytes, which the vocabulary bounds.

The chunk's words and its sequences come from two scans of the input. A chunk is named by its
place and a hash of its content, so if an input were not the same twice the run fails loudly.

Cases: null text is empty text; empty texts have no ids; each row of a repeated document gets its
row; ids may be null; columns other than the id and the text are never read; texts are encoded whole,
whatever their length; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.pretokens import pretokens
from capture_analytics.llm.tables import documents, id_and_text, pieces, shared
from capture_analytics.llm.tokens import expand

RANKS = "byte_bpe_50k.tiktoken"
# A chunk is closed at this many characters or distinct words.
CHUNK_CHARS = 12 << 20
CHUNK_WORDS = 300_000
ROWS = "chunk long, content long, kind int, part int, packed binary"
IDS = "doc_id long, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(*values) -> bytes:
    return zstandard.compress(pickle.dumps(values, protocol=5), 1)


def unpack(packed: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(packed))


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Numbers(dict):
    """Numbers for words in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def chunks(batches):
    """(name, content hash, words, sequences) of every chunk of a partition's documents;
    a sequence is doc ids, numbers of words in each document, and the word numbers."""
    place, numbers, sequences, chars = 0, Numbers(), [], 0
    content = xxhash.xxh3_64()

    def closed():
        return place, int(np.uint64(content.intdigest()).astype(np.int64)), list(numbers), sequences

    def placed():
        nonlocal place
        for batch in batches:
            if not sequences and batch.num_rows and place == 0:
                place = batch["place"][0].as_py() << 32
            yield batch
    for ids, texts in pieces(placed()):
        words, first = pretokens(texts)
        sequence = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
        sequences.append((ids, np.diff(first), sequence))
        content.update(repr(ids).encode())
        content.update("".join(words).encode())
        chars += sum(map(len, words))
        if chars >= CHUNK_CHARS or len(numbers) >= CHUNK_WORDS:
            yield closed()
            place += 1
            numbers, sequences, chars = Numbers(), [], 0
            content.reset()
    if sequences:
        yield closed()


def rows(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["chunk", "content", "kind", "part", "packed"])


def word_rows(n_parts: int):
    """A chunk's distinct words, in one packed row for each of `n_parts` hashes of the word."""
    def run(batches):
        for chunk, content, words, _ in chunks(batches):
            part = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % n_parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
            for p in range(n_parts):
                own = order[cuts[p]:cuts[p + 1]]
                if len(own):
                    packed = pack(planes(own), [words[i] for i in own.tolist()])
                    yield rows([chunk], [content], [0], [p], [packed])
    return run


def sequence_rows(batches):
    """A chunk's word sequences with the number of its words."""
    for chunk, content, words, sequences in chunks(batches):
        for i, (ids, counts, sequence) in enumerate(sequences):
            packed = pack(len(words), ids, counts.astype(np.uint32), planes(sequence))
            yield rows([chunk], [content], [1], [i], [packed])


def encoder(get, pattern: str):
    """Encode the words of each part, each distinct one once."""
    def run(batches):
        encode = encoding(get(), pattern).encode_ordinary
        part, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, known = row["part"], {}
                numbers, words = unpack(row["packed"])
                found = []
                for word in words:
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word)
                    found.append(ids)
                lengths = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
                yield rows([row["chunk"]], [row["content"]], [0], [part],
                           [pack(numbers, planes(lengths), planes(flat))])
    return run


def assemble(batches):
    """(doc ids, number of ids of each, all ids) from the rows of each chunk, its words first."""
    own, parts, table = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["chunk"], row["content"]
            if key != own:
                own, parts, table = key, [], None
            if row["kind"] == 0:
                parts.append([from_planes(x) for x in unpack(row["packed"])])
                continue
            n_words, ids, counts, sequence = unpack(row["packed"])
            if table is None:
                number = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint32)])
                if len(number) != n_words:
                    raise RuntimeError("the input was not the same in two scans")
                lengths = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint32)])
                flat = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.uint32)])
                first = np.cumsum(lengths, dtype=np.int64) - lengths
                length_of, first_of = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
                length_of[number], first_of[number] = lengths, first
                table, parts = (length_of, first_of, flat), []
            length_of, first_of, flat = table
            sequence = from_planes(sequence)
            found = flat[expand(first_of[sequence], length_of[sequence])]
            ends = np.concatenate([[0], np.cumsum(length_of[sequence])])
            counts = counts.astype(np.int64)
            yield ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]), found


def gathered(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The rows of all chunks: encoded words, then sequences, together and in order."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    get = shared(spark, ranks)
    # the scan's own partition number, the same in both branches
    plain = id_and_text(docs).withColumn("place", F.spark_partition_id())
    words = plain.mapInArrow(word_rows(n_parts), ROWS)
    encoded = words.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(
        encoder(get, pattern), ROWS)
    both = encoded.unionByName(plain.mapInArrow(sequence_rows, ROWS))
    return both.repartition(n_parts, "chunk").sortWithinPartitions("chunk", "content", "kind", "part")


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids of every document, by the ranks in the file at `path`."""
    def run(batches):
        for ids, counts, found in assemble(batches):
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(found.astype(np.int32)))], ["doc_id", "ids"])
    return gathered(docs, read_ranks(path), pattern).mapInArrow(run, IDS)


class TokenBytes:
    """The bytes of every id, as one array with offsets."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.all[expand(self.first[ids], self.lengths[ids])]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of every row of doc_id and ids."""
    get = shared(encoded.sparkSession, TokenBytes(read_ranks(path)))

    def run(batches):
        table = get()
        for batch in batches:
            found = [table.decode(np.asarray(x, np.int64)).tobytes()
                     for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())],
                                             ["doc_id", "bytes"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN,
               with_ids: bool = False) -> DataFrame:
    """Digests of every document's ids and of their decoded bytes, with the ids if asked."""
    ranks = read_ranks(path)
    get = shared(docs.sparkSession, TokenBytes(ranks))

    def run(batches):
        table = get()
        for ids, counts, found in assemble(batches):
            ends = np.concatenate([[0], np.cumsum(counts)])
            found = found.astype("<u4")
            text = table.decode(found)
            places = np.concatenate([[0], np.cumsum(table.lengths[found])])[ends]
            digest = lambda x: hashlib.sha256(x.tobytes()).hexdigest()
            columns = [
                pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
                pa.array([digest(found[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                pa.array([digest(text[a:b]) for a, b in zip(places[:-1], places[1:])], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(found.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return gathered(docs, ranks, pattern).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else ""))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS))
