"""Token ids in shard files, with a minimal perfect hash index from document key to its ids.

Documents are put in ascending order of their id by a range shuffle; partition i is shard i:
    <folder>/shard-<i>.ids   the ids of its documents, one after another, little-endian, as u16
                             where the vocabulary allows it, else as u32
    <folder>/shard-<i>.idx   the index (see `Shard`)
The index holds the offset of every document, and for the distinct keys a minimal perfect hash:
bit maps of levels, each with one bit for every key that met no other there, so that the rank of
a key's bit is its slot; the slot holds a fingerprint of the key and its first document. A lookup
reads a few bits, one slot and one offset pair, whatever the size of the shard. A key that is not
stored is told by its fingerprint, up to chance 2**-32.

Files are written by the tasks through pyarrow's file systems under a name of the attempt and
renamed, so a repeated task replaces its own shard with the same content.

Cases: null text is empty text and gives just the end id; a null doc_id sorts first and is kept
but has no key; rows that repeat an id lie next to each other and the key leads to the first; an
empty table gives no shards' documents and an empty result; texts are encoded whole, whatever their
length; other columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from capture_analytics.llm.pretokens import split_texts
from capture_analytics.llm.tables import documents, id_and_text, new_folder, pieces, shared
from capture_analytics.llm.tokens import U, mix

TOKENIZER = "byte_bpe_50k.json"
END = 2
# Bits of a level for each key that is left.
GAMMA = 2
# Distinct pre-tokens whose ids a task remembers.
REMEMBER = 500_000
MANIFEST = "shard long, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ranks = np.cumsum(np.concatenate([[0], *levels]).astype(np.int64))
        self.ranks = ranks
        sizes = np.array([len(x) for x in levels], np.int64)
        self.begins = np.cumsum(sizes) - sizes

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, GAMMA * len(left))
            place = cls.place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for some of the keys that are not stored."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = self.place(keys[left], level, len(bits))
            hit = bits[place]
            slot[left[hit]] = self.ranks[self.begins[level] + place[hit]]
            left = left[~hit]
        return slot


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U(0xD6E8FEB86659FD93)) >> U(32)).astype(np.uint32)


class Shard:
    """Index of one shard. In the file: the length of a JSON header as u32, the header (the width of
    an id in bytes, counts and sizes of the levels), then keys i64, whether each is null u8, offsets u64 (one more than
    documents), fingerprints u32, first documents u32, and the levels' bits."""

    def __init__(self, width, keys, nulls, offsets, prints, firsts, perfect: PerfectHash):
        self.width, self.keys, self.nulls, self.offsets = width, keys, nulls, offsets
        self.prints, self.firsts, self.perfect = prints, firsts, perfect

    @classmethod
    def build(cls, width: int, ids: list, lengths: list) -> Shard:
        nulls = np.array([i is None for i in ids], bool)
        keys = np.array([0 if i is None else i for i in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.uint64))]).astype(np.uint64)
        known = np.flatnonzero(~nulls)
        distinct, first = np.unique(keys[known], return_index=True)
        perfect = PerfectHash.build(distinct.view(U))
        slots = perfect.slots(distinct.view(U))
        prints, firsts = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
        prints[slots] = fingerprints(distinct.view(U))
        firsts[slots] = known[first]
        return cls(width, keys, nulls, offsets, prints, firsts, perfect)

    def dump(self) -> bytes:
        head = json.dumps({"width": self.width, "docs": len(self.keys), "slots": len(self.prints),
                           "levels": [len(x) for x in self.perfect.levels]}).encode()
        return b"".join([
            np.array([len(head)], "<u4").tobytes(), head, self.keys.astype("<i8").tobytes(),
            self.nulls.astype(np.uint8).tobytes(), self.offsets.astype("<u8").tobytes(),
            self.prints.astype("<u4").tobytes(), self.firsts.astype("<u4").tobytes(),
            *(np.packbits(x).tobytes() for x in self.perfect.levels)])

    @classmethod
    def load(cls, data: bytes) -> Shard:
        size = int(np.frombuffer(data, "<u4", 1)[0])
        head, at = json.loads(data[4:4 + size]), 4 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out
        keys, nulls = take("<i8", head["docs"]), take("u1", head["docs"]).astype(bool)
        offsets = take("<u8", head["docs"] + 1)
        prints, firsts = take("<u4", head["slots"]), take("<u4", head["slots"])
        levels = [np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool)
                  for n in head["levels"]]
        return cls(head["width"], keys, nulls, offsets, prints, firsts, PerfectHash(levels))

    def ids(self, payload, document: int) -> np.ndarray:
        """The ids of one document from the opened payload, as u32."""
        begin, end = int(self.offsets[document]), int(self.offsets[document + 1])
        data = payload.read_at(self.width * (end - begin), self.width * begin)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of every key, -1 where the key is not stored."""
        keys = np.asarray(keys, np.int64).view(U)
        slot = self.perfect.slots(keys)
        stored = slot >= 0
        stored[stored] = self.prints[slot[stored]] == fingerprints(keys[stored])
        out = np.full(len(keys), -1, np.int64)
        out[stored] = self.firsts[slot[stored]]
        return out


class Encoder(dict):
    """Ids of texts by the tokenizers library; as a dict, the ids of the pre-tokens met so far. The
    library's model encodes each pre-token as it does within a whole text; a text that is left whole, or
    that holds an added token of the tokenizer, goes to the tokenizer."""

    def __init__(self, definition: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(size)]
        self.tokens = self.tokenizer.model.tokenize
        # the model knows bytes by printable characters: the shifted ones are those that are not
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shifted = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(0x100 + k) for k, b in enumerate(shifted)}
        self.blank = self.alphabet[0x20]

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            spelled = word.replace(" ", self.blank)
        else:
            spelled = word.encode().decode("latin-1").translate(self.alphabet)
        self[word] = ids = b"".join([self.packed[t.id] for t in self.tokens(spelled)])
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, little-endian, in the width of the vocabulary."""
        marked = [k for k, t in enumerate(texts) if t and any(a in t for a in self.added)]
        parts = list(texts)
        for k in marked:
            parts[k] = None
        words, first, whole = split_texts(parts)
        if len(self) > REMEMBER:
            self.clear()
        for k in whole:
            for word in words[first[k]:first[k + 1]]:
                self[word] = self.by_tokenizer(word)
        ids = list(map(self.__getitem__, words))
        out = [b"".join(ids[a:b]) for a, b in zip(first[:-1], first[1:])]
        for k in marked:
            out[k] = self.by_tokenizer(texts[k])
        return out

    def by_tokenizer(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI, or the local one, and the path in it."""
    if ":/" in folder:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def write_ids(docs: DataFrame, folder: str, definition: str, end: int = END) -> list[tuple]:
    """Write the shards below `folder`; (shard, n_docs, n_tokens) of each, in order."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    get = shared(spark, definition)
    def write(batches):
        encoder, shard = Encoder(get()), TaskContext.get().partitionId()
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name, draft = f"{root}/shard-{shard:06d}", f"{root}/draft-{uuid.uuid4().hex}"
        closing, keys, lengths = np.array([end], f"<u{encoder.width}").tobytes(), [], []
        with files.open_output_stream(draft) as out:
            for ids, texts in pieces(batches):
                for key, found in zip(ids, encoder.encode(texts)):
                    out.write(found + closing)
                    keys.append(key)
                    lengths.append(len(found) // encoder.width + 1)
        files.move(draft, f"{name}.ids")
        with files.open_output_stream(draft) as out:
            out.write(Shard.build(encoder.width, keys, lengths).dump())
        files.move(draft, f"{name}.idx")
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int64()), pa.array([len(keys)], pa.int64()),
            pa.array([sum(lengths)], pa.int64())], ["shard", "n_docs", "n_tokens"])

    order = (F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
    manifest = id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).repartitionByRange(
        n, *order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST)
    return sorted(tuple(r) for r in manifest.collect())


def read_ids(spark: SparkSession, folder: str, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document. Each document is
    looked up by its key in the shard's index, and its ids are read from the payload."""
    base, starts = 0, []
    for shard, n_docs, n_tokens in manifest:
        if n_docs:
            starts.append((shard, base))
        base += n_tokens

    def read(batches):
        files, root = opened(folder)
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist()):
                with files.open_input_file(f"{root}/shard-{shard:06d}.idx") as data:
                    index = Shard.load(data.read())
                found = index.find(index.keys)
                # null ids and further rows of an id have no key of their own
                row = np.arange(len(found))
                own = ~index.nulls & np.concatenate(
                    [[True], (index.keys[1:] != index.keys[:-1]) | index.nulls[:-1]])
                row[own] = found[own]
                offsets = index.offsets.astype(np.int64)
                with files.open_input_file(f"{root}/shard-{shard:06d}.ids") as payload:
                    sums = [zlib.crc32(index.ids(payload, r).tobytes()) for r in row.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(index.keys, pa.int64(), mask=index.nulls),
                    pa.array(base + offsets[row], pa.int64()),
                    pa.array(offsets[row + 1] - offsets[row], pa.int64()),
                    pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    plan = spark.createDataFrame(starts, "shard long, base long")
    if len(starts) > 1:
        plan = plan.repartitionByRange(len(starts), "shard")
    return plan.mapInArrow(read, ROWS)


def lookup(folder: str, manifest: list[tuple], key: int) -> np.ndarray | None:
    """The ids of one document by its key; the shard is found by the keys' order."""
    files, root = opened(folder)
    for shard, n_docs, _ in manifest:
        if not n_docs:
            continue
        with files.open_input_file(f"{root}/shard-{shard:06d}.idx") as data:
            index = Shard.load(data.read())
        at = int(index.find([key])[0])
        if at >= 0 and index.keys[at] == key and not index.nulls[at]:
            with files.open_input_file(f"{root}/shard-{shard:06d}.ids") as payload:
                return index.ids(payload, at)
    return None


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(TOKENIZER)) as definition:
        text = definition.read()
    folder = new_folder(spark)
    return read_ids(spark, folder, write_ids(documents(spark, sf_dir), folder, text))
