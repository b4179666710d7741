"""Substring dedup: repeated passages, found by Aho-Corasick automata over sharded phrases.

1. Anchors. In each window of 50 words the smallest hash of its 8-word runs is the window's anchor:
   equal windows have equal anchors, and neighbours mostly share one. An anchor that occurs in
   two documents is recurring; a map-side aggregate of the smallest and largest id tells.
2. Recurring passages. Windows with a recurring anchor are confirmed by the hash of all their
   words; each confirmed window belongs to the smallest document that has it. Owners join their
   windows and cut their texts into passages: runs of owned windows.
3. Automata. Passages are dealt into shards of bounded length by their owner. A document's windows are
   joined with the confirmed ones, which tells the shards that own any of them; the parts of its
   text that may recur go there. Shards that much text needs get several blocks, each with the
   shard's passages. A task compiles the 25-word phrases at every 25th word of the passages into
   an automaton (each window of a passage holds one of them in full), streams the parts through
   it, and at each occurrence confirms the windows around it.
4. The spans found in all shards are merged per document.

Bit sets of fixed size keep windows and documents that cannot recur from being shuffled; an exact
aggregate or join follows everywhere, so they never decide a result.

Cases: null and empty texts have no words; a window that recurs inside one document only stays;
rows that repeat a doc_id do not remove each other's words, and each gets its result; a
null doc_id neither owns passages nor loses words; texts are read whole, whatever their length; an
empty table gives no rows; other columns, whatever their names, are not read, and kept by the filter.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import (
    bit_set, documents, filtered_by_id, fresh, id_and_text, marked_by_id, pieces, shared,
    written)
from capture_analytics.llm.tokens import SAME, SPACED, U, Words, rolling, shingles, signed

WINDOW = 50
ANCHOR = 8
PHRASE = 25
# Characters of passages in a shard, and of the segments of a block.
SHARD_CHARS = 1 << 20
BLOCK_CHARS = 4 << 20
# Bits of the set of recurring windows.
WINDOW_BITS = 1 << 26
SPANS = "array<struct<begin:int,end:int>>"


def split(texts: list[str | None]) -> Words:
    return Words(texts, SPACED, SAME)


def window_starts(words: Words) -> np.ndarray:
    """The numbers of the words at which a window fits into its document."""
    fits = np.zeros(len(words.hashes) + 1, np.int64)
    long = words.counts >= WINDOW
    np.add.at(fits, words.first[:-1][long], 1)
    np.add.at(fits, words.first[1:][long] - WINDOW + 1, -1)
    return np.flatnonzero(np.cumsum(fits) > 0)


def anchors(words: Words) -> np.ndarray:
    """The anchor of the window at every word; only those at `window_starts` mean anything."""
    least, width = shingles(words.hashes, ANCHOR), 1
    target = WINDOW - ANCHOR + 1
    while width < target:
        step = min(width, target - width)
        if len(least) <= step:
            return least[:0]
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def anchor_rows(batches):
    """doc_id, anchor: the anchors of each document."""
    for ids, texts in pieces(batches):
        words = split(texts)
        starts = window_starts(words)
        found = anchors(words)[starts] if len(starts) else np.zeros(0, U)
        doc = np.searchsorted(words.first, starts, side="right") - 1
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.array(ids, object)[doc[fresh]].astype(np.int64)),
            pa.array(signed(found[fresh]))], ["doc_id", "anchor"])


def candidates(words: Words, recurring, repeated=None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows that may recur, by the bit sets of anchors and of windows."""
    starts = window_starts(words)
    if not len(starts):
        return starts, np.zeros(0, U)
    starts = starts[recurring.has(anchors(words)[starts])]
    hashes = rolling(words.hashes, WINDOW)[starts]
    if repeated is not None:
        keep = repeated.has(hashes)
        starts, hashes = starts[keep], hashes[keep]
    return starts, hashes


def window_rows(get):
    """doc_id, window: the hashes of the windows that may recur."""
    def run(batches):
        sets = get()
        for ids, texts in pieces(batches):
            words = split(texts)
            starts, hashes = candidates(words, *sets)
            doc = np.searchsorted(words.first, starts, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(ids, object)[doc].astype(np.int64)), pa.array(signed(hashes))],
                ["doc_id", "window"])
    return run


def passages(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """owner, text: the passages that owners' windows make up."""
    owned = windows.groupBy("owner").agg(F.collect_list("window").alias("windows"))
    owners = filtered_by_id(docs, windows.select("owner"))

    def cut(batches):
        for batch in batches:
            owner, out_owner, out_text = batch["doc_id"].to_pylist(), [], []
            texts, wanted = batch["text"].to_pylist(), batch["windows"]
            for i, text in enumerate(texts):
                words = split([text])
                starts = window_starts(words)
                if not len(starts):
                    continue
                mine = np.isin(rolling(words.hashes, WINDOW)[starts],
                               wanted[i].values.to_numpy().view(U))
                starts = starts[mine]
                if not len(starts):
                    continue
                gaps = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(np.concatenate([[0], gaps + 1]),
                                np.concatenate([gaps, [len(starts) - 1]])):
                    begin, end = words.starts[starts[a]], words.ends[starts[b] + WINDOW - 1]
                    out_owner.append(owner[i])
                    out_text.append(words.buffer[begin:end].decode())
            yield pa.RecordBatch.from_arrays([
                pa.array(out_owner, pa.int64()), pa.array(out_text, pa.string())],
                ["owner", "text"])
    return owners.join(owned, owners["doc_id"] == owned["owner"]).select(
        "doc_id", "text", "windows").mapInArrow(
        cut, "owner long, text string")


class Automaton:
    """The phrases of some passages as an automaton, and who owns each window of the passages."""

    def __init__(self, owners: list[int], texts: list[str]):
        words = split(texts)
        starts = window_starts(words)
        hashes = rolling(words.hashes, WINDOW)[starts]
        place = np.searchsorted(words.first, starts, side="right") - 1
        owner = np.array(owners, np.int64)[place]
        # a window has one owner, but rows that repeat may give its passage twice
        self.windows, first = np.unique(hashes, return_index=True)
        self.owners = owner[first]
        self.machine = ahocorasick.Automaton()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            for begin in range(a, b - PHRASE + 1, PHRASE):
                parts = [words.buffer[i:j] for i, j in zip(
                    words.starts[begin:begin + PHRASE].tolist(),
                    words.ends[begin:begin + PHRASE].tolist())]
                # one character for each byte, so places in the text are places in its bytes
                self.machine.add_word((b" " + b" ".join(parts) + b" ").decode("latin-1"), 1)
        self.machine.make_automaton()

    def spans(self, doc_id: int, text: str | None) -> list[dict]:
        """Merged spans of words that windows of smaller documents cover."""
        parts = (text or "").encode().split()
        if len(parts) < WINDOW or self.machine.kind != ahocorasick.AHOCORASICK:
            return []
        line = (b" " + b" ".join(parts) + b" ").decode("latin-1")
        hits = np.fromiter((end for end, _ in self.machine.iter(line)), np.int64)
        if not len(hits):
            return []
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        last = np.searchsorted(ends, hits)
        # windows that hold the phrase in full
        near = np.zeros(len(parts) + 1, np.int64)
        np.add.at(near, np.maximum(last - WINDOW + 1, 0), 1)
        np.add.at(near, last - PHRASE + 2, -1)
        starts = np.flatnonzero(np.cumsum(near) > 0)
        starts = starts[starts <= len(parts) - WINDOW]
        if not len(starts):
            return []
        hashes = rolling(split([text]).hashes, WINDOW)[starts]
        at = np.minimum(np.searchsorted(self.windows, hashes), len(self.windows) - 1)
        starts = starts[(self.windows[at] == hashes) & (self.owners[at] < doc_id)]
        return merged(starts, starts + WINDOW)


def merged(begins, ends) -> list[dict]:
    """The union of spans, in order; spans that touch become one."""
    out: list[dict] = []
    for begin, end in sorted(zip(map(int, begins), map(int, ends))):
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"begin": begin, "end": end})
    return out


def segment_rows(get):
    """shard, doc_id, text_hash, begin, text: the parts of each document that windows that may
    recur make up, for each shard with an owner of its windows."""
    names = ("shard", "doc_id", "text_hash", "begin", "text")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches):
        sets = get()
        for batch in batches:
            out = []
            for doc_id, text_hash, text, shards in zip(
                    batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(),
                    batch["text"].to_pylist(), batch["shards"].to_pylist()):
                words = split([text])
                starts, _ = candidates(words, *sets)
                for span in merged(starts, starts + WINDOW):
                    part = words.buffer[words.starts[span["begin"]]:words.ends[span["end"] - 1]]
                    out.extend((shard, doc_id, text_hash, span["begin"], part.decode())
                               for shard in shards)
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
    return run


def stream(batches):
    """Segments of each block through the automaton of its shard; passages come first."""
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    own, owners, texts, machine = None, [], [], None
    for batch in batches:
        ids, hashes, spans = [], [], []
        keys = zip(batch["shard"].to_pylist(), batch["block"].to_pylist())
        for key, is_doc, doc_id, text_hash, begin, text in zip(
                keys, batch["is_doc"].to_pylist(), batch["doc_id"].to_pylist(),
                batch["text_hash"].to_pylist(), batch["begin"].to_pylist(),
                batch["text"].to_pylist()):
            if key != own:
                own, owners, texts, machine = key, [], [], None
            if not is_doc:
                owners.append(doc_id)
                texts.append(text)
                continue
            if machine is None:
                machine = Automaton(owners, texts)
                owners, texts = [], []
            found = machine.spans(doc_id, text)
            if found:
                ids.append(doc_id)
                hashes.append(text_hash)
                spans.append([{"begin": s["begin"] + begin, "end": s["end"] + begin}
                              for s in found])
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(spans, span)],
            ["doc_id", "text_hash", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans: [begin, end) word numbers, merged, of the words to remove; one
    row for each text that loses any."""
    spark = docs.sparkSession
    plain = id_and_text(docs).where(F.col("doc_id").isNotNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = plain.mapInArrow(anchor_rows, "doc_id long, anchor long")
    recurring = bit_set(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max(
        "doc_id").alias("b")).where("a <> b").select(F.col("anchor").alias("h")))
    rows, get = "doc_id long, window long", shared(spark, (recurring,))
    windows = written(plain.mapInArrow(window_rows(get), rows).groupBy("window").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where(
        "owner <> last").select("window", "owner"))
    kept = written(passages(plain, windows))
    chars = kept.agg(F.sum(F.length("text"))).first()[0]
    if not chars:
        return spark.createDataFrame([], f"doc_id long, text_hash long, spans {SPANS}")
    shard = F.pmod(F.xxhash64("owner"), F.lit(-(-chars // SHARD_CHARS))).cast("int")
    kept = kept.withColumn("shard", shard)
    repeated = bit_set(windows.select(F.col("window").alias("h")), WINDOW_BITS)
    get = shared(spark, (recurring, repeated))
    owned = windows.select(F.col("window").alias("known"), "owner", shard.alias("shard"))
    need = written(plain.mapInArrow(window_rows(get), rows).join(
        owned, (F.col("window") == F.col("known")) & (F.col("doc_id") > F.col("owner"))).groupBy(
        F.col("doc_id").alias("id")).agg(F.collect_set("shard").alias("shards")))
    asking = filtered_by_id(plain, need.select("id"))
    segments = written(asking.join(need, F.col("doc_id") == F.col("id")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text", "shards").mapInArrow(
        segment_rows(get), "shard int, doc_id long, text_hash long, begin int, text string"))
    sizes = segments.groupBy(F.col("shard").alias("of")).agg(
        F.ceil(F.sum(F.length("text")) / BLOCK_CHARS).cast("int").alias("blocks"))
    asked = segments.join(sizes, F.col("shard") == F.col("of")).select(
        "shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("blocks")).cast("int").alias(
            "block"), F.lit(True).alias("is_doc"), "doc_id", "text_hash", "begin", "text")
    offered = kept.join(sizes, F.col("shard") == F.col("of")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(False).alias("is_doc"), F.col("owner").alias("doc_id"),
        F.lit(None).cast("long").alias("text_hash"), F.lit(0).alias("begin"), "text")
    spans = offered.unionByName(asked).repartition(n, "shard", "block").sortWithinPartitions(
        "shard", "block", "is_doc").mapInArrow(
        stream, f"doc_id long, text_hash long, spans {SPANS}")
    return joined_spans(spans)


def joined_spans(spans: DataFrame) -> DataFrame:
    """The spans of several shards as one list for each text."""
    flat = F.array_sort(F.flatten(F.collect_list("spans")))
    union = F.aggregate(flat, F.expr(f"cast(array() as {SPANS})"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["begin"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["begin"].alias("begin"),
            F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    return spans.groupBy("doc_id", "text_hash").agg(union.alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The documents that lose nothing, found without a shuffle, and those that may lose words
    with their spans in a column `name`, null where they lose none."""
    spans = written(spans)
    mark, span_id, span_hash = (fresh(docs, c) for c in ("may_lose", "span_id", "span_hash"))
    marked = marked_by_id(docs, spans.select("doc_id"), mark)
    right = spans.select(F.col("doc_id").alias(span_id), F.col("text_hash").alias(span_hash),
                         F.col("spans").alias(name))
    joined = marked.where(F.col(mark)).join(
        right, (F.col("doc_id") == F.col(span_id)) & (F.xxhash64("text") == F.col(span_hash)),
        "left").drop(span_id, span_hash, mark)
    return marked.where(~F.col(mark)).drop(mark), joined


def kept_words(text: str | None, spans) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the others joined by one space."""
    parts = (text or "").encode().split()
    total = len(parts)
    for span in reversed(list(spans) if spans is not None else []):
        del parts[span["begin"]:span["end"]]
    return total, total - len(parts), b" ".join(parts)


def deduplicated(docs: DataFrame, length: str | None = None) -> DataFrame:
    """The documents without the words of repeated passages: a text that loses words is what is
    left, joined by single spaces, and its column `length`, if named, the new number of
    characters; the others stay as they are."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_words(t, s)[2].decode()
                          for t, s in zip(texts, spans)], dtype=object)
    spans = fresh(docs, "spans")
    whole, losing = with_spans(docs, repeated_spans(docs), spans)
    losing = losing.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(
        cut("text", spans)))
    if length:
        losing = losing.withColumn(length, F.when(F.col(spans).isNull(), F.col(length)).otherwise(
            F.length("text").cast(docs.schema[length].dataType)))
    return whole.unionByName(losing.drop(spans))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    def run(batches):
        for batch in batches:
            found = [kept_words(t, s) for t, s in zip(batch["text"].to_pylist(),
                                                      batch["spans"].to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])
    plain = id_and_text(docs)
    whole, losing = with_spans(plain, repeated_spans(plain), "spans")
    return whole.withColumn("spans", F.lit(None).cast(SPANS)).unionByName(losing).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


# What the operator must give, in plain Python; the tests hold it against this.
def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    owners: dict[tuple, int] = {}
    split_rows = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split_rows:
        for k in range(len(words) - WINDOW + 1 if i is not None else 0):
            window = tuple(words[k:k + WINDOW])
            owners[window] = min(i, owners.get(window, i))
    out = []
    for i, words in split_rows:
        gone: set[int] = set()
        for k in range(len(words) - WINDOW + 1 if i is not None else 0):
            if owners[tuple(words[k:k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        left = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return out
