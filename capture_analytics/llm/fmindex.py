"""Benchmark decontamination by an FM-index over each shard of training documents.

A shard is a run of whole documents. Its words become symbols: a word of the benchmark gets its
number in the benchmark's vocabulary, every run of other words one separator, as does the end of
a document. Over this sequence the shard gets a suffix array, its Burrows-Wheeler transform as
a wavelet matrix, and sampled suffix positions. Test phrases are searched backwards, all at once;
rows found are walked to the next sampled position, and the spans are merged per document.
No document leaves its task, so there is no shuffle.

Cases: a null or empty text has no words and no hits; an item without words is left out; an item id that
comes in several rows counts once, repeated documents each get their row; an empty benchmark hits nothing; columns
other than the id and the text are never read. An item without an id hits words and counts as an item, and
adds nothing to the digest; an empty table of documents gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import documents, id_and_text, pieces, shared, without
from capture_analytics.llm.tokens import ALNUM, Words, expand

WINDOW = 13
# Characters of the benchmark that are searched at a time; beyond it the benchmark is worked on
# in blocks, each a pass over the documents.
BLOCK_CHARS = 8 << 20
# Characters and documents of a shard; a single longer document is a shard of its own.
SHARD_CHARS = 1 << 20
SHARD_ROWS = 1_024
SAMPLE = 16
SPANS = ("doc_id long, text_hash long, n_words long, spans array<struct<begin:long,end:long>>, "
         "items array<string>")


class Phrases:
    """The distinct windows of some items, as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words = Words([text for _, text in items], ALNUM)
        self.vocabulary = np.unique(words.hashes)
        symbols = np.searchsorted(self.vocabulary, words.hashes) + 1
        self.names = list(dict.fromkeys(name for name, _ in items))
        name_of = {name: k for k, name in enumerate(self.names)}
        rows, owners = [], []
        for i, (begin, end) in enumerate(zip(words.first[:-1], words.first[1:])):
            length = min(window, end - begin)
            if length:
                runs = np.lib.stride_tricks.sliding_window_view(symbols[begin:end], length)
                # right aligned: the search reads a phrase from its end
                padded = np.zeros((len(runs), window), np.int64)
                padded[:, window - length:] = runs
                rows.append(padded)
                owners.append(np.full(len(runs), name_of[items[i][0]]))
        self.rows = np.zeros((0, window), np.int64)
        self.item_first, self.item_of = np.zeros(1, np.int64), np.zeros(0, np.int64)
        if rows:
            self.rows, number = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            links = np.unique(np.stack([number.ravel(), np.concatenate(owners)], 1), axis=0)
            self.item_first = np.searchsorted(links[:, 0], np.arange(len(self.rows) + 1))
            self.item_of = links[:, 1]
        self.lengths = (self.rows > 0).sum(1)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence in which every 0 is an end mark of its own, in text order.

    Ranks are doubled, and only suffixes whose rank is shared with others are sorted again.
    """
    n = len(symbols)
    marks = symbols == 0
    rank = symbols + (int(marks.sum()) - 1)
    rank[marks] = np.arange(int(marks.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    # a rank is the row at which the group of equal prefixes begins
    keys = rank[order]
    begins = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank[order] = group
    alone = begins & np.concatenate([begins[1:], [True]])
    open_rows = np.flatnonzero(~alone)
    while len(open_rows):
        places = order[open_rows]
        nexts = rank[np.minimum(places + step, n - 1)]
        keys = rank[places] * n + nexts
        sort = np.argsort(keys, kind="stable")
        places, keys = places[sort], keys[sort]
        order[open_rows] = places
        begins = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[places] = open_rows[np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))]
        alone = begins & np.concatenate([begins[1:], [True]])
        open_rows = open_rows[~alone]
        step *= 2
    return order


class Index:
    """FM-index of a sequence that begins and ends with 0, with symbols up to `largest`."""

    def __init__(self, symbols: np.ndarray, largest: int):
        n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        # positions after a separator are sampled too, so a walk never meets a separator
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.levels = []
        starts = np.zeros(largest + 1, np.int64)
        names = np.arange(largest + 1)
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1 == 1
            zeros_before = np.zeros(n + 1, np.int32)
            np.cumsum(~ones, out=zeros_before[1:])
            zeros = int(zeros_before[-1])
            self.levels.append((bit, zeros_before, zeros))
            last = np.concatenate([last[~ones], last[ones]])
            before = zeros_before[starts]
            starts = np.where((names >> bit) & 1 == 1, zeros + starts - before, before)
        self.starts = starts

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        for bit, zeros_before, zeros in self.levels:
            before = zeros_before[row]
            row = np.where((symbol >> bit) & 1 == 1, zeros + row - before, before)
        return row - self.starts[symbol]

    def previous(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol = np.zeros(len(row), np.int64)
        for bit, zeros_before, zeros in self.levels:
            before = zeros_before[row]
            one = zeros_before[row + 1] == before
            symbol |= one.astype(np.int64) << bit
            row = np.where(one, zeros + row - before, before)
        return self.begin[symbol] + row - self.starts[symbol]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the right-aligned phrases that occur."""
        which = np.arange(len(rows))
        low = self.begin[rows[:, -1]].copy()
        high = self.begin[rows[:, -1] + 1].copy()
        for column in range(rows.shape[1] - 2, -1, -1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            symbol = rows[which, column]
            more = symbol > 0
            if not more.any():
                break
            symbol = symbol[more]
            low[more] = self.begin[symbol] + self.rank(symbol, low[more])
            high[more] = self.begin[symbol] + self.rank(symbol, high[more])
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The place in the sequence at which each row's suffix begins."""
        place = np.empty(len(row), np.int64)
        left, steps = np.arange(len(row)), 0
        while len(left):
            done = self.sampled[row]
            place[left[done]] = self.samples[self.sample_rank[row[done]]] + steps
            left, row = left[~done], self.previous(row[~done])
            steps += 1
        return place


def occurrences(phrases: Phrases, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, number of the first word) of every occurrence in the shard's documents."""
    none = np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(words.hashes):
        return none, none
    near = np.minimum(np.searchsorted(phrases.vocabulary, words.hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[near] == words.hashes
    numbers = np.flatnonzero(known)
    if not len(numbers):
        return none, none
    # a separator before every known word that does not follow one of its own document
    fresh = np.concatenate([[True], np.diff(numbers) > 1])
    heads = np.zeros(len(words.hashes) + 1, bool)
    heads[words.first[:-1]] = True
    fresh |= heads[numbers]
    places = np.arange(len(numbers)) + np.cumsum(fresh)
    symbols = np.zeros(places[-1] + 2, np.int64)
    symbols[places] = near[numbers] + 1
    word_at = np.zeros(len(symbols), np.int64)
    word_at[places] = numbers
    index = Index(symbols, len(phrases.vocabulary))
    which, low, high = index.search(phrases.rows)
    rows = expand(low, high - low)
    return np.repeat(which, high - low), word_at[index.locate(rows)]


def shard_spans(phrases: Phrases, texts: list[str | None]):
    """Per document: number of words, merged spans of hit words, names of the items found."""
    words = Words(texts, ALNUM)
    which, begins = occurrences(phrases, words)
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + phrases.lengths[which], -1)
    hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    opens, closes = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    doc_of = np.searchsorted(words.first, begins, side="right") - 1
    n_items = phrases.item_first[which + 1] - phrases.item_first[which]
    found = np.unique(np.stack([np.repeat(doc_of, n_items), phrases.item_of[
        expand(phrases.item_first[which], n_items)]], 1), axis=0)
    spans, items = [[] for _ in texts], [[] for _ in texts]
    # hit words of neighbouring documents may touch, so a run is cut where a document begins
    for begin, end in zip(opens.tolist(), closes.tolist()):
        doc = int(np.searchsorted(words.first, begin, side="right")) - 1
        while begin < end:
            stop = min(end, int(words.first[doc + 1]))
            if begin < stop:
                spans[doc].append({"begin": begin - int(words.first[doc]),
                                   "end": stop - int(words.first[doc])})
            begin, doc = stop, doc + 1
    for doc, item in found.tolist():
        items[doc].append(phrases.names[item])
    return words.counts, spans, items


def block_spans(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """One row per document with the merged spans of one block of benchmark items."""
    get = shared(docs.sparkSession, Phrases(items, window))

    def search(batches):
        phrases = get()
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()),
                            ("n_words", pa.int64()),
                            ("spans", pa.list_(pa.struct([("begin", pa.int64()),
                                                          ("end", pa.int64())]))),
                            ("items", pa.list_(pa.string()))])

        def keyed():
            for batch in batches:
                ids = pa.StructArray.from_arrays([batch["doc_id"], batch["text_hash"]],
                                                 ["doc_id", "text_hash"])
                yield pa.RecordBatch.from_arrays([ids, batch["text"]], ["key", "text"])
        for keys, texts in pieces(keyed(), SHARD_CHARS, SHARD_ROWS):
            counts, spans, found = shard_spans(phrases, texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([k["doc_id"] for k in keys], pa.int64()),
                pa.array([k["text_hash"] for k in keys], pa.int64()),
                pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type),
                pa.array(found, schema.field("items").type)], schema=schema)

    keyed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return keyed.select("doc_id", "text_hash", "text").mapInArrow(search, SPANS)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text_hash, n_words, spans and items of every document: the words covered by any
    occurrence of a benchmark window, as merged [begin, end) word numbers, and its items' ids."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        block = [(r[0], r[1]) for r in items.where(number == k).collect()]
        part = block_spans(docs, block, window)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = merge_blocks(docs, found)
    return found.select("doc_id", "text_hash", "n_words", "spans", "items")


def merge_blocks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Join the spans that several blocks of items gave for the same document."""
    copies = id_and_text(docs).groupBy(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).agg(
        F.count("*").alias("copies"))
    merged = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # a span that begins inside what is covered so far makes the last one longer
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"),
                         lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["begin"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["begin"].alias("begin"),
            F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    return merged.withColumn("spans", joined).join(
        copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    ).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))


def verdicts(spans: DataFrame) -> DataFrame:
    """The spans as counts, a digest of the items, and the contamination rule."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    listed = F.concat_ws(",", F.array_sort("items"))
    return spans.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the contamination rule leaves, with all their columns."""
    return without(docs, verdicts(contaminated_spans(docs, benchmark)).where("contaminated"))


def op8_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return verdicts(contaminated_spans(documents(spark, sf_dir), benchmark)).drop("text_hash")


# What one document's row must be, in plain Python; the tests hold the operator against it.
def brute_force(texts: list[str | None], items: list[tuple[str, str | None]],
                window: int = WINDOW) -> list[tuple]:
    import re
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: pattern.findall((t or "").translate(lower))
    rows = []
    for text in texts:
        words, hit, found = split(text), set(), set()
        for name, item in items:
            item = split(item)
            n = min(window, len(item))
            wanted = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i:i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add(str(name))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((len(words), len(hit), len(found), digest,
                     bool(hit) and 20 * len(hit) >= len(words)))
    return rows
