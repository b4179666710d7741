"""Language-model scores by class-based bigrams over exchange-clustered word classes.

Counts. Words and their counts over all training documents are aggregated by Spark. Words are
told apart by 64-bit hashes.
Units. Every word of the training documents is a unit of its own, and so is the end of a document,
which is a class of its own. The at most `LOOKUP` most frequent words are numbered, and their classes
are broadcast; the first `HEADS` of them are heads. Bigrams are counted once: those of two frequent
words as blocks of a table, the others with the words that are not frequent. Those lie in blocks by
their hash, a row for about `BLOCK_TOKENS` of their places, whose number grows with the table.
Exchange. In each turn Spark sums, from those counts and the present classes, how often each
frequent word is followed and preceded by each class, and the class bigrams of all words. In one turn
the driver moves the heads, at most heads x classes x 2 numbers, one after another to the class that
raises the bigram likelihood most, with class counts kept up to date; in the next all other words
move in Spark, each by its own neighbour classes and the class bigrams. A word that is not frequent
learns the classes of such neighbours from what their blocks send to its own. It ends when both turns raise the likelihood by less
than the share `STOP`, or after `ROUNDS` rounds; the classes of the best turn stay.
Model. P(word | before) = P(class | class before) P(word | class), the first with `ADD` added to
each class pair, the second with 0.1 added to each word of the class and to one unknown word, so
both sum to one. An unknown word may be of any class, so its probability is summed over them; the
class after it is that after a word seen once. What frequent
words give is known where the text is; the places of other words meet their counts and classes in the
word's block, then each other, `TOGETHER` documents at a time.

Cases: null and empty texts have no words, just their end; without training documents every word is
unknown and the base gives 0 for a token; each row of a repeated document gets its score and
counts for training; a null doc_id counts as empty text for the fold; texts are read whole, whatever
their length; of words with equal counts those with smaller hashes are numbered first; of classes that raise the likelihood alike the first is taken; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import (
    delete, documents, id_and_text, pieces, remainder, scratch, shared, written)
from capture_analytics.llm.tokens import U, Words, signed

HEADS = 8_192
CLASSES = 32
ROUNDS = 4
# A round that raises the likelihood by less than this share is the last.
STOP = 0.001
# Frequent words are counted in so many blocks, their neighbours in so many parts of each.
BLOCKS = 1024
SIDES = 16
LOOKUP = 1 << 18
ADD = 0.1
FOLDS = 10
# Tokens whose counts a task combines before it sends them.
COMBINE = 4_000_000
END = U(0x5851F42D4C957F2D)
# Blocks of words while all are counted; what a block holds is merged as it comes.
COUNT_BLOCKS = 4096
# Tokens of less frequent words in a block of them, and words that are moved at once.
BLOCK_TOKENS = 1 << 16
SLICE = 8192


def combined(parts, limit: int = COMBINE):
    """Merge (keys, counts) pairs until they hold `limit` keys; yields unique keys and sums."""
    held, size = [], 0
    for keys, counts in parts:
        held.append((keys, counts))
        size += len(keys)
        if size >= limit:
            yield merged(held)
            held, size = [], 0
    if held:
        yield merged(held)


def merged(held):
    keys, counts = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def tallied(parts, limit: int = COMBINE):
    """Unique keys and how often they occur, for about `limit` keys at a time."""
    held, size = [], 0
    for keys in parts:
        held.append(keys)
        size += len(keys)
        if size >= limit:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


class Units:
    """Numbers of the frequent words, the heads first; the last number is the end's. Any other word
    is a unit under its hash."""

    def __init__(self, words: np.ndarray, heads: int | None = None):
        self.words = np.append(words, END)
        self.heads = len(words) if heads is None else min(heads, len(words))
        self.size = len(self.words)
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]
        # where the words with the same first bits begin; there are about four such ranges a word
        bits = self.size.bit_length() + 2
        self.shift = U(64 - bits)
        self.begin = np.searchsorted(self.sorted, np.arange(1 << bits, dtype=U) << self.shift)
        self.begin = np.append(self.begin, self.size).astype(np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those without one."""
        start = (hashes >> self.shift).astype(np.int64)
        near, end = self.begin[start], self.begin[start + 1]
        number = np.full(len(hashes), -1)
        left = np.flatnonzero(near < end)
        near, end, hashes = near[left], end[left], hashes[left]
        while len(left):
            same = self.sorted[near] == hashes
            number[left[same]] = self.order[near[same]]
            on = np.flatnonzero(~same & (near + 1 < end))
            left, near, end, hashes = left[on], near[on] + 1, end[on], hashes[on]
        return number

    def sequence(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and numbers of all texts with an end before and after each, and where each text
        begins."""
        places = np.arange(1, len(words.hashes) + 1) + np.repeat(
            np.arange(len(words.counts)), words.counts)
        line = np.full(len(words.hashes) + len(words.first), END, U)
        line[places] = words.hashes
        return line, self.of(line), words.first[:-1] + np.arange(len(words.first) - 1)


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow binaries that hold so many of the values each."""
    ends = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def opened(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values in a column of binaries, and the row of each."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    total = (int(ends[-1]) - int(ends[0])) // size if len(column) else 0
    values = np.frombuffer(data, kind, total, int(ends[0])) if total else np.empty(0, kind)
    return values, np.repeat(np.arange(len(column)), np.diff(ends) // size)


PACKED = "block int, part int, cells binary, times binary"
MOST = (1 << 31) - 1


def packed(block: np.ndarray, part: np.ndarray, cells: np.ndarray, times: np.ndarray):
    """A row for each part, of entries that are sorted by part. A count beyond `MOST` is written as
    several entries."""
    if len(times) and times.max() > MOST:
        entries = -(-times // MOST)
        block, part, cells = (np.repeat(c, entries) for c in (block, part, cells))
        split = np.full(len(cells), MOST)
        split[np.cumsum(entries) - 1] = times - (entries - 1) * MOST
        times = split
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    counts = np.diff(np.append(first, len(part)))
    return pa.RecordBatch.from_arrays([
        pa.array(block[first], pa.int32()), pa.array(part[first], pa.int32()),
        blobs(cells.astype(np.int32), counts), blobs(times.astype(np.int32), counts)],
        ["block", "part", "cells", "times"])


def folded(rows: DataFrame) -> DataFrame:
    """One row for each part, with the sums of its cells."""
    def run(batches):
        held, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, row = opened(batch["cells"], np.int32)
            part = batch["part"].to_numpy().astype(np.int64)
            own = (part[row] << 32) | cells, opened(batch["times"], np.int32)[0].astype(np.int64)
            keys, times = merged([held, own] if held else [own])
            blocks = dict(zip(part.tolist(), batch["block"].to_pylist()))
            if held:
                blocks.setdefault(int(held[0][0] >> 32), block)
            # the last part may go on in the next batch
            cut = int(np.searchsorted(keys, (keys[-1] >> 32) << 32))
            if cut:
                yield whole(keys[:cut], times[:cut], blocks)
            held, block = (keys[cut:], times[cut:]), blocks[int(keys[-1] >> 32)]
        if held:
            yield whole(*held, {int(held[0][0] >> 32): block})

    def whole(keys, times, blocks):
        part = keys >> 32
        own, place = np.unique(part, return_inverse=True)
        block = np.array([blocks[p] for p in own.tolist()])
        return packed(block[place], part, keys & 0xFFFFFFFF, times)
    return rows.repartition("block").sortWithinPartitions("part").mapInArrow(run, PACKED)


def links(docs: DataFrame, get) -> DataFrame:
    """How often each frequent word stands beside each other one, on either side: parts of the words
    with the same remainder by `BLOCKS`, and of their neighbours with the same one by `SIDES`."""
    def run(batches):
        units = get()
        near_cells = units.size // SIDES + 1
        cells = (units.size // BLOCKS + 1) * near_cells * 2

        def parts():
            for _, texts in pieces(batches):
                number = units.sequence(Words(texts))[1]
                a, b = number[:-1], number[1:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for side, word, near in ((0, a, b), (1, b, a)):
                    part = word % BLOCKS * SIDES + near % SIDES
                    yield part * cells + (word // BLOCKS * near_cells + near // SIDES) * 2 + side
        for keys, n in tallied(parts()):
            part = keys // cells
            yield packed(part // SIDES, part, keys % cells, n)
    return folded(docs.mapInArrow(run, PACKED))


# A block of words that are not frequent: each word with its class and count; the frequent words beside
# it as twice their number, one more for those before it, with how often they stand there; the hashes of
# the other words beside it (side 1: before it). `*_at` is the word that an entry belongs to.
WORDS = {"words": np.int64, "classes": np.int32, "counts": np.int64}
STATIC = WORDS | {"near_at": np.int32, "near": np.int32, "near_times": np.int64, "far_at": np.int32,
                  "far": np.int64, "far_side": np.int8, "far_times": np.int64}
# the classes of the other words beside each word, those before it raised by the number of classes
SLOTS = {"slot_at": np.int32, "slot": np.int32, "slot_times": np.int64}
SENT = {"to": np.int64, "to_slot": np.int32, "to_times": np.int64}
COUNTED = {"word": np.int64, "n": np.int64}
PLACES = {"word": np.int64, "beside": np.int64, "kind": np.int8}


def schema(kinds) -> str:
    return ", ".join(["block long", *(f"{c} binary" for c in kinds)])


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes.view(U) >> U(32)) % U(blocks)).astype(np.int64)


def block_batch(kinds, block, columns) -> pa.RecordBatch:
    """A row for each block; a column is its values and how many of them each block has."""
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(
        blobs(columns[c][0].astype(kind, copy=False), columns[c][1]) if c in columns
        else pa.nulls(len(block), pa.binary()) for c, kind in kinds.items())], ["block", *kinds])


def one_block(kinds, block: int, columns) -> pa.RecordBatch:
    return block_batch(kinds, [block], {c: (v, [len(v)]) for c, v in columns.items()})


def by_key(kinds, key: np.ndarray, columns) -> pa.RecordBatch:
    """Entries in any order as a row for each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    counts = np.diff(np.append(first, len(key)))
    return block_batch(kinds, key[first], {c: (v[order], counts) for c, v in columns.items()})


def blocks_in(batches, kinds):
    """(block, columns) of each row; a null column is None."""
    for batch in batches:
        columns = {c: batch[c] for c in kinds}
        for i, block in enumerate(batch["block"].to_pylist()):
            yield block, {c: values_of(columns[c][i], kind) for c, kind in kinds.items()}


def values_of(value, kind):
    buffer = value.as_buffer()
    if buffer is None:
        return None
    return np.frombuffer(buffer, kind) if buffer.size else np.empty(0, kind)


def whole_blocks(batches, kinds):
    """(block, rows) of sorted rows."""
    held, block = [], None
    for own, columns in blocks_in(batches, kinds):
        if held and own != block:
            yield block, held
            held = []
        block = own
        held.append(columns)
    if held:
        yield block, held


def at_blocks(rows: DataFrame, run, to: str) -> DataFrame:
    """`run` over the rows, those of a block one after another."""
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, to)


def flushed(kinds, parts, limit: int = COMBINE // 4):
    """Batches of about `limit` entries out of (key, columns) pairs."""
    held, size = [], 0
    for key, columns in parts:
        held.append((key, *(columns[c] for c in kinds)))
        size += len(key)
        if size >= limit:
            key, *values = (np.concatenate(c) for c in zip(*held))
            held, size = [], 0
            yield by_key(kinds, key, dict(zip(kinds, values)))
    if held:
        key, *values = (np.concatenate(c) for c in zip(*held))
        yield by_key(kinds, key, dict(zip(kinds, values)))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs, the end of a text among them."""
    def run(batches):
        def parts():
            for _, texts in pieces(batches):
                yield signed(np.append(Words(texts).hashes, np.full(len(texts), END)))
        for word, n in tallied(parts()):
            yield by_key(COUNTED, block_of(word, COUNT_BLOCKS), {"word": word, "n": n})

    def fold(batches):
        held, size, block = [], 0, None
        for own, c in blocks_in(batches, COUNTED):
            if held and own != block:
                yield whole(held)
                held, size = [], 0
            block = own
            held.append((c["word"], c["n"]))
            size += len(c["n"])
            if size >= COMBINE:
                held, size = [merged(held)], 0
        if held:
            yield whole(held)

    def whole(held):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in merged(held)], ["word", "n"])
    return at_blocks(docs.mapInArrow(run, schema(COUNTED)), fold, "word long, n long")


def word_blocks(docs: DataFrame, get, n_classes: int, blocks: int) -> DataFrame:
    """The words that are not frequent, in blocks by their hash; a word's first class is by its hash
    too."""
    def places(batches):
        units = get()

        def parts():
            for _, texts in pieces(batches):
                line, number, _ = units.sequence(Words(texts))
                at = np.flatnonzero(number < 0)
                word = signed(line[at])
                block = block_of(word, blocks)
                for side, near in enumerate((at + 1, at - 1)):
                    far = number[near] < 0
                    yield block, {"word": word, "beside": np.where(far, signed(line[near]), number[near]),
                                  "kind": (side + 2 * far).astype(np.int8)}
        yield from flushed(PLACES, parts())

    def counted(held):
        word, beside, kind, times = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((beside, kind, word))
        word, beside, kind, times = word[order], beside[order], kind[order], times[order]
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (
            beside[1:] != beside[:-1])))
        return word[first], beside[first], kind[first], np.add.reduceat(times, first)

    def build(batches):
        for block, rows in whole_blocks(batches, PLACES):
            held, size = [], 0
            for c in rows:
                held.append((c["word"], c["beside"], c["kind"], np.ones(len(c["word"]), np.int64)))
                size += len(c["word"])
                if size >= COMBINE:
                    held, size = [counted(held)], 0
            word, beside, kind, times = counted(held)
            words, row = np.unique(word, return_inverse=True)
            side, far = kind & 1, kind >= 2
            # each place of a word has one neighbour after it
            n = np.bincount(row, weights=np.where(side == 0, times, 0), minlength=len(words))
            yield one_block(STATIC, block, {
                "words": words, "classes": (words.view(U) >> U(8)) % U(n_classes - 1), "counts": n,
                "near_at": row[~far], "near": beside[~far] * 2 + side[~far], "near_times": times[~far],
                "far_at": row[far], "far": beside[far], "far_side": side[far], "far_times": times[far]})
    return at_blocks(docs.mapInArrow(places, schema(PLACES)), build, schema(STATIC))


def by_word(rows: DataFrame) -> DataFrame:
    """A block of its own for each word, with its word, class and n as plain columns."""
    def run(batches):
        for block, c in blocks_in(batches, STATIC):
            each = np.ones(len(c["words"]), np.int64)
            columns = {k: (c[k], each) for k in WORDS}
            for k in STATIC:
                if k not in WORDS:
                    at = f"{k.split('_')[0]}_at"
                    columns[k] = (np.zeros(len(c[k])) if k == at else c[k],
                                  np.bincount(c[at], minlength=len(each)))
            packed_ = block_batch(STATIC, np.full(len(each), block), columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[k]) for k in WORDS] + packed_.columns, ["word", "class", "n", *packed_.schema.names])
    return rows.mapInArrow(run, f"word long, class int, n long, {schema(STATIC)}")


def word_rows(docs: DataFrame, get, n_classes: int, blocks: int = 1) -> DataFrame:
    """`word_blocks`, a row for each word."""
    return by_word(word_blocks(docs, get, n_classes, blocks))


def met(rows: DataFrame, n_classes: int, blocks: int = 1) -> DataFrame:
    """The blocks with `SLOTS`: every word tells its class to the words beside it that are not frequent
    either."""
    kinds = STATIC | SENT

    def send(batches):
        told, size = [], 0
        for block, c in blocks_in(batches, STATIC):
            yield one_block(kinds, block, c)
            slot = c["classes"][c["far_at"]] + np.where(c["far_side"] == 0, n_classes, 0)
            told.append((c["far"], slot, c["far_times"]))
            size += len(slot)
            if size >= COMBINE // 4:
                yield letters(told)
                told, size = [], 0
        if size:
            yield letters(told)

    def letters(told):
        to, slot, times = (np.concatenate(c) for c in zip(*told))
        return by_key(kinds, block_of(to, blocks), {"to": to, "to_slot": slot, "to_times": times})

    def receive(batches):
        for block, held in whole_blocks(batches, kinds):
            own = joined([c for c in held if c["words"] is not None])
            order = np.argsort(own["words"])
            keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for c in held:
                if c["to"] is not None:
                    at = order[np.searchsorted(own["words"], c["to"], sorter=order)]
                    keys.append(at * (2 * n_classes) + c["to_slot"])
                    times.append(c["to_times"])
            keys, times = merged([*zip(keys, times)])
            yield one_block(STATIC | SLOTS, block, own | {
                "slot_at": keys // (2 * n_classes), "slot": keys % (2 * n_classes), "slot_times": times})

    def joined(some):
        if len(some) == 1:
            return {k: some[0][k] for k in STATIC}
        begin = np.cumsum([0, *(len(c["words"]) for c in some)])
        return {k: np.concatenate([c[k] + b if k.endswith("_at") else c[k] for c, b in zip(some, begin)])
                for k in STATIC}
    return at_blocks(rows.select("block", *STATIC).mapInArrow(send, schema(kinds)), receive,
                     schema(STATIC | SLOTS))


class Keys:
    """Numbers of what is counted in a round: each frequent word's neighbour classes, the class
    bigrams that begin with no frequent word, and how often each head follows itself."""

    def __init__(self, units: Units, n_classes: int):
        self.wide = 2 * n_classes
        self.table = units.size * self.wide
        self.same = self.table + n_classes * n_classes
        self.size = self.same + units.heads + 1

    def rows(self, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        line = keys // self.wide
        block, cell = line % BLOCKS, line // BLOCKS * self.wide + keys % self.wide
        order = np.argsort(block, kind="stable")
        return packed(block[order], block[order], cell[order], times[order])

    def opened(self, batch) -> tuple[np.ndarray, np.ndarray]:
        cell, row = opened(batch["cells"], np.int32)
        line = cell // self.wide * BLOCKS + batch["block"].to_numpy()[row]
        return line.astype(np.int64) * self.wide + cell % self.wide, opened(
            batch["times"], np.int32)[0].astype(np.int64)


def contexts(beside: DataFrame, rows: DataFrame, units: Units, classes: np.ndarray,
             n_classes: int) -> DataFrame:
    """The sums of `Keys` over all bigrams."""
    get = shared(rows.sparkSession, (units.size, units.heads, Keys(units, n_classes), classes))

    def of_links(batches):
        size, heads, keys, classes = get()

        def parts():
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    yield from of_parts(batch.slice(k, 512))

        def of_parts(batch):
            cell, row = opened(batch["cells"], np.int32)
            times = opened(batch["times"], np.int32)[0]
            side, cell = cell & 1, cell >> 1
            part = batch["part"].to_numpy()
            blocks, of_part = np.unique(part // SIDES, return_inverse=True)
            line = cell // (size // SIDES + 1)
            near = cell % (size // SIDES + 1) * SIDES + (part % SIDES)[row]
            # a block has few words, so its sums fit a dense array
            lines = size // BLOCKS + 1
            found = np.bincount(((of_part[row] * lines + line) * 2 + side) * n_classes + classes[near],
                                weights=times, minlength=len(blocks) * lines * keys.wide)
            at = np.flatnonzero(found)
            word = at // keys.wide % lines * BLOCKS + blocks[at // keys.wide // lines]
            yield word * keys.wide + at % keys.wide, found[at].astype(np.int64)
            word = line * BLOCKS + (part // SIDES)[row]
            own = (word == near) & (side == 0) & ((word < heads) | (word == size - 1))
            if own.any():
                yield keys.same + np.minimum(word[own], heads).astype(np.int64), times[own].astype(np.int64)
        for found in combined(parts()):
            yield keys.rows(*found)

    def of_rows(batches):
        _, _, keys, classes = get()

        def parts():
            for _, c in blocks_in(batches, kinds):
                own, row, times = c["classes"].astype(np.int64), c["near_at"], c["near_times"]
                number, side = c["near"].astype(np.int64) >> 1, c["near"] & 1
                # a word before this one has its class after itself
                yield number * keys.wide + np.where(side == 1, 0, n_classes) + own[row], times
                after = side == 0
                yield (keys.table + own[row[after]] * n_classes + classes[number[after]],
                       times[after])
        for found in combined(parts()):
            yield keys.rows(*found)
    kinds = {c: STATIC[c] for c in ("classes", "near_at", "near", "near_times")}
    return folded(beside.mapInArrow(of_links, PACKED).unionByName(
        rows.select("block", *kinds).mapInArrow(of_rows, PACKED)))


def sums(counted: DataFrame, placed: DataFrame, units: Units, classes: np.ndarray, n_classes: int):
    """(after, before, self, table): how often each head is followed by each class, preceded by
    each class, and followed by itself, and the class bigrams of all words."""
    keys = Keys(units, n_classes)
    get = shared(counted.sparkSession, (units.size, units.heads, keys, classes))
    cells_times = "cells binary, times binary"

    def row(found, times):
        return pa.RecordBatch.from_arrays([blobs(found.astype(np.int64), [len(found)]),
                                           blobs(times.astype(np.int64), [len(found)])],
                                          ["cells", "times"])

    def of_words(batches):
        size, heads, keys, classes = get()
        table, kept = np.zeros(n_classes * n_classes, np.int64), []
        for batch in batches:
            found, times = keys.opened(batch)
            word, slot = found // keys.wide, found % keys.wide
            head = (word < heads) | (word >= size - 1)
            kept.append((found[head], times[head]))
            of = (word < size) & (slot < n_classes)
            np.add.at(table, classes[word[of]] * n_classes + slot[of], times[of])
        kept.append((keys.table + np.arange(len(table)), table))
        yield row(*(np.concatenate(c) for c in zip(*kept)))

    def of_rows(batches):
        table = np.zeros(n_classes * n_classes, np.int64)
        for _, c in blocks_in(batches, kinds):
            of = c["slot"] < n_classes
            np.add.at(table, c["classes"][c["slot_at"][of]] * n_classes + c["slot"][of],
                      c["slot_times"][of])
        yield row(get()[2].table + np.arange(len(table)), table)
    kinds = {"classes": WORDS["classes"]} | SLOTS
    found = counted.mapInArrow(of_words, cells_times).unionByName(
        placed.select("block", *kinds).mapInArrow(of_rows, cells_times)).toArrow()
    heads = np.zeros((units.heads + 1) * keys.wide)
    rest = np.zeros(keys.size - keys.table)
    for cells, times in zip(found["cells"], found["times"]):
        at = np.frombuffer(cells.as_py(), np.int64)
        n = np.frombuffer(times.as_py(), np.int64)
        word = at < keys.table
        head = np.minimum(at[word] // keys.wide, units.heads)
        np.add.at(heads, head * keys.wide + at[word] % keys.wide, n[word])
        np.add.at(rest, at[~word] - keys.table, n[~word])
    heads = heads.reshape(-1, 2, n_classes)
    cells = n_classes * n_classes
    return heads[:, 0], heads[:, 1], rest[cells:], rest[:cells].reshape(n_classes, -1)


def gain(x):
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the bigram log likelihood that the classes decide."""
    return float(gain(table).sum() - gain(table.sum(0)).sum() - gain(table.sum(1)).sum())


def exchange(classes, after, before, same, table) -> tuple[np.ndarray, np.ndarray]:
    """One round: move every head, the frequent first, to its best class; the last stays alone.
    `table` holds the class bigrams of all words and is kept up to date."""
    counted, classes, table, n_classes = classes, classes.copy(), table.copy(), len(table)
    free = n_classes - 1
    for w in np.argsort(-after.sum(1), kind="stable").tolist():
        if w == len(classes) - 1 or not after[w].any():
            continue
        old, both = classes[w], same[w]
        follow, lead = after[w].copy(), before[w].copy()
        # a unit's own bigrams stand with the class that it had when they were counted
        follow[counted[w]] -= both
        lead[counted[w]] -= both
        table[old] -= follow
        table[:, old] -= lead
        table[old, old] -= both
        out_of, into, weight = table.sum(1), table.sum(0), follow.sum() + both
        more = (gain(table + follow) - gain(table)).sum(1) + (
            gain(table + lead[:, None]) - gain(table)).sum(0)
        diagonal = np.diag(table)
        more += gain(diagonal + follow + lead + both) - gain(diagonal + follow) - gain(
            diagonal + lead) + gain(diagonal)
        more -= gain(out_of + weight) - gain(out_of) + gain(into + weight) - gain(into)
        best = int(np.argmax(more[:free]))
        classes[w] = best
        table[best] += follow
        table[:, best] += lead
        table[best, best] += both
    return classes, table


def best_classes(row, slot, m, own, table) -> np.ndarray:
    """The class of each word that raises the likelihood most; (row, slot), sorted and each once,
    stands m times."""
    n_classes, best = len(table), own.copy()
    if not len(row):
        return best
    cells = np.concatenate([table.T, table])
    sides = np.stack([table.sum(1), table.sum(0)])
    kinds, kind = np.unique(m * len(cells) + slot, return_inverse=True)
    there, more = cells[kinds % len(cells)], (kinds // len(cells))[:, None]
    # the own class holds the word already, so there it counts what leaving takes away
    join = gain(there + more) - gain(there)
    leave = gain(there) - gain(np.maximum(there - more, 0))
    value = join[kind]
    value[np.arange(len(kind)), own[row]] = leave[kind, own[row]]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    total = np.add.reduceat(value, first, axis=0)
    some = row[first]
    # each place of a word has one neighbour after it
    weights, weight = np.unique(np.add.reduceat(np.where(slot < n_classes, m, 0), first),
                                return_inverse=True)
    held, at, weights = own[some], np.arange(len(some)), weights.astype(float)[:, None]
    lost = sum(gain(side + weights) - gain(side) for side in sides)[weight]
    lost[at, held] = sum(gain(side) - gain(np.maximum(side - weights, 0)) for side in sides)[
        weight, held]
    best[some] = np.argmax((total - lost)[:, :n_classes - 1], axis=1)
    return best


def moved_units(counted: DataFrame, units: Units, classes: np.ndarray, table: np.ndarray):
    """Classes of the units, those of frequent words that are no heads chosen anew."""
    n_classes = len(table)
    get = shared(counted.sparkSession, (units.size, units.heads, Keys(units, n_classes), classes, table))

    def run(batches):
        size, heads, keys, classes, table = get()
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                found, times = merged([keys.opened(batch.slice(k, 16))])
                of = (found >= heads * keys.wide) & (found < (size - 1) * keys.wide)
                words, row = np.unique(found[of] // keys.wide, return_inverse=True)
                best = best_classes(row, found[of] % keys.wide, times[of], classes[words], table)
                yield pa.RecordBatch.from_arrays([
                    pa.array(words, pa.int64()), pa.array(best, pa.int32())], ["number", "class"])
    found = counted.mapInArrow(run, "number long, class int").toArrow()
    classes = classes.copy()
    classes[found["number"].to_numpy()] = found["class"].to_numpy()
    return classes


def moved_blocks(placed: DataFrame, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """The blocks, each word with the class that raises the likelihood most."""
    wide = 2 * len(table)
    get = shared(placed.sparkSession, (classes, table))

    def run(batches):
        classes, table = get()
        for block, c in blocks_in(batches, STATIC | SLOTS):
            code = c["near"].astype(np.int64)
            keys, m = merged([
                (c["near_at"] * wide + (code & 1) * len(table) + classes[code >> 1], c["near_times"]),
                (c["slot_at"].astype(np.int64) * wide + c["slot"], c["slot_times"])])
            row, slot, own = keys // wide, keys % wide, c["classes"]
            best = own.copy()
            for k in range(0, len(own), SLICE):
                of = slice(*np.searchsorted(row, [k, k + SLICE]))
                best[k:k + SLICE] = best_classes(row[of] - k, slot[of], m[of], own[k:k + SLICE], table)
            yield one_block(STATIC, block, {k: best if k == "classes" else c[k] for k in STATIC})
    return placed.mapInArrow(run, schema(STATIC))


def moved_rows(rows: DataFrame, placed: DataFrame, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """`moved_blocks`, a row for each word of the rows that were placed."""
    return by_word(moved_blocks(placed, classes, table))


class Model:
    """Classes of units, and the logarithms that the classes give."""

    def __init__(self, units: Units, classes, table, class_tokens, class_words, class_once=None):
        self.units, self.classes = units, classes
        n = len(table)
        self.transition = np.log10((table + ADD) / (table.sum(1, keepdims=True) + ADD * n))
        self.mass = np.log10(class_tokens + 0.1 * (class_words + 1))
        # the last row and column are those of an unknown word, which may be of any class
        once = (class_tokens if class_once is None else class_once) + ADD
        to_next = once / once.sum() @ 10 ** self.transition
        from_last = np.vstack([10 ** self.transition, to_next])
        self.steps = np.log10(np.column_stack([from_last, from_last @ 10 ** -self.mass]))


def cluster(docs: DataFrame, units: Units, n_classes: int = CLASSES, rounds: int = ROUNDS):
    """(classes of units, class bigram counts, classes of all other words) of the best turn."""
    classes, table, rows = clustered(docs, units, n_classes, rounds)
    return classes, table, by_word(rows).select("word", "class", "n")


def clustered(docs: DataFrame, units: Units, n_classes: int, rounds: int, blocks: int = 1):
    """Like `cluster`, with the other words in so many blocks."""
    spark, free = docs.sparkSession, n_classes - 1
    get = shared(spark, units)
    beside = written(links(docs, get))
    with scratch() as held:
        rows = written(met(word_blocks(docs, get, n_classes, blocks), n_classes, blocks))
    classes = np.append(np.arange(units.size - 1) % free, free)
    head = np.append(np.arange(units.heads), units.size - 1)
    best, kept, last = None, [], None
    for turn in range(2 * rounds + 1):
        with scratch() as passing:
            counted = written(contexts(beside, rows, units, classes, n_classes))
        after, before, same, table = sums(counted, rows, units, classes, n_classes)
        value = likelihood(table)
        if best is None or value > best[0]:
            if kept != held:
                delete(spark, kept)
            best, kept = (value, classes, table, rows), list(held)
        if turn % 2 == 0:
            # a round is over: both kinds of words have had their turn
            if turn == 2 * rounds or (last is not None and value - last < STOP * abs(value)):
                delete(spark, passing)
                break
            last = value
            classes = classes.copy()
            classes[head] = exchange(classes[head], after, before, same, table)[0]
        else:
            moved = moved_units(counted, units, classes, table)
            with scratch() as new:
                rows = written(met(moved_blocks(rows, classes, table), n_classes, blocks))
            if held != kept:
                delete(spark, held)
            classes, held = moved, new
        delete(spark, passing)
    return best[1:]


def scores(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    marked = id_and_text(docs).withColumn("held_out", remainder(FOLDS) == 0)
    train = marked.where("not held_out").select("doc_id", "text")
    counts = written(count_words(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    # the words above a count that at most LOOKUP words reach, by a histogram of fixed size
    level = F.floor(F.log2("n") * 16)
    reached, least = 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).agg(
            F.count("*").alias("words")).collect(), reverse=True):
        reached += row["words"]
        least = row["level"] + 1 if reached > LOOKUP else least
        if reached > LOOKUP:
            break
    end = int(END.astype(np.int64))
    top = counts.where((level >= least) & (F.col("word") != end)).toArrow()
    words, n = top["word"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    ends = counts.where(F.col("word") == end).first()
    n = np.append(n, ends["n"] if ends else 0)
    units = Units(words.view(U), HEADS)
    blocks = int(total - n.sum()) // BLOCK_TOKENS + 1
    classes, table, others = clustered(train, units, n_classes, rounds, blocks)

    # tokens, words and words seen once of each class: those of the units, then all others'
    held = np.stack([np.bincount(classes, weights=w, minlength=n_classes)
                     for w in (n, n > 0, n == 1)])
    for r in class_counts(others, n_classes).groupBy("class").agg(
            *(F.sum(c).alias(c) for c in ("n", "words", "once"))).collect():
        held[:, r["class"]] += r["n"], r["words"], r["once"]
    model = Model(units, classes, table, *held)
    get = shared(spark, (model, n))
    asked = written(marked.withColumn("place", F.spark_partition_id()).select(
        "doc_id", "text", "place", "held_out").mapInArrow(
        score_rows(get, blocks), f"{', '.join(f'{c} {k}' for c, k in LINE.items())}, {schema(ASKED)}"))
    found = rest_of_scores(asked.where("block is not null").select("block", *ASKED), others, model)
    whole = asked.where("block is null").select(*LINE).join(found, F.col("row") == F.col("of"), "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = float(np.log10(total + 0.1 * (distinct + 1)))
    return whole.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (logs + F.col("classes") + F.coalesce("more_classes", F.lit(0.0))).alias("score"))


def class_counts(others: DataFrame, n_classes: int) -> DataFrame:
    """How many tokens, words and words seen once of each block a class holds."""
    def run(batches):
        for _, c in blocks_in(batches, WORDS):
            sums_ = [np.bincount(c["classes"], weights=w, minlength=n_classes).astype(np.int64)
                     for w in (c["counts"], np.ones(len(c["counts"])), c["counts"] == 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_classes, dtype=np.int32)), *map(pa.array, sums_)],
                ["class", "n", "words", "once"])
    return others.select("block", *WORDS).mapInArrow(run, "class int, n long, words long, once long")


LINE = {"row": "long", "doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long",
        "logs": "double", "classes": "double"}
# places of words that are not frequent, with the classes of the words around them, -1 if not frequent
AROUND = {"of": np.int64, "at": np.int64, "lead": np.int32, "follow": np.int32}
ASKED = {"word": np.int64} | AROUND
TOLD = AROUND | {"own": np.int32, "n": np.int64}
# Documents whose rare words are put together at once.
TOGETHER = 1024


def score_rows(get, blocks: int):
    """For each document a row with what its frequent words give, and the places of its other words
    by the block of the word."""
    def run(batches):
        model, counts = get()
        units, place, row = model.units, 0, 0
        # by number, the last for words without one (-1)
        log, seen = np.append(np.log10(counts + 0.1), 0.0), np.append(counts > 0, False)
        kind_of = np.append(model.classes, -1).astype(np.int32)
        mass = np.append(model.mass, 0.0)
        # by class before and class; nothing where either is not known
        steps = np.zeros((len(mass), len(mass)))
        steps[:-1, :-1] = model.transition
        names_of = [*LINE, "block", *ASKED]

        def keyed():
            nonlocal place
            for batch in batches:
                if batch.num_rows:
                    place = batch["place"][0].as_py() << 40
                ids = pa.StructArray.from_arrays([batch["doc_id"], batch["held_out"]],
                                                 ["doc_id", "held_out"])
                yield pa.RecordBatch.from_arrays([ids, batch["text"]], ["key", "text"])

        def asked(held):
            key, *values = (np.concatenate(c) for c in zip(*held))
            found = by_key(ASKED, key, dict(zip(ASKED, values)))
            return pa.RecordBatch.from_arrays(
                [pa.nulls(found.num_rows, k) for k in kinds] + found.columns, names_of)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        rare, size = [], 0
        for keys, texts in pieces(keyed()):
            words = Words(texts)
            n_docs, lengths = len(texts), words.counts + 1
            line, number, begins = units.sequence(words)
            # a document's tokens are its words and its end; the end before it is a neighbour
            doc, token = np.repeat(np.arange(n_docs), lengths), np.arange(1, len(line))
            own = number[1:]
            logs = np.bincount(doc, weights=log[own], minlength=n_docs)
            known = np.bincount(doc, weights=seen[own], minlength=n_docs).astype(np.int64)
            classes = kind_of[number]
            step = steps[classes[:-1], classes[1:]] - mass[classes[1:]]
            of_classes = np.bincount(doc, weights=step, minlength=n_docs)
            names = place + row + np.arange(n_docs)
            row += n_docs
            columns = (names, [k["doc_id"] for k in keys], [k["held_out"] for k in keys], lengths, known,
                       logs, of_classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.nulls(n_docs, pa.int64())] + [
                    pa.nulls(n_docs, pa.binary())] * len(ASKED), names_of)
            other = own < 0
            at = token[other]
            word = signed(line[at])
            rare.append((block_of(word, blocks), word, names[doc[other]], at, classes[at - 1],
                         classes[at + 1]))
            size += len(at)
            if size >= COMBINE // 4:
                yield asked(rare)
                rare, size = [], 0
        if size:
            yield asked(rare)
    return run


def rest_of_scores(asked: DataFrame, others: DataFrame, model: Model) -> DataFrame:
    """of, more_logs, more_classes, more_known: what the words that are not frequent add to the rows.
    The places of a word meet its count and class in its block, then those of a document each other."""
    unknown = len(model.transition)
    get = shared(asked.sparkSession, (model.steps, np.append(model.mass, 0.0)))
    kinds = WORDS | ASKED

    def answer(batches):
        def parts():
            for _, held in whole_blocks(batches, kinds):
                own = [c for c in held if c["words"] is not None]
                words, classes, counts = (
                    np.concatenate([c[k] for c in own]) if own else np.empty(0, kind)
                    for k, kind in WORDS.items())
                for c in held:
                    if c["word"] is None:
                        continue
                    at = np.searchsorted(words, c["word"])
                    known = np.zeros(len(at), bool)
                    if len(words):
                        at = np.minimum(at, len(words) - 1)
                        known = words[at] == c["word"]
                    of_class, n = np.full(len(at), unknown, np.int32), np.zeros(len(at), np.int64)
                    of_class[known], n[known] = classes[at[known]], counts[at[known]]
                    yield c["of"] // TOGETHER, {k: c[k] for k in AROUND} | {"own": of_class, "n": n}
        yield from flushed(TOLD, parts())

    def add(batches):
        steps, mass = get()
        for _, held in whole_blocks(batches, TOLD):
            of, at, lead, follow, own, n = (np.concatenate([c[k] for c in held]) for k in TOLD)
            order = np.lexsort((at, of))
            of, lead, follow, own, n = of[order], lead[order], follow[order], own[order], n[order]
            # the word before may be one that only its block told; it is the place before, then
            lead = np.where(lead >= 0, lead, np.append(0, own[:-1]))
            step = steps[lead, own] + np.where(follow >= 0, steps[own, follow], 0.0) - mass[own]
            rows, row = np.unique(of, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), pa.array(np.bincount(row, weights=np.log10(n + 0.1))),
                pa.array(np.bincount(row, weights=step)),
                pa.array(np.bincount(row, weights=n > 0).astype(np.int64))],
                ["of", "more_logs", "more_classes", "more_known"])
    met_ = others.select("block", *WORDS).selectExpr(
        "*", *(f"cast(null as binary) {c}" for c in ASKED)).unionByName(asked.selectExpr(
            "*", *(f"cast(null as binary) {c}" for c in WORDS)))
    told = at_blocks(met_, answer, schema(TOLD))
    return at_blocks(told, add, "of long, more_logs double, more_classes double, more_known long")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
