"""Spelling variants: frequent words, how many words are one edit away, and the form each stands for.

Words: runs of letters are counted over all documents. Every letter belongs to one of `GROUPS` groups,
dealt so that each has about the same share of all letters; a word's vector says how many of its
letters lie in each group. One replaced letter takes one from a group and adds one to another, one
inserted letter adds one, so near words have vectors that differ by a surplus and a deficit of one
each at most.

Search: the vectors form a trie, a level for each group. Its first levels, as many as leave `SHARD`
words below an average node, are the key of a shuffle: a word is stored below its own prefix and asks
at each prefix that the budget reaches. A prefix with many words is cut into slices, which all its
askers visit. Inside a slice the rest of the trie is searched depth first, blocks of askers at a time, and
the words of the leaves are verified letter by letter. The deficit may only be spent after the surplus, a
longer word is never the asker, and of two words with equal vectors the smaller one asks, so a pair is
found once and no pair is lost.

Forms: a word's form is its near word with the largest count, if that is `RATIO` times its own at
least. Counts grow along forms, so they end; roots are found by doubling steps in joins.

Cases: null texts and null ids count as empty (a null id is the empty string in front of the colon);
empty documents or tables give no words; texts and words of any length are read whole; copies and
repeated rows count as often as they come; of several largest near words the first in code-point order
is the form; other columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import documents, give_back, id_and_text, shared, written
from capture_analytics.llm.tokens import BASE, U, expand, mix, signed

# Fixed values of the operator's contract.
LETTERS = r"A-Za-zÀ-ÿ"
DELETE = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2

GROUPS = 12
KNOWN_LETTERS = 256  # dealt by their share; any rarer letter goes by its code point
SHARD = 4_096        # words below an average prefix
SLICE = 4_096        # stored words that one task holds
ASKERS = 1 << 15     # askers that are searched together
BLOCK = 1 << 16      # entries of one block of the depth-first search
PAIRS = 1 << 17      # leaf pairs that are verified together
WIDTH = 48           # longer words are verified one by one
WIDE = 1 << 31       # above any count of letters


# ---- words --------------------------------------------------------------------------

def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                  delete: int | None = DELETE) -> DataFrame:
    """word, n: runs of letters in lower case (only A-Z change), with their counts over all texts.

    Where `delete` divides the crc32 of `<doc_id>:<run>`, the run lacks one letter.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    runs = id_and_text(docs).select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("owner"),
        run.alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.select("owner", F.when(ascii_only, F.lower("run")).otherwise(F.translate(
        "run", string.ascii_uppercase, string.ascii_lowercase)).alias("run"))
    if delete:
        runs = runs.withColumn("h", F.crc32(F.concat("owner", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        runs = runs.withColumn("run", F.when(F.col("h") % delete == 0, F.concat(
            F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run")))
    return runs.where(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---- vectors ------------------------------------------------------------------------

def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, one word after another, and the words' lengths."""
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4"), np.fromiter(map(len, words), np.int64, len(words))


class Grouping:
    """Which group every letter belongs to."""

    def __init__(self, shares: list[tuple[str, int]]):
        load, group = [0] * GROUPS, {}
        for letter, n in sorted(shares, key=lambda s: (-s[1], s[0])):
            least = load.index(min(load))
            load[least] += n
            group[ord(letter)] = least
        self.codes = np.array(sorted(group), np.uint32)
        self.groups = np.array([group[int(c)] for c in self.codes], np.int64)

    def vectors(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words x groups: how many letters of the word lie in the group."""
        group = (flat % GROUPS).astype(np.int64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
            group = np.where(self.codes[at] == flat, self.groups[at], group)
        cell = np.repeat(np.arange(len(lengths)), lengths) * GROUPS + group
        return np.bincount(cell, minlength=len(lengths) * GROUPS).reshape(-1, GROUPS)


def grouping(words: DataFrame) -> Grouping:
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    return Grouping([(r[0], r[1]) for r in letters.groupBy("letter").count().orderBy(
        F.desc("count"), "letter").limit(KNOWN_LETTERS).collect() if len(r[0]) == 1])


def prefix_keys(vectors: np.ndarray) -> np.ndarray:
    """One number for each row of counts."""
    key = np.zeros(len(vectors), U)
    for column in vectors.T:
        key = mix(key * U(BASE) + column.astype(U) + U(1))
    return signed(key)


def prefix_depth(words: DataFrame, groups: Grouping, n: int, shard: int) -> int:
    """The fewest levels that leave about `shard` words below an average prefix."""
    get = shared(words.sparkSession, groups)

    def prefixes(batches):
        for batch in batches:
            vectors = get().vectors(*spelled(batch["word"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix_keys(vectors[:, :d])) for d in range(GROUPS + 1)],
                [f"k{d}" for d in range(GROUPS + 1)])
    keys = words.select("word").mapInArrow(
        prefixes, ", ".join(f"k{d} long" for d in range(GROUPS + 1)))
    found = keys.agg(*[F.approx_count_distinct(f"k{d}") for d in range(GROUPS + 1)]).first()
    return next((d for d, x in enumerate(found) if n <= shard * x), GROUPS)


PLACED = "key long, asks int, state int, word string, n long"


def placed(words: DataFrame, groups: Grouping, depth: int) -> DataFrame:
    """Each word below its own prefix (asks 0), and as an asker (asks 1) at its own prefix and at each
    other one with one letter more, or one more and then one less, in the first `depth` groups.
    `state`: 0 nothing of the budget is spent, 1 the surplus, 2 surplus and deficit."""
    get = shared(words.sparkSession, groups)
    names = [c.split()[0] for c in PLACED.split(", ")]

    def place(batches):
        for batch in batches:
            prefix = get().vectors(*spelled(batch["word"].to_pylist()))[:, :depth]

            def rows(key, asks, state, which=None):
                columns = [batch["word"], batch["n"]]
                if which is not None:
                    columns = [c.filter(pa.array(which)) for c in columns]
                small = [pa.array(np.full(len(key), x, np.int32)) for x in (asks, state)]
                return pa.RecordBatch.from_arrays([pa.array(key), *small, *columns], names)
            own = prefix_keys(prefix)
            yield rows(own, 0, 0)
            yield rows(own, 1, 0)
            for more in range(depth):
                prefix[:, more] += 1
                yield rows(prefix_keys(prefix), 1, 1)
                for less in range(more + 1, depth):
                    which = prefix[:, less] > 0
                    prefix[:, less] -= 1
                    yield rows(prefix_keys(prefix[which]), 1, 2, which)
                    prefix[:, less] += 1
                prefix[:, more] -= 1
    return words.select("word", "n").mapInArrow(place, PLACED)


# ---- the trie of one slice ------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter inserted, deleted or replaced turns `a` into `b`."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    if len(a) == len(b):
        return a != b and a[at + 1:] == b[at + 1:]
    return len(b) == len(a) + 1 and a[at:] == b[at + 1:]


class Spelled:
    """Words with their lengths, vectors below the prefix, first letters and end letters."""

    def __init__(self, words: list[str], counts: np.ndarray, groups: Grouping, depth: int,
                 in_order: bool = False):
        flat, lengths = spelled(words)
        vectors = groups.vectors(flat, lengths)[:, depth:]
        first = np.cumsum(lengths) - lengths
        if in_order and vectors.shape[1]:
            order = np.lexsort(vectors.T[::-1])
            words, counts = [words[i] for i in order], counts[order]
            lengths, vectors, first = lengths[order], vectors[order], first[order]
        self.words, self.counts, self.lengths, self.vectors = words, counts, lengths, vectors
        shown = np.minimum(lengths, WIDTH)
        self.matrix = np.zeros((len(words), min(WIDTH, lengths.max(initial=0)) + 1), np.uint32)
        row = np.repeat(np.arange(len(words)), shown)
        column = expand(np.zeros(len(words), np.int64), shown)
        self.matrix[row, column] = flat[first[row] + column]
        # the first two letters and the last two, as one number each
        padded = np.concatenate([flat, np.zeros(2, np.uint32)]).astype(np.int64)
        last = np.maximum(first + lengths - 2, 0)
        self.head = padded[first] * (1 << 21) + padded[first + 1]
        self.tail = padded[last] * (1 << 21) + padded[last + 1]


class Trie:
    """The words of one slice by their letter-group counts behind the prefix."""

    def __init__(self, words: list[str], counts: np.ndarray, groups: Grouping, depth: int):
        self.groups, self.depth = groups, depth
        self.rows = Spelled(words, counts, groups, depth, in_order=True)
        node, self.levels = np.zeros(len(words), np.int64), []
        for column in self.rows.vectors.T:
            branch = node * WIDE + column
            new = np.concatenate([[True], branch[1:] != branch[:-1]])
            self.levels.append(branch[new])
            node = np.cumsum(new) - 1
        self.leaf = np.searchsorted(node, np.arange(node[-1] + 2))

    def leaves(self, askers: Spelled, state: np.ndarray):
        """Blocks of (asker, leaf, state) that the budget reaches, depth first."""
        n = len(state)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), state)]
        while stack:
            level, asker, node, spent = stack.pop()
            if len(asker) > BLOCK:
                half = len(asker) // 2
                stack += [(level, asker[half:], node[half:], spent[half:]),
                          (level, asker[:half], node[:half], spent[:half])]
                continue
            if level == len(self.levels):
                yield asker, node, spent
                continue
            wanted, keys = node * WIDE + askers.vectors[asker, level], self.levels[level]
            found = []
            for change, before, after in ((0, None, None), (1, 0, 1), (-1, 1, 2)):
                who = np.arange(len(asker)) if before is None else np.flatnonzero(spent == before)
                at = np.searchsorted(keys, wanted[who] + change)
                hit = keys[np.minimum(at, len(keys) - 1)] == wanted[who] + change
                who, at = who[hit], at[hit]
                found.append((asker[who], at, spent[who] if after is None
                              else np.full(len(who), after, spent.dtype)))
            asker, node, spent = (np.concatenate(x) for x in zip(*found))
            if len(asker):
                stack.append((level + 1, asker, node, spent))

    def near(self, askers: Spelled, state: np.ndarray):
        """(asker, row) arrays of words that differ by one edit."""
        for asker, node, spent in self.leaves(askers, state):
            sizes = self.leaf[node + 1] - self.leaf[node]
            block = np.cumsum(sizes) // PAIRS
            for part in np.split(np.arange(len(asker)), np.flatnonzero(np.diff(block)) + 1):
                row = expand(self.leaf[node[part]], sizes[part])
                yield self.verified(askers, np.repeat(asker[part], sizes[part]), row,
                                    np.repeat(spent[part], sizes[part]))

    def verified(self, askers: Spelled, asker: np.ndarray, row: np.ndarray, spent: np.ndarray):
        rows = self.rows
        short = askers.lengths[asker]
        # an edit leaves the first half or the last half of the letters as they are
        fits = (rows.lengths[row] - short == (spent == 1)) & (
            (short < 4) | (askers.head[asker] == rows.head[row])
            | (askers.tail[asker] == rows.tail[row]))
        asker, row, spent = asker[fits], row[fits], spent[fits]
        short, grows = askers.lengths[asker], rows.lengths[row] > askers.lengths[asker]
        width = max(askers.matrix.shape[1], rows.matrix.shape[1])
        a, b = (np.pad(m[i], ((0, 0), (0, width - m.shape[1])))
                for m, i in ((askers.matrix, asker), (rows.matrix, row)))
        differ = a != b
        begin = np.where(differ.any(1), differ.argmax(1), width)
        shifted = a[:, :-1] != b[:, 1:]
        end = np.where(shifted.any(1), width - 2 - shifted[:, ::-1].argmax(1), -1)
        good = np.where(grows, end < begin, differ.sum(1) == 1)
        for i in np.flatnonzero(short + grows > WIDTH):
            good[i] = one_edit(askers.words[asker[i]], rows.words[row[i]])
        asker, row, spent = asker[good], row[good], spent[good]
        # equal vectors: both words ask, one is heard
        once = np.array([s > 0 or askers.words[x] < rows.words[y]
                         for s, x, y in zip(spent, asker, row)], bool)
        return asker[once], row[once]


NEAR = "word string, near string, near_n long"


def search(batches, groups: Grouping, depth: int):
    """Rows of slices, stored words before askers, as both directions of every near pair."""
    current, stored, trie = None, ([], []), None
    words, counts, states = [], [], []

    def found():
        if trie is None or not words:
            return
        askers = Spelled(words, np.array(counts, np.int64), groups, depth)
        rows = trie.rows
        for asker, row in trie.near(askers, np.array(states, np.int8)):
            if len(asker):
                a, b = [words[i] for i in asker], [rows.words[i] for i in row]
                n, m = askers.counts[asker], rows.counts[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a + b), pa.array(b + a), pa.array(np.concatenate([m, n]))],
                    ["word", "near", "near_n"])

    for batch in batches:
        key, part = batch["key"].to_numpy(), batch["slice"].to_numpy()
        asks, state = batch["asks"].to_numpy(), batch["state"].to_numpy()
        names, n = batch["word"].to_pylist(), batch["n"].to_pylist()
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(key)]):
            if begin == end:
                continue
            if (key[begin], part[begin]) != current:
                yield from found()
                current, stored, trie = (key[begin], part[begin]), ([], []), None
                words, counts, states = [], [], []
            if not asks[begin]:
                stored[0].extend(names[begin:end])
                stored[1].extend(n[begin:end])
                continue
            if trie is None and stored[0]:
                trie = Trie(stored[0], np.array(stored[1], np.int64), groups, depth)
            words += names[begin:end]
            counts += n[begin:end]
            states += state[begin:end].tolist()
            if len(words) >= ASKERS:
                yield from found()
                words, counts, states = [], [], []
    yield from found()
    give_back()


def near_pairs(words: DataFrame, shard: int = SHARD, piece: int = SLICE) -> DataFrame:
    """word, near, near_n: all ordered pairs of the distinct words (word, n) that differ by exactly one
    inserted, deleted or replaced letter."""
    total = words.count()
    groups = grouping(words)
    depth = prefix_depth(words, groups, total, shard)
    rows = placed(words, groups, depth)
    sizes = rows.where("asks = 0").groupBy(F.col("key").alias("at")).agg(
        F.ceil(F.count("*") / piece).cast("int").alias("slices"))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    # askers of a prefix that no word has end here
    dealt = rows.join(sizes, F.col("key") == F.col("at")).select(
        "key", "asks", "state", "word", "n", F.explode(F.when(F.col("asks") == 0, own).otherwise(
            F.sequence(F.lit(0), F.col("slices") - 1))).alias("slice"))
    get = shared(words.sparkSession, groups)
    return dealt.repartition("key", "slice").sortWithinPartitions("key", "slice", "asks").mapInArrow(
        lambda batches: search(batches, get(), depth), NEAR)


# ---- forms and roots ------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of (word, form): the last word that following forms reaches. Each
    round doubles the steps, so their number grows with the logarithm of the longest way."""
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        joined = written(links.join(onward, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"),
            F.col("beyond").isNotNull().alias("moved")))
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the distinct (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy(F.col("word").alias("of")).agg(
        F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.minus") >= ratio * F.col("n")
    known = written(words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.form")).alias("form"),
        F.when(large, -F.col("best.minus")).alias("form_n")))
    ends = roots(known.where("form is not null")).select(F.col("word").alias("of"), "root")
    return known.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(counted_words(documents(spark, sf_dir))))


VARIANTS_SQL = r"""
with recursive bits as (
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (
    select coalesce(doc_id::varchar, '') as owner, translate(unnest(regexp_extract_all(
        text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        as run
    from documents),
counted as (select owner, run, count(*) as n from runs where length(run) >= 5 group by all),
crcs as (
    select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(
        range(octet_length(encode(owner || ':' || run))),
        lambda i: ('0x' || substr(hex(encode(owner || ':' || run)), (2 * i + 1)::integer, 2))::bigint)),
        lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295) as h
    from counted, bits),
cut as (
    select case when h % 97 = 0 then substr(run, 1, (h % length(run))::integer)
        || substr(run, (h % length(run) + 2)::integer) else run end as word, n from crcs),
words as (
    select word, sum(n)::bigint as n from cut where length(word) >= 5 group by word having sum(n) >= 3),
less as (
    select word, n, i, substr(word, 1, i::integer - 1) || substr(word, i::integer + 1) as rest
    from (select word, n, unnest(generate_series(1, length(word))) as i from words)),
pairs as (
    select a.word, b.word as near, b.n as near_n from less a join less b
        on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select l.word, w.word, w.n from less l join words w on l.rest = w.word
    union select w.word, l.word, l.n from less l join words w on l.rest = w.word),
best as (
    select word, near, near_n, count(*) over (partition by word) as n_near,
        row_number() over (partition by word order by near_n desc, near) as k from pairs),
known as (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near,
        case when b.near_n >= 2 * w.n then b.near end as form,
        case when b.near_n >= 2 * w.n then b.near_n end as form_n
    from words w left join best b on b.word = w.word and b.k = 1),
ways as (
    select word, word as at from known
    union all select y.word, k.form from ways y join known k on k.word = y.at where k.form is not null)
select k.word, k.form, y.at as root, k.n, k.n_near, k.form_n
from known k join ways y on y.word = k.word join known e on e.word = y.at where e.form is null"""
