"""Collocations: phrases of two and more words that occur together more often than their parts suggest.

Texts are split into pieces at punctuation and line ends, pieces into words; everything is counted per
language. Words and phrases are told apart by 64-bit hashes until the result is put together.

Vertical partitioning: a suffix is what follows a word in its piece, cut to `LONGEST` words and in front
of the first word that is rarer than a candidate may be. Prefixes of one word are counted first. A
prefix with more occurrences than the memory budget of a group is made longer by a word, in a scan of its
own, until it is within the budget or as long as a suffix. All prefixes are then dealt into groups of
about one budget, the suffixes are sent to their prefix's group, and each group builds its subtrees of
sorted suffixes by itself: equal suffixes are one leaf with a total, and the count of a phrase is the sum
of the leaves below it. A group that holds more rows than the budget merges equal leaves as it goes, so
a phrase that fills a third of the corpus is one leaf there.

Scores: a candidate is cut after each of its words; both parts are counted phrases, so their counts come
by joins on phrase hashes, and the arithmetic is decimal. Candidates inside a longer one with nearly
its count are dropped.

Cases: null texts are empty, a null language is `und`; empty texts and tables give no rows; texts
are read whole, whatever their length; copies and repeated rows count as often as they come; null ids
do not matter, ids are not read; equal scores go by count and then by the phrase's bytes; other columns
of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_analytics.llm.tables import bit_set, documents, give_back, pieces, shared, written
from capture_analytics.llm.tokens import BASE, LOWER, U, Words, mix, signed

# Fixed values of the operator's contract.
SEPARATORS = (*b".,;:!?", *range(0x0A, 0x0E))
UNKNOWN = "und"
LONGEST = 3
MIN_COUNT = 10
WITHIN = (100, 50)  # a candidate goes if 100 f(longer) >= 50 f(candidate)
SCALE = 1_000_000
TOP = 2_000

CHUNK_CHARS = 1 << 21
CHUNK_ROWS = 4_096
BUDGET = 1 << 20    # suffixes of one group
EXTENDED = 1 << 16  # at most so many prefixes of one length are made longer
FREQUENT_BITS = (1 << 20, 1 << 27)

INSIDE = np.ones(256, bool)
INSIDE[[0x20, 0x09, *SEPARATORS]] = False
BREAK = np.zeros(256, bool)
BREAK[list(SEPARATORS)] = True


# ---- words of chunks --------------------------------------------------------------------

class Chunk:
    """The words of some texts, in order: `hashes` that tell language and word, `follows`: whether the
    word after is in the same piece."""

    def __init__(self, langs: list[str], texts: list[str | None]):
        self.words = words = Words(texts, INSIDE)
        names = list(dict.fromkeys(langs))
        place = {name: i for i, name in enumerate(names)}
        self.langs = names
        self.lang = np.repeat(np.array([place[x] for x in langs], np.int64), words.counts)
        salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], U)
        self.hashes = mix(words.hashes ^ salt[self.lang]) if len(self.lang) else words.hashes
        breaks = np.concatenate([[0], np.cumsum(BREAK[np.frombuffer(words.buffer, np.uint8)])])
        follows = np.zeros(len(self.hashes), bool)
        follows[:-1] = breaks[words.starts[1:]] == breaks[words.ends[:-1]]
        last = words.first[1:] - 1
        follows[last[last >= 0]] = False
        self.follows = follows

    def suffixes(self, frequent: np.ndarray, longest: int) -> np.ndarray:
        """Words x longest: the hashes of each suffix of two words and more, zeros behind its end."""
        n = len(self.hashes)
        rows = np.zeros((n, longest), U)
        rows[:, 0], goes_on = self.hashes, frequent
        for k in range(1, longest):
            ahead = np.zeros(n, bool)
            if n > k:
                ahead[:n - k] = goes_on[:n - k] & self.follows[k - 1:n - 1] & frequent[k:]
                rows[:n - k, k] = np.where(ahead[:n - k], self.hashes[k:], U(0))
            goes_on = ahead
        return rows[rows[:, 1] != 0]


def phrase_keys(rows: np.ndarray, length: int, start: int = 0) -> np.ndarray:
    """One hash for `length` words of each row from word `start` on; a single word's is its own."""
    if length == 1:
        return rows[:, start]
    total, factor = np.full(len(rows), length, U), 1
    for k in range(length):
        factor = factor * BASE % (1 << 64)
        total = total + rows[:, start + k] * U(factor)
    return mix(total)


def columns(rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(signed(np.ascontiguousarray(c))) for c in rows.T]


def merged(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts, or how often each is there."""
    counts = np.ones(len(rows), np.int64) if counts is None else counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.empty(0, bool)
    begins = np.flatnonzero(new)
    return rows[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def lang_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def chunks(batches):
    for langs, texts in pieces(batches, CHUNK_CHARS, CHUNK_ROWS):
        if langs:
            yield Chunk(langs, texts)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, h, word, n of every word with `least` occurrences in its language; the rows without
    a word hold a language's total."""
    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("word", pa.string()),
                            ("n", pa.int64())])
        for chunk in chunks(batches):
            words = chunk.words
            found, first, n = np.unique(chunk.hashes, return_index=True, return_counts=True)
            lower = words.buffer.translate(LOWER.tobytes())
            texts = [lower[a:b].decode() for a, b in zip(words.starts[first].tolist(),
                                                         words.ends[first].tolist())]
            names = np.array(chunk.langs, object)
            totals = np.bincount(chunk.lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([
                pa.array([*names[chunk.lang[first]], *names], pa.string()),
                pa.array(np.concatenate([signed(found), np.zeros(len(names), np.int64)])),
                pa.array(texts + [None] * len(names), pa.string()),
                pa.array(np.concatenate([n, totals]).astype(np.int64))], schema=schema)
    counted = docs.mapInArrow(count, "lang string, h long, word string, n long")
    return counted.groupBy("lang", "h", "word").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= least) | F.col("word").isNull())


# ---- prefixes and their groups ------------------------------------------------------------

class Prefixes:
    """The partitioning: `long[k]` holds the sorted keys of prefixes of k + 1 words that are made longer."""

    def __init__(self, frequent, longest: int):
        self.frequent, self.longest, self.long, self.groups = frequent, longest, [], 1

    def suffixes(self, chunk: Chunk) -> np.ndarray:
        return chunk.suffixes(self.frequent.has(chunk.hashes), self.longest)

    def extended(self, rows: np.ndarray, level: int) -> np.ndarray:
        """Which rows have a prefix of so many words that is made longer."""
        if level > len(self.long) or not len(self.long[level - 1]):
            return np.zeros(len(rows), bool)
        keys, known = phrase_keys(rows, level), self.long[level - 1]
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def group(self, rows: np.ndarray) -> np.ndarray:
        key, longer = phrase_keys(rows, 1), np.ones(len(rows), bool)
        for level in range(1, self.longest):
            longer &= self.extended(rows, level)
            key = np.where(longer, phrase_keys(rows, level + 1), key)
        return (mix(key) % U(self.groups)).astype(np.int64)


def prefix_counts(docs: DataFrame, prefixes: Prefixes, level: int) -> DataFrame:
    """h1, h2, ... and n of the prefixes of `level` words that make those of one word less longer."""
    get = shared(docs.sparkSession, prefixes)
    names = [f"h{k + 1}" for k in range(level)]

    def count(batches):
        own = get()
        for chunk in chunks(batches):
            rows = own.suffixes(chunk)
            rows, n = merged(rows[own.extended(rows, level - 1) & (rows[:, level - 1] != 0)][:, :level])
            yield pa.RecordBatch.from_arrays([*columns(rows), pa.array(n)], [*names, "n"])
    counted = docs.mapInArrow(count, ", ".join(f"{c} long" for c in (*names, "n")))
    return counted.groupBy(*names).agg(F.sum("n").alias("n"))


def partitioned(docs: DataFrame, words: DataFrame, longest: int, budget: int
                ) -> tuple[Prefixes, list[tuple[np.ndarray, np.ndarray]]]:
    """The prefixes, and words and counts of those of two words and more that are made longer."""
    frequent = words.where(F.col("word").isNotNull())
    n, total = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(FREQUENT_BITS[1], max(FREQUENT_BITS[0], 1 << (16 * n).bit_length()))
    prefixes = Prefixes(bit_set(frequent.select("h"), bits), longest)
    budget = max(budget, -(-total // EXTENDED))
    prefixes.groups = -(-2 * total // budget) or 1
    long, of_level = [], frequent.select(F.col("h").alias("h1"), "n")
    for level in range(1, longest):
        # their counts are above the budget and add up to the total at most, so they are few
        found = of_level.where(F.col("n") > budget).toArrow()
        rows = np.stack([found[f"h{k + 1}"].to_numpy() for k in range(level)], 1).view(U)
        prefixes.long.append(np.sort(phrase_keys(rows, level)))
        if level > 1:
            long.append((rows, found["n"].to_numpy()))
        if not len(rows) or level + 1 == longest:
            break
        of_level = prefix_counts(docs, prefixes, level + 1)
    return prefixes, long


# ---- subtrees ---------------------------------------------------------------------------

def dealt_suffixes(docs: DataFrame, prefixes: Prefixes) -> DataFrame:
    """group, h1, h2, ... and n: the suffixes with the group of their prefix, equal ones of a chunk once."""
    get = shared(docs.sparkSession, prefixes)
    names = [f"h{k + 1}" for k in range(prefixes.longest)]

    def deal(batches):
        own = get()
        for chunk in chunks(batches):
            rows, n = merged(own.suffixes(chunk))
            yield pa.RecordBatch.from_arrays([pa.array(own.group(rows)), *columns(rows), pa.array(n)],
                                             ["group", *names, "n"])
    return docs.mapInArrow(deal, ", ".join(f"{c} long" for c in ("group", *names, "n")))


class Subtrees:
    """The depth-truncated suffix subtrees of one group: sorted distinct suffixes with their totals."""

    def __init__(self, prefixes: Prefixes, budget: int):
        self.prefixes, self.budget = prefixes, budget
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged_at = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((rows, counts))
        self.held += len(rows)
        if self.held > self.merged_at + 2 * self.budget:
            self.parts = [self.leaves()]
            self.held = self.merged_at = len(self.parts[0][0])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(np.concatenate([p[0] for p in self.parts]),
                      np.concatenate([p[1] for p in self.parts]))

    def phrases(self, least: int):
        """(words of the phrases, counts) for each length, of phrases with `least` occurrences. A prefix
        that was made longer has leaves in several groups; its count is known already."""
        rows, counts = self.leaves()
        longer = np.ones(len(rows), bool)
        for length in range(1, self.prefixes.longest + 1):
            new = (rows[1:, :length] != rows[:-1, :length]).any(1)
            begins = np.flatnonzero(np.concatenate([[True], new]))
            totals = np.add.reduceat(counts, begins)
            # zeros end a suffix: it holds no phrase of this length
            good = (totals >= least) & (rows[begins, length - 1] != 0) & (length > 1)
            if length < self.prefixes.longest:
                longer &= self.prefixes.extended(rows, length)
                good &= ~longer[begins]
            yield rows[begins[good]][:, :length], totals[good]


PHRASES = ("key long, words array<long>, a long, lefts array<long>, rights array<long>, "
           "within array<long>")


def described(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Phrases of one length with the keys of the parts that cuts leave and of the shorter phrases inside."""
    n, length = words.shape

    def lists(parts):
        flat = signed(np.stack(parts, 1).ravel()) if parts else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(parts)),
                                        pa.array(flat))
    cuts = range(1, length)
    inner = [phrase_keys(words, m, s) for m in range(2, length) for s in range(length - m + 1)]
    return pa.RecordBatch.from_arrays([
        pa.array(signed(phrase_keys(words, length))), lists(list(words.T)), pa.array(counts),
        lists([phrase_keys(words, k) for k in cuts]),
        lists([phrase_keys(words, length - k, k) for k in cuts]), lists(inner)],
        [c.split()[0] for c in PHRASES.split(", ")])


def frequent_phrases(docs: DataFrame, prefixes: Prefixes, long: list, least: int,
                     budget: int) -> DataFrame:
    """key, words, a, lefts, rights, within of all phrases of two words and more with `least` occurrences."""
    get = shared(docs.sparkSession, prefixes)
    names = [f"h{k + 1}" for k in range(prefixes.longest)]

    def build(batches):
        own, current, trees = get(), None, None

        def done():
            if trees is not None:
                for words, counts in trees.phrases(least):
                    if len(words):
                        yield described(words, counts)
        for batch in batches:
            group = batch["group"].to_numpy()
            rows = np.stack([batch[c].to_numpy() for c in names], 1).view(U)
            n = batch["n"].to_numpy()
            cuts = np.flatnonzero(np.diff(group)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(group)]):
                if begin == end:
                    continue
                if group[begin] != current:
                    yield from done()
                    current, trees = group[begin], Subtrees(own, budget)
                trees.add(rows[begin:end], n[begin:end])
        yield from done()
        give_back()
    # the number of groups follows from the budget; Spark puts small ones together
    grown = dealt_suffixes(docs, prefixes).repartition("group").sortWithinPartitions("group")
    found = grown.mapInArrow(build, PHRASES)
    for rows, counts in long:
        if len(rows):
            found = found.unionByName(docs.sparkSession.createDataFrame(
                pa.Table.from_batches([described(rows, counts)])))
    return found


# ---- scores -----------------------------------------------------------------------------

def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with language, l, r and score of their lowest cut."""
    counts = words.where(F.col("word").isNotNull()).select(F.col("h").alias("key"), "n", "lang")
    both = counts.select("key", "n").unionByName(phrases.select("key", F.col("a").alias("n")))
    left, right = (both.select(F.col("key").alias(f"{x}_key"), F.col("n").alias(x)) for x in "lr")
    cuts = phrases.select("key", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut"))
    cuts = cuts.select("key", "a", "k", F.col("cut.lefts").alias("l_key"),
                       F.col("cut.rights").alias("r_key")).join(left, "l_key").join(right, "r_key")
    exact = F.expr(f"""cast(cast(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast({SCALE} as
        decimal(7,0)) as decimal(38,0)) div cast(cast(l as decimal(15,0)) * cast(r as decimal(15,0))
        as decimal(38,0)) as bigint)""")
    lowest = cuts.withColumn("score", exact).groupBy("key").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inside = phrases.select(F.explode("within").alias("key"), "a").groupBy("key").agg(
        F.max("a").alias("longer"))
    kept = phrases.join(inside, "key", "left").where(
        F.col("longer").isNull() | (WITHIN[0] * F.col("longer") < WITHIN[1] * F.col("a")))
    first = counts.select(F.col("key").alias("h"), "lang")
    return kept.select("key", "words", "a").join(lowest, "key").join(
        first, F.element_at("words", 1) == F.col("h")).select(
        "lang", "key", "words", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP,
                 budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language."""
    docs = lang_and_text(docs)
    words = written(word_counts(docs, least))
    prefixes, long = partitioned(docs, words, longest, budget)
    phrases = written(frequent_phrases(docs, prefixes, long, least, budget))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored(phrases, words).withColumn("place", F.rank().over(order)).where(
        F.col("place") <= top).drop("place")
    # only phrases that may be among the first get their words as text
    spelt = words.where(F.col("word").isNotNull()).select("h", "word")
    texts = best.select("key", F.posexplode("words").alias("at", "h")).join(spelt, "h").groupBy(
        "key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt")).select(
        "key", F.concat_ws(" ", F.col("spelt.word")).alias("phrase"))
    totals = words.where(F.col("word").isNull()).select("lang", "n")
    final = order.orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.drop("words").join(texts, "key").withColumn("rank", F.row_number().over(final).cast(
        "long")).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


COLLOCATIONS_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
split as materialized (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
    select lang, m, array_to_string(w[i:i + m - 1], ' ') as g from (
        select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) as i
        from split, (values (1), (2), (3)) t(m) where len(w) >= m)),
f as materialized (select lang, m, g, count(*)::hugeint as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
cand as materialized (
    select lang, m, g, f as a, string_split(g, ' ') as w from f where m > 1 and f >= 10),
parts as (
    select lang, g, a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y
    from (select *, unnest(generate_series(1, m - 1)) as k from cand)),
cuts as (
    select p.lang, p.g, p.a, k, x.f as l, y.f as r, (1000000 * p.a * p.a) // (x.f * y.f) as score
    from parts p join f x on x.lang = p.lang and x.g = p.x join f y on y.lang = p.lang and y.g = p.y),
low as (select *, row_number() over (partition by lang, g order by score, k) as turn from cuts),
inner_of as (
    select lang, w[1] || ' ' || w[2] as g, a from cand where m = 3 union all
    select lang, w[2] || ' ' || w[3], a from cand where m = 3),
longer as (select lang, g, max(a) as a from inner_of group by all),
kept as (
    select low.* from low left join longer o on o.lang = low.lang and o.g = low.g
    where turn = 1 and (o.a is null or 100 * o.a < 50 * low.a)),
ranked as (
    select *, row_number() over (partition by lang
        order by score desc, a desc, g) as rank from kept)
select lang, rank, g as phrase, a::bigint as a, l::bigint as l, r::bigint as r,
    n, score::bigint as score
from ranked join n using (lang) where rank <= 2000"""
