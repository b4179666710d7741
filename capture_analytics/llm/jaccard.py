"""Jaccard join of documents on 5-word shingles by prefix trees.

Sets. A document's set is its distinct shingles, as 64-bit hashes; equal sets are one class from
here on, told by a hash of the whole set, and their documents come back at the end.
1. Probe. Each class sends out the shingles whose hash lies below a threshold, the same share of
   any set, and those of its prefix. A shingle is dead for a class if no class of a size that
   could match has it. A class with more dead shingles than a match can lack has no link.
2. Order. The classes that are left send out all shingles. How many classes hold a shingle gives the
   global order, rarest first; sets are stored in it. Shingles of one class only are counted and
   dropped, and with too many of those a class is out.
3. Groups. Two linked classes share a shingle of their prefixes, so classes with a common prefix
   shingle and sizes that can follow each other go to one group: a component of those edges.
4. Prefix tree. A group's sets are put into a path-compressed tree in the global order, one after
   the other. A set is first looked up: the overlap with a path is counted once for all sets below
   it, and a subtree is left when the overlap so far and what can remain, bounded by the longest
   rest below and the rest of the set, cannot reach the threshold for the sizes below, or when all
   sets below are already linked with it over others. Every link that joins two parts is kept.
   A large group is cut into slices. First the class with the fewest rare shingles, to which near
   copies mostly link, visits all slices; then every class not yet linked to it does, in bounded
   blocks. So each pair is either compared or already
   connected, and no more than one edge for each visitor and part is made.
5. The components of the links, with the smallest document of their classes, are the result.
6. Number of links. Parts do not tell how many links there are, so for the join every class also
   visits all slices of its group, in the same blocks and under the bounds of lengths and overlaps
   alone. Each class that it links to counts with its documents, and so do the other documents of
   its own class.

Cases: null and empty texts have an empty set, link with nothing and are their own component; fewer
than five words are one shingle; rows that repeat a doc_id are separate rows of the same
component if their texts link; a null doc_id is never the smallest unless alone; texts are read
whole, whatever their length; an empty table gives no rows; other columns, whatever their names, are
not read, and kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import (
    BitSet, bit_set, components, documents, id_and_text, pieces, shared, without, written)
from capture_analytics.llm.tokens import U, Words, mix, shingles, signed

SHINGLE = 5
PERCENT = 80
# Share of the hash range whose shingles probe for partners.
PROBE = 0.4
# Classes that hold a shingle are told apart up to this number; the order does not need more.
FREQUENT = 1_023
# Shingles of a slice, and visitors of a block.
SLICE_SHINGLES = 128_000
BLOCK_VISITORS = 500
# Sets that were last linked to; a set is held against them before the tree is walked.
RECENT = 8


def required(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any set that it links to."""
    return (percent * n + 99) // 100


def sets_of(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = Words(texts)
    runs = shingles(words.hashes, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        elif b > a:
            # a short sequence is no longer one's shingle
            out.append(mix(shingles(words.hashes[a:b], b - a) + U(b - a)))
        else:
            out.append(np.empty(0, U))
    return out


def class_of(own: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), U).view(np.int64))


def low(tokens: np.ndarray) -> np.ndarray:
    return tokens < U(int(PROBE * 2 ** 64))


def class_rows(batches):
    """doc_id, text_hash, n, low (probing shingles), class of every document."""
    for batch in batches:
        hashes = batch["text_hash"].to_pylist()
        done = 0
        for ids, texts in pieces([batch]):
            sets = sets_of(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(hashes[done:done + len(ids)], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(low(s).sum()) for s in sets], pa.int64()),
                pa.array([class_of(s) for s in sets], pa.int64())],
                ["doc_id", "text_hash", "n", "low", "class"])
            done += len(ids)


def token_rows(percent: int, get=None):
    """token, n, class: the probing and prefix shingles of each class that a task sees, or, with a
    bit set of classes, all shingles of those that may be in it."""
    def run(batches):
        wanted = get() if get else None
        seen: set[int] = set()
        for _, texts in pieces(batches):
            tokens, sizes, classes = [], [], []
            for own in sets_of(texts):
                name = class_of(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                if wanted is None:
                    sent = own[:max(int(low(own).sum()),
                                    len(own) - required(len(own), percent) + 1)]
                elif wanted.has(np.array([name], np.int64))[0]:
                    sent = own
                else:
                    continue
                tokens.append(sent)
                sizes.append(np.full(len(sent), len(own)))
                classes.append(np.full(len(sent), name))
            if tokens:
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(classes))], ["token", "n", "class"])
    return run


def fits(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small >= percent * large


def ordered_rows(batches):
    """(tokens, sizes, classes) of sorted rows, each batch led by the last row before it."""
    last = [np.empty(0, np.int64)] * 3
    for batch in batches:
        columns = [np.concatenate([before, batch[name].to_numpy()])
                   for before, name in zip(last, ("token", "n", "class"))]
        if not len(columns[0]):
            continue
        fresh = np.ones(len(columns[0]), bool)
        fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[2][1:] != columns[2][:-1])
        columns = [c[fresh] for c in columns]
        yield columns, len(last[0])
        last = [c[-1:] for c in columns]


def live_rows(percent: int):
    """class, live: how many probing shingles have another class of a fitting size. Rows come
    sorted by shingle and size, so only neighbours need a look."""
    def run(batches):
        pending = False
        for (token, n, name), led in ordered_rows(batches):
            near = (token[1:] == token[:-1]) & fits(n[:-1], n[1:], percent)
            live = np.zeros(len(token), bool)
            live[1:] |= near
            live[:-1] |= near
            if led:
                # the leading row is counted here only for what its own batch could not see
                live[0] = live[0] and not pending
            pending = bool(len(near) and near[-1]) or (len(token) == 1 and pending)
            out = name[live & low(token.view(U))]
            if len(out):
                name, count = np.unique(out, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(count)],
                                                 ["class", "live"])
    return run


def frequency_rows(batches):
    """class, n, key: each shingle with its place in the global order, the number of classes that
    hold it (up to FREQUENT) and 53 bits of its hash."""
    token, held = None, []

    def flushed(count):
        out = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        keys = (U(count) << U(53)) | (np.full(len(out[0]), token, np.int64).view(U) >> U(11))
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]),
                                           pa.array(signed(keys))], ["class", "n", "key"])

    for (tokens, n, name), led in ordered_rows(batches):
        tokens, n, name = tokens[led:], n[led:], name[led:]
        if not len(tokens):
            continue
        begins = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1, [len(tokens)]])
        # the first run may continue the one before, the last may go on in the next batch
        whole = []
        for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
            if k == 0 and token is not None and tokens[0] != token and held:
                yield flushed(min(sum(len(h[0]) for h in held), FREQUENT))
            if k == 0 and token == tokens[0] or k == len(begins) - 2:
                if token != tokens[a]:
                    if held:
                        yield flushed(min(sum(len(h[0]) for h in held), FREQUENT))
                    token, sent = tokens[a], False
                held.append((name[a:b], n[a:b]))
                # a frequent shingle needs no count, so its rows need not wait
                if sent or sum(len(h[0]) for h in held) >= FREQUENT:
                    sent = True
                    yield flushed(FREQUENT)
            else:
                whole.append((a, b))
        if whole:
            a, b = whole[0][0], whole[-1][1]
            lengths = np.diff([x for x, _ in whole] + [b])
            count = np.minimum(np.repeat(lengths, lengths), FREQUENT).astype(U)
            keys = (count << U(53)) | (tokens[a:b].view(U) >> U(11))
            yield pa.RecordBatch.from_arrays([pa.array(name[a:b]), pa.array(n[a:b]),
                                              pa.array(signed(keys))], ["class", "n", "key"])
    if held:
        yield flushed(FREQUENT if sent else min(sum(len(h[0]) for h in held), FREQUENT))


def set_rows(percent: int):
    """class, n, prefix, keys: the shared shingles of each class in global order, and how many of
    them belong to its prefix; classes that cannot link are left out."""
    def closed(name, n, keys):
        shared_keys = keys[(keys >> U(53)) > U(1)]
        prefix = n - required(n, percent) + 1 - (len(keys) - len(shared_keys))
        return (name, n, prefix, signed(shared_keys)) if prefix > 0 and len(shared_keys) else None

    def run(batches):
        own, held = None, []
        for batch in batches:
            name, n = batch["class"].to_numpy(), batch["n"].to_numpy()
            keys = batch["key"].to_numpy().view(U)
            if not len(name):
                continue
            begins = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]])
            out = []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                if own is not None and own[0] != name[a]:
                    out.append(closed(*own, np.concatenate(held)))
                    held = []
                own = (int(name[a]), int(n[a]))
                held.append(keys[a:b])
            yield batch_of(out)
        if own is not None:
            yield batch_of([closed(*own, np.concatenate(held))])

    def batch_of(out):
        out = [x for x in out if x]
        return pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
            pa.array([x[2] for x in out], pa.int64()),
            pa.array([x[3] for x in out], pa.list_(pa.int64()))], ["class", "n", "prefix", "keys"])
    return run


def edge_rows(percent: int):
    """a, b: each class of a run of fitting sizes that share a shingle, with the run's first."""
    def run(batches):
        leader = None
        for (token, n, name), led in ordered_rows(batches):
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | ~fits(n[:-1], n[1:], percent)
            heads = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            first = name[heads]
            if led and leader is not None:
                first[heads == 0] = leader
            leader = int(first[-1])
            pairs = np.unique(np.stack([name, first], 1)[name != first], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                             ["a", "b"])
    return run


class Node:
    """A part of a path that all sets below share. `rest` is the longest rest below the part."""
    __slots__ = ("part", "children", "ends", "rest", "least", "most", "one", "mixed")

    def __init__(self, part):
        self.part, self.children, self.ends = part, {}, []
        self.rest, self.least, self.most = 0, 1 << 62, 0
        self.one, self.mixed = None, False


class Tree:
    """Sets in a prefix tree, with the parts that their links join."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, Node(np.empty(0, U))
        self.parent: list[int] = []
        self.sizes: list[int] = []
        self.recent: dict[int, np.ndarray] = {}

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def new(self, n: int, part: int = -1) -> int:
        """The number of a new set; `part` is a set of its part, if it has one already."""
        self.sizes.append(n)
        self.parent.append(len(self.parent) if part < 0 else self.find(part))
        return len(self.parent) - 1

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)

    def insert(self, number: int, keys: np.ndarray) -> None:
        n = self.sizes[number]
        node, at = self.root, 0
        while True:
            self.note(node, number, n, len(keys) - at)
            if at == len(keys):
                node.ends.append(number)
                return
            child = node.children.get(int(keys[at]))
            if child is None:
                child = node.children[int(keys[at])] = Node(keys[at:])
                self.note(child, number, n, 0)
                child.ends.append(number)
                return
            m = min(len(child.part), len(keys) - at)
            differ = np.flatnonzero(child.part[:m] != keys[at:at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.part):
                upper = Node(child.part[:same])
                upper.rest = child.rest + len(child.part) - same
                upper.least, upper.most = child.least, child.most
                upper.one, upper.mixed = child.one, child.mixed
                child.part = child.part[same:]
                upper.children[int(child.part[0])] = child
                node.children[int(keys[at])] = child = upper
            node, at = child, at + same

    def note(self, node: Node, number: int, n: int, rest: int) -> None:
        node.rest = max(node.rest, rest)
        node.least, node.most = min(node.least, n), max(node.most, n)
        if node.one is None:
            node.one = number
        elif not node.mixed and self.find(node.one) != self.find(number):
            node.mixed = True

    def links(self, keys: np.ndarray, n: int, part: int = -1):
        """A set of each part that the set links to, except parts it is in already: `part` is a
        set of its own part. Each part that was given counts as its own from then on."""
        percent, mine = self.percent, set()
        if part >= 0:
            mine.add(self.find(part))
        smallest, largest = required(n, percent), 100 * n // percent
        for other, theirs in list(self.recent.items()):
            root, size = self.find(other), self.sizes[other]
            if root in mine or size < smallest or size > largest or not len(theirs):
                continue
            place = np.minimum(np.searchsorted(theirs, keys), len(theirs) - 1)
            overlap = int((theirs[place] == keys).sum())
            if 100 * overlap >= percent * (n + size - overlap):
                mine.add(root)
                yield other
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            if node.most < smallest or node.least > largest:
                continue
            if node.one is not None and not node.mixed and self.find(node.one) in mine:
                continue
            if len(node.part):
                place = np.searchsorted(keys[at:], node.part) + at
                inside = place < len(keys)
                overlap += int((keys[place[inside]] == node.part[inside]).sum())
                at = int(place[-1]) + bool(inside[-1] and keys[place[-1]] == node.part[-1])
            low_size = max(node.least, smallest)
            needed = -(-percent * (n + low_size) // (100 + percent))
            if overlap + min(node.rest, len(keys) - at) < needed:
                continue
            for other in node.ends:
                size = self.sizes[other]
                if 100 * overlap >= percent * (n + size - overlap):
                    root = self.find(other)
                    if root not in mine:
                        mine.add(root)
                        yield other
            following = node.children.get(int(keys[at])) if at < len(keys) else None
            stack.extend((c, at, overlap) for c in node.children.values() if c is not following)
            if following is not None:
                stack.append((following, at, overlap))


    def linked(self, keys: np.ndarray, n: int):
        """Every set of the tree that the set links to."""
        percent = self.percent
        smallest, largest = required(n, percent), 100 * n // percent
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            if node.most < smallest or node.least > largest:
                continue
            if len(node.part):
                place = np.searchsorted(keys[at:], node.part) + at
                inside = place < len(keys)
                overlap += int((keys[place[inside]] == node.part[inside]).sum())
                at = int(place[-1]) + bool(inside[-1] and keys[place[-1]] == node.part[-1])
            needed = -(-percent * (n + max(node.least, smallest)) // (100 + percent))
            if overlap + min(node.rest, len(keys) - at) < needed:
                continue
            for other in node.ends:
                if 100 * overlap >= percent * (n + self.sizes[other] - overlap):
                    yield other
            stack.extend((c, at, overlap) for c in node.children.values())


def tree_links(members, visitors, percent: int) -> list[tuple[int, int]]:
    """Links (class, class) that join all parts of the members, (class, n, keys, label), and one to
    each other part that a visitor links to. Equal labels are parts that are known already."""
    tree, names, of_label, out = Tree(percent), [], {}, []
    # sets with the fewest rare shingles first: near copies mostly link to those
    for name, n, keys, label in sorted(members, key=lambda m: (m[1] - len(m[2]), m[1], m[0])):
        known = of_label.get(label, -1)
        found = list(tree.links(keys, n, known))
        number = tree.new(n, known)
        names.append((name, keys))
        of_label.setdefault(label, number)
        for other in found:
            out.append((name, names[other][0]))
            tree.join(other, number)
            tree.recent.pop(other, None)
            tree.recent[other] = names[other][1]
            if len(tree.recent) > RECENT:
                del tree.recent[next(iter(tree.recent))]
        tree.insert(number, keys)
    for name, n, keys, label in visitors:
        out.extend((name, names[other][0])
                   for other in tree.links(keys, n, of_label.get(label, -1)))
    return out


def tree_counts(members, visitors, percent: int) -> list[tuple[int, int]]:
    """(class, documents of all members that it links to) of each visitor; the label of a member,
    (class, n, keys, label), is the number of its documents."""
    tree = Tree(percent)
    for _, n, keys, _ in members:
        tree.insert(tree.new(n), keys)
    return [(name, sum(members[i][3] for i in tree.linked(keys, n) if members[i][0] != name))
            for name, n, keys, _ in visitors]


def slice_rows(percent: int, of_slice, names: tuple[str, str]):
    """The pairs that `of_slice` gives for each slice, whose members come before its visitors."""
    def closed(members, visitors):
        pairs = of_slice(members, visitors, percent)
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
            list(names))

    def run(batches):
        own, sides = None, ([], [])
        for batch in batches:
            keys = batch["keys"]
            for i, key in enumerate(zip(batch["root"].to_pylist(), batch["slice"].to_pylist(),
                                        batch["block"].to_pylist())):
                if key != own:
                    if own is not None:
                        yield closed(*sides)
                    own, sides = key, ([], [])
                sides[bool(batch["visits"][i].as_py())].append((
                    batch["class"][i].as_py(), batch["n"][i].as_py(),
                    np.array(keys[i].values.to_numpy()).view(U), batch["label"][i].as_py()))
        if own is not None:
            yield closed(*sides)
    return run


COLUMNS = ("root", "slice", "block", "visits", "class", "n", "keys", "label")


def visit(members: DataFrame, visitors: DataFrame, percent: int, of_slice, names) -> DataFrame:
    """What the slices give when visitors meet the members of the same slice and block."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.select(*COLUMNS).unionByName(visitors.select(*COLUMNS))
    return placed.repartition(n, "root", "slice", "block").sortWithinPartitions(
        "root", "slice", "block", "visits").mapInArrow(
        slice_rows(percent, of_slice, names), ", ".join(f"{name} long" for name in names))


def every_slice():
    return F.explode(F.sequence(F.lit(0), F.col("slices") - 1))


def groups_of(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The sets of all classes that may link, with the group `root` that holds all partners of a
    class, the group's number of slices and leader, and the class's slice."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens, rows = docs.select("doc_id", "text"), "token long, n long, class long"

    probes = tokens.mapInArrow(token_rows(percent), rows).repartition(n, "token")
    live = probes.sortWithinPartitions("token", "n", "class").mapInArrow(
        live_rows(percent), "class long, live long").groupBy("class").agg(
        F.sum("live").alias("live"))
    lacking = F.expr(f"n - floor(({percent} * n + 99) / 100)")
    hopeful = classes.where("n > 0").join(live, "class", "left").where(
        F.col("low") - F.coalesce("live", F.lit(0)) <= lacking)
    wanted: BitSet = bit_set(hopeful.select(F.col("class").alias("h")))

    get = shared(spark, wanted)
    keyed = tokens.mapInArrow(token_rows(percent, get), rows).repartition(
        n, "token").sortWithinPartitions("token", "class").mapInArrow(
        frequency_rows, "class long, n long, key long")
    # keys are positive and so sort as unsigned
    sets = written(keyed.repartition(n, "class").sortWithinPartitions("class", "key").mapInArrow(
        set_rows(percent), "class long, n long, prefix long, keys array<long>"))

    prefixes = sets.select(F.explode(F.slice("keys", 1, F.least(F.col("prefix"), F.size(
        "keys").cast("long")).cast("int"))).alias("token"), "n", "class")
    near = prefixes.repartition(n, "token").sortWithinPartitions("token", "n", "class").mapInArrow(
        edge_rows(percent), "a long, b long").distinct()
    groups = written(components(near))
    grouped = sets.join(groups, F.col("class") == F.col("node")).drop("node")
    shape = grouped.groupBy(F.col("root").alias("of")).agg(F.ceil(F.sum(F.size(
        "keys")) / SLICE_SHINGLES).cast("int").alias("slices"), F.max_by(
            "class", F.struct(F.col("prefix") / F.col("n"), "class")).alias("leader"))
    return written(grouped.join(shape, F.col("root") == F.col("of")).drop("of").withColumn(
        "slice", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int")))


def link_counts(grouped: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """class, links: to how many documents of other classes the documents of a class link."""
    sized = grouped.join(classes.select(F.col("class").alias("known"), F.col("size").alias("label")),
                         F.col("class") == F.col("known")).drop("known")
    shape = grouped.groupBy(F.col("root").alias("of")).agg(F.ceil(F.count("*") / BLOCK_VISITORS).cast(
        "int").alias("blocks"))
    sized = written(sized.join(shape, F.col("root") == F.col("of")).drop("of"))
    members = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "visits", F.lit(False))
    visitors = sized.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast(
        "int")).withColumn("slice", every_slice()).withColumn("visits", F.lit(True))
    return visit(members, visitors, percent, tree_counts, ("class", "links")).groupBy("class").agg(
        F.sum("links").alias("links"))


def links(grouped: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links between classes that connect every two linked classes."""
    own = grouped.withColumns({"block": F.lit(0), "visits": F.lit(False), "label": F.col("class")})
    lead = grouped.where("slices > 1 and class = leader").withColumn("slice", every_slice()).withColumns(
        {"block": F.lit(0), "visits": F.lit(True), "label": F.col("class")})
    first = written(visit(own, lead, percent, tree_links, ("a", "b")))

    large = grouped.where("slices > 1")
    if large.limit(1).count() == 0:
        return first
    parts = written(components(first))
    labelled = large.join(parts, F.col("class") == F.col("node"), "left").withColumn(
        "label", F.coalesce(parts["root"], "class")).drop("node").drop(parts["root"])
    lead_label = labelled.where("class = leader").select(
        F.col("root").alias("of"), F.col("label").alias("lead"))
    labelled = written(labelled.join(lead_label, F.col("root") == F.col("of")).drop("of"))
    strays = labelled.where("label <> lead")
    blocks = strays.groupBy(F.col("root").alias("of")).agg(F.ceil(F.count("*") / BLOCK_VISITORS).cast(
        "int").alias("blocks"))
    members = labelled.join(blocks, F.col("root") == F.col("of")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "visits", F.lit(False))
    visitors = strays.join(blocks, F.col("root") == F.col("of")).withColumn(
        "block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int")).withColumn(
        "slice", every_slice()).withColumn("visits", F.lit(True))
    return first.unionByName(visit(members, visitors, percent, tree_links, ("a", "b")))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, counted: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every document; with `counted` also n_links,
    the number of other rows whose texts link to it."""
    plain = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = written(plain.select("doc_id", "text", "text_hash").mapInArrow(
        class_rows, "doc_id long, text_hash long, n long, low long, class long"))
    classes = written(rows.groupBy("class").agg(
        F.first("n").alias("n"), F.first("low").alias("low"), F.min("doc_id").alias("least"),
        F.count("*").alias("size")))
    grouped = groups_of(plain, classes, percent)
    roots = components(links(grouped, percent))
    placed = classes.where("n > 0").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "least", "size", F.coalesce("root", "class").alias("root"))
    smallest = placed.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    of_class = placed.join(smallest, F.col("root") == F.col("of")).select(
        F.col("class").alias("of_class"), "component_id", "size")
    names = ["doc_id", "text_hash", "n_shingles", "component_id"]
    if counted:
        found = link_counts(grouped, classes, percent).withColumnRenamed("class", "linked")
        of_class = of_class.join(found, F.col("of_class") == F.col("linked"), "left").withColumn(
            "n_links", F.coalesce("links", F.lit(0)) + F.col("size") - 1)
        names.append("n_links")
    out = rows.join(of_class, F.col("class") == F.col("of_class"), "left").withColumn(
        "n_shingles", F.col("n")).withColumn("component_id", F.when(
            F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select(*[F.coalesce("n_links", F.lit(0)).alias(c) if c == "n_links" else c
                        for c in names])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that link, over any number of links, to one with a smaller id."""
    found = jaccard_components(docs)
    return without(docs, found.where("doc_id <> component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), counted=True).drop("text_hash")


# What the operator must give, in plain Python; the tests hold it against this.
def brute_force(rows: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple]:
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(lower).split()
        runs = {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        sets.append(runs or ({tuple(words)} if words else set()))
    part = list(range(len(rows)))

    def find(i: int) -> int:
        while part[i] != i:
            i = part[i]
        return i
    holders: dict[tuple, list[int]] = {}
    for i, own in enumerate(sets):
        common: dict[int, int] = {}
        for run in own:
            for j in holders.get(run, ()):
                common[j] = common.get(j, 0) + 1
            holders.setdefault(run, []).append(i)
        for j, both in common.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least[find(i)] if sets[i] else doc_id)
            for i, (doc_id, _) in enumerate(rows)]
