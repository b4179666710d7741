"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fit: of the labelled training rows at most `EXAMPLES` (by the order of a hash of their id) are
taken as examples; those with equal sets of words and the same label count once, as the one with
the smallest id, and all others stay. Every word of the examples is a term. A term's weight is its
idf, raised by what it tells of the label: the lower bound of its log odds ratio among toxic
examples, so a document's few telling words are not drowned by all others and no word is left out,
however few the labels. Examples are TF-IDF vectors of unit length, ordered by their heaviest term
so that alike ones are close, and cut into blocks; the inverted index holds, for each term and block,
its postings and the largest weight; a term of more than `WIDE` of the examples has a line of
weights instead. The examples are bounded by a parameter, so the index is broadcast.

Query: a document's blocks are visited from the largest upper bound down until the bound falls
below the k-th best cosine, so the neighbours are exact, ties to the smaller example. Their votes
are weighted by closeness and shrunk towards the share of toxic examples, which keeps a
score near the share that is really toxic. A document without any term has the share of
toxic examples without terms. The neighbours are returned as evidence.

Cases: null and empty texts have no terms and get that share; without labels of both classes the
score is the share of toxic examples, 0 without any. Rows that repeat get the same score each. A
label that repeats counts as toxic if any of its rows does; null ids and null labels are left out. Texts
are read whole, whatever their length; an empty table gives no rows; other columns, whatever their
names, are not read, and kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import (
    documents, give_back, hash_sample, id_and_text, pieces, remainder, shared, without)
from capture_analytics.llm.tokens import ALNUM, Words, expand, signed

EXAMPLES = 4_096
PLAIN = 0.2
ERRORS = 2.0
NEIGHBOURS = 32
BLOCK = 64
WIDE = 1 / 8
SHRINK = 0.05
FOLDS = 5
# Bytes of vectors whose scores a task remembers.
REMEMBER = 1 << 25
SCORES = ("doc_id long, text_hash long, score double, predicted int, "
          "evidence array<struct<doc_id:long,toxic:int,cosine:double>>")


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, terms array<struct<term, n>>, by term, of few documents."""
    def count(batches):
        for ids, texts in pieces(batches):
            words = Words(texts, ALNUM)
            rows = []
            for a, b in zip(words.first[:-1], words.first[1:]):
                term, n = np.unique(signed(words.hashes[a:b]), return_counts=True)
                rows.append([{"term": t, "n": c} for t, c in zip(term.tolist(), n.tolist())])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array(rows, pa.list_(pa.struct([("term", pa.int64()), ("n", pa.int64())])))],
                ["doc_id", "terms"])
    return id_and_text(docs).mapInArrow(
        count, "doc_id long, terms array<struct<term:long,n:long>>")


class Index:
    """Block-max inverted index of the examples' unit vectors: postings by term and example, and for
    each block of examples that holds a term its range of postings and the largest weight."""

    def __init__(self, terms: dict[int, float], examples: list[tuple[int, int, list]],
                 block: int = BLOCK):
        self.terms = np.array(sorted(terms), np.int64)
        self.weights = np.array([terms[t] for t in self.terms.tolist()])
        labels, empty, full = [], [], []
        for doc, toxic, own in examples:
            own = np.asarray(own, np.int64).reshape(-1, 2)
            number, weight = self.vector(own[:, 0], own[:, 1])
            labels.append(toxic)
            if not len(number):
                empty.append(toxic)
                continue
            order = np.argsort(number)
            number, weight = number[order], weight[order]
            strong = int(np.argmax(weight))
            # examples with the same heaviest term share blocks, so few blocks are near a text
            full.append((int(number[strong]), -float(weight[strong]), doc, toxic, number, weight))
        full.sort(key=lambda v: v[:4])
        self.share = sum(labels) / len(labels) if labels else 0.0
        self.empty_share = (sum(empty) + self.share) / (len(empty) + 1)
        self.ids = np.array([v[2] for v in full], np.int64)
        self.labels = np.array([v[3] for v in full], np.int64)
        self.block, self.n_blocks = block, -(-len(full) // block)
        term = np.concatenate([np.zeros(0, np.int64), *[v[4] for v in full]])
        weight = np.concatenate([np.zeros(0), *[v[5] for v in full]])
        doc = np.repeat(np.arange(len(full)), [len(v[4]) for v in full])
        order = np.argsort(term, kind="stable")
        term, self.doc, self.weight = term[order], doc[order].astype(np.int32), weight[order]
        held = term * max(self.n_blocks, 1) + self.doc // block
        self.begin = np.flatnonzero(np.append(True, held[1:] != held[:-1])[:len(held)])
        self.size = np.diff(np.append(self.begin, len(held)))
        self.held = (self.doc[self.begin] // block).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(held) else np.zeros(0)
        self.first = np.searchsorted(term[self.begin], np.arange(len(self.terms) + 1))
        # terms of very many examples have a whole line of weights, 1 / WIDE times their postings at most
        wide = np.flatnonzero(np.bincount(term, minlength=len(self.terms)) > WIDE * len(full))
        self.line = np.full(len(self.terms), -1)
        self.line[wide] = np.arange(len(wide))
        self.wide = np.zeros((len(wide), len(full)))
        known = self.line[term] >= 0
        self.wide[self.line[term[known]], self.doc[known]] = self.weight[known]

    def vector(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights) of unit length of a document's known terms."""
        terms, counts = np.asarray(terms, np.int64), np.asarray(counts, float)
        if not len(self.terms) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        near = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[near] == terms
        near, counts = near[known], counts[known]
        weight = (1 + np.log(counts)) * self.weights[near]
        return near, weight / max(np.sqrt((weight ** 2).sum()), 1e-300)

    def nearest(self, terms, weights, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with any common term, ties to the smaller id.

        Blocks are read from the largest bound down, some more each time, until the bound of the
        next is below the k-th best cosine.
        """
        order = np.argsort(terms, kind="stable")
        terms, weights = np.asarray(terms)[order], np.asarray(weights)[order]
        line = self.line[terms]
        whole = np.zeros(len(self.wide))
        whole[line[line >= 0]] = weights[line >= 0]
        whole = whole @ self.wide
        terms, weights = terms[line < 0], weights[line < 0]
        number = self.first[terms + 1] - self.first[terms]
        entry, weight = expand(self.first[terms], number), np.repeat(weights, number)
        # widespread terms are summed already, so their part of a bound is the most that a block has
        bound = np.maximum.reduceat(whole, np.arange(self.n_blocks) * self.block) + np.bincount(
            self.held[entry], weights=weight * self.most[entry], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rank = np.full(self.n_blocks, len(order))
        rank[order] = np.arange(len(order))
        rank = rank[self.held[entry]]
        found, cosines, least, at, step = np.zeros(0, np.int64), np.zeros(0), -1.0, 0, 4
        while at < len(order) and bound[order[at]] >= least - 1e-9:
            wanted = order[at:at + step]
            wanted = wanted[bound[wanted] >= least - 1e-9]
            mine = (rank >= at) & (rank < at + len(wanted))
            own = entry[mine]
            posting = expand(self.begin[own], self.size[own])
            sums = np.bincount(
                self.doc[posting], weights=np.repeat(weight[mine], self.size[own]) * self.weight[
                    posting], minlength=len(self.ids))
            read = (wanted[:, None] * self.block + np.arange(self.block)).reshape(-1)
            read = read[read < len(self.ids)]
            scores = np.round(sums[read] + whole[read], 9)
            found = np.concatenate([found, read[scores > 0]])
            cosines = np.concatenate([cosines, scores[scores > 0]])
            if len(found) > k:
                least = np.partition(cosines, -k)[-k]
                found, cosines = found[cosines >= least], cosines[cosines >= least]
            elif len(found) == k:
                least = cosines.min()
            at, step = at + len(wanted), step * 4
        best = np.lexsort((self.ids[found], -cosines))[:k]
        return found[best], cosines[best]

    def score(self, terms, weights, k: int = NEIGHBOURS):
        """(score, evidence) of one document's vector."""
        if not len(terms) or not len(self.ids):
            return self.empty_share if not len(terms) else self.share, []
        found, cosines = self.nearest(terms, weights, k)
        cosines = np.minimum(cosines, 1.0)
        closeness = cosines / (1.05 - cosines)
        score = ((closeness * self.labels[found]).sum() + SHRINK * self.share) / (
            closeness.sum() + SHRINK)
        evidence = [{"doc_id": int(self.ids[f]), "toxic": int(self.labels[f]), "cosine": float(c)}
                    for f, c in zip(found[:3], cosines[:3])]
        return float(score), evidence


def term_weights(examples: list[tuple[int, int, np.ndarray]]) -> dict[int, float]:
    """The weight of every term of the examples: its idf, times `PLAIN` and the lower bound
    (`ERRORS` standard errors below) of the log odds ratio by which it marks toxic examples."""
    if not examples:
        return {}
    toxic = np.array([label for _, label, _ in examples], float)
    terms, place = np.unique(np.concatenate([own[:, 0] for _, _, own in examples]),
                             return_inverse=True)
    of = np.repeat(toxic, [len(own) for _, _, own in examples])
    df = np.bincount(place, minlength=len(terms))
    a = np.bincount(place, weights=of, minlength=len(terms))
    c, n_toxic, n_clean = df - a, toxic.sum(), (1 - toxic).sum()
    cells = [a + 0.5, n_toxic - a + 0.5, c + 0.5, n_clean - c + 0.5]
    odds = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    marks = np.maximum(odds - ERRORS * np.sqrt(sum(1 / x for x in cells)), 0.0)
    weight = np.log((len(examples) + 1) / df) * (PLAIN + marks)
    return dict(zip(terms.tolist(), weight.tolist()))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index over at most `examples` labelled training documents."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("toxic").cast("int").alias("toxic")).dropna().where(
        remainder(FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # an id without a document must not use up the bound, so known ids are matched first
    present = id_and_text(docs).select("doc_id").distinct().join(marked, "doc_id")
    sample = hash_sample(present, "doc_id", examples)
    counted = word_counts(id_and_text(docs).join(
        F.broadcast(sample.select(F.col("doc_id").alias("labelled"))),
        F.col("doc_id") == F.col("labelled"), "left_semi"))
    # copies are told by all their words, never by a passage that they share
    rows = counted.join(F.broadcast(sample), "doc_id").groupBy(
        F.col("terms.term").alias("copy"), "toxic").agg(F.min_by(
            F.struct("doc_id", "terms"), "doc_id").alias("one")).select(
        "one.doc_id", "toxic", F.col("one.terms.term").alias("term"),
        F.col("one.terms.n").alias("n")).toArrow()
    found = [(doc, toxic, np.column_stack([term.values.to_numpy(), n.values.to_numpy()]))
             for doc, toxic, term, n in zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(),
                                            rows["term"], rows["n"])]
    return Index(term_weights(found), found)


def toxicity_scores(docs: DataFrame, index: Index, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, text_hash, score, predicted and evidence of every document."""
    get = shared(docs.sparkSession, index)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()),
                                   ("cosine", pa.float64())]))

    def score(batches):
        index, known, held = get(), {}, 0

        def keyed():
            for batch in batches:
                ids = pa.StructArray.from_arrays([batch["doc_id"], batch["text_hash"]],
                                                 ["doc_id", "text_hash"])
                yield pa.RecordBatch.from_arrays([ids, batch["text"]], ["key", "text"])
        for keys, texts in pieces(keyed()):
            words = Words(texts, ALNUM)
            hashes = signed(words.hashes)
            scores = []
            for a, b in zip(words.first[:-1], words.first[1:]):
                vector = index.vector(*np.unique(hashes[a:b], return_counts=True))
                # copies of a text are scored once
                name = b"".join(v.tobytes() for v in vector)
                if name not in known:
                    if held > REMEMBER:
                        known.clear()
                        held = 0
                    known[name] = index.score(*vector, neighbours)
                    held += len(name)
                scores.append(known[name])
            yield pa.RecordBatch.from_arrays([
                pa.array([k["doc_id"] for k in keys], pa.int64()),
                pa.array([k["text_hash"] for k in keys], pa.int64()),
                pa.array([s for s, _ in scores], pa.float64()),
                pa.array([int(s >= 0.5) for s, _ in scores], pa.int32()),
                pa.array([e for _, e in scores], evidence)],
                ["doc_id", "text_hash", "score", "predicted", "evidence"])
        known.clear()
        give_back()

    hashed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return hashed.select("doc_id", "text_hash", "text").mapInArrow(score, SCORES)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return without(docs, toxicity_scores(docs, fit(docs, labels)).where("predicted = 1"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, fit(docs, labels)).drop("text_hash").withColumn(
        "held_out", remainder(FOLDS) == 0)
