"""Vantage-point trees, spelling variants and collocations on awkward rows, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_analytics.llm import collocations, variants, vptree
from tests.llm.conftest import table

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- vantage-point trees ----------------------------------------------------------------

def true_neighbours(data, step, k):
    own = [(i, np.array(v + [0.0] * (6 - len(v)))) for i, v in data if i is not None and v
           and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    expected = []
    for q, x in own:
        if q % step == 0:
            best = sorted((-(x * y).sum(), i) for i, y in own if i != q)[:k]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return expected


@pytest.fixture(scope="module")
def awkward_vectors():
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(0, 1 + i % 3, 6).round(3).tolist()) for i in range(600)]
    data += [(600 + i, [0.5] * 6) for i in range(300)]  # a hot vector: ties
    data += [(40, data[40][1]), (901, None), (902, [None] * 6), (903, [math.nan] * 6), (920, [0.0] * 6),
             (904, [math.inf] + [0.1] * 5), (940, []), (960, [0.5] * 3), (None, [1.0] * 6)]
    return data


@pytest.mark.parametrize("shard", [4096, 64])
def test_trees_are_exact_with_factor_one(spark, awkward_vectors, shard, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vptree, "ASKED", 16)
    monkeypatch.setattr(vptree, "ASKED_BLOCK", 8)
    vectors = spark.createDataFrame(awkward_vectors, "vec_id long, embedding array<double>")
    vectors = vectors.withColumns({c: F.lit("clash") for c in ("row", "v", "region", "least", "shard")})
    found = vptree.nearest(vectors, F.col("vec_id") % 20 == 0, factor=1.0, shard=shard)
    expected = true_neighbours(awkward_vectors, 20, 20)
    found = rows(found, "query_id", "rank", "vec_id", "score")
    assert [r[:3] for r in found] == [r[:3] for r in sorted(expected, key=repr)]
    assert np.allclose([r[3] for r in found], [r[3] for r in sorted(expected, key=repr)], rtol=1e-12)


def test_trees_recall_by_default(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3000, 6))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {(r[0], r[1]) for r in vptree.nearest(vectors, F.col("vec_id") % 20 == 0, shard=256).select(
        "query_id", "vec_id").collect()}
    expected = {(q, i) for q, _, i, _ in true_neighbours(data, 20, 20)}
    assert len(found & expected) >= 0.9 * len(expected)
    assert len(found) == len(expected)


def test_a_larger_factor_looks_at_fewer_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (2000, 4))
    space = vptree.Space(4, float(np.linalg.norm(x, axis=1).max()))
    tree, met = vptree.Tree(space.points(x), 16), []
    for factor in (1.0, 3.0):
        best = vptree.Best(x[:50], np.arange(50), np.full(50, -np.inf), 5, space)
        meet, seen = best.meet, [0]
        best.meet = lambda who, a, b: (seen.__setitem__(0, seen[0] + len(who) * len(a)), meet(who, a, b))
        vptree.search_tree(tree, x[tree.order], tree.order, best, factor)
        met.append(seen[0])
    assert met[1] < met[0] < 50 * 2000


def test_trees_without_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for data in ([], [(20, None)], [(20, [0.0, 0.0])]):
        assert vptree.nearest(spark.createDataFrame(data, schema), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0]), (3, [2.0]), (5, [2.0])], schema)
    assert rows(vptree.nearest(few, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score") == [
        (20, 1, 3, 2.0), (20, 2, 5, 2.0)]


# ---- spelling variants --------------------------------------------------------------------

def true_words(data, min_count=3):
    n = Counter()
    for i, text in data:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= min_count}


def true_variants(n):
    near = {w: [v for v in n if variants.one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


VARIANT_COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def many_words():
    """Near words at every place of the trie: letters of one group and of two, hubs, chains."""
    rng = np.random.default_rng(7)
    n = {"".join(w): int(rng.integers(3, 400)) for w in product("abc", repeat=5)}
    for w in list(n)[::3]:
        n[w + "a"] = n[w] // 3 + 3
        n["é" + w] = 3
    for base in ("x" * 46, "y" * 47, "z" * 60):  # around the width of the matrices
        n |= {base: 90, base + base[0]: 40, base[:-1] + "q": 9, "q" + base: 8}
    chain = "longwordthatchanges"
    for k in range(9):
        n[chain] = 3 * 2 ** (k + 1)
        chain = chain[:k] + "ß" + chain[k + 1:]
    return n


@pytest.mark.parametrize("shard, piece", [(4096, 4096), (40, 16), (1, 4096)])
def test_variants_equal_brute_force(spark, shard, piece, monkeypatch):
    for name, value in (("ASKERS", 32), ("BLOCK", 64), ("PAIRS", 128)):
        monkeypatch.setattr(variants, name, value)
    near_pairs = variants.near_pairs
    monkeypatch.setattr(variants, "near_pairs", lambda words: near_pairs(words, shard, piece))
    n = many_words()
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert rows(variants.variants(words), *VARIANT_COLUMNS) == true_variants(n)


def test_words_are_counted_over_whole_texts(spark, docs, empty):
    copies = [(i, "Straße STRASSE straBen Àpfel àpfel naïve naive naives " * 3) for i in range(40)]
    data = [*copies, (None, "Straße " * 200), (1, None), (2, ""), (3, "x" * 50_000 + " tiny words"),
            (3, "x" * 50_000), (4, "x" * 50_000), (4, "漢字 words9words words_words")]
    words = variants.counted_words(table(spark, data))
    assert dict(rows(words, "word", "n")) == true_words(data)
    assert rows(variants.variants(variants.written(words)), *VARIANT_COLUMNS) == true_variants(true_words(data))
    assert variants.variants(variants.counted_words(empty)).count() == 0
    assert variants.counted_words(docs).count() > 0


# ---- collocations ---------------------------------------------------------------------------

def true_collocations(data, least=10, top=2000, longest=3):
    f, total = defaultdict(Counter), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= 50 * a for q, b in candidates.items() if len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k)
                           for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def languages(spark, data):
    docs = table(spark, [(None, t) for _, t in data]).drop("lang", "doc_id")
    langs = spark.createDataFrame([(lang, t) for lang, t in data], "lang string, text string")
    return langs.withColumns({c: F.lit("x") for c in docs.columns if c not in ("text", "lang")} | {
        c: F.lit("clash") for c in ("key", "words", "lefts", "n", "group", "h1")}).repartition(3)


def prose():
    rng = np.random.default_rng(8)
    names = [f"w{i}" for i in range(40)] + ["É", "éa", "New", "york", "\x85", "a\xa0b", "\x1c"]
    share = 1 / np.arange(1, len(names) + 1)
    data = []
    for k in range(60):
        text = ""
        for w in rng.choice(names, 300, p=share / share.sum()):
            text += w + str(rng.choice([" ", " ", " ", "\t", ", ", "\n", ".", "  "]))
        data.append((["en", "fr", None][k % 3], text))
    data += [("en", "Hot phrase here " * 900)] * 2 + [("en", None), (None, ""), ("junk", "one"), ("de", " \t.,;")]
    return data + [("en", data[0][1])]


@pytest.mark.parametrize("budget", [1 << 20, 500, 40])
def test_collocations_equal_brute_force(spark, budget):
    data = prose()
    found = collocations.collocations(languages(spark, data), budget=budget)
    assert rows(found, *COLUMNS) == true_collocations(data)


def test_collocations_of_other_lengths_and_ties(spark):
    data = prose()
    docs = languages(spark, data)
    for longest in (2, 4):
        found = collocations.collocations(docs, longest=longest, least=15, top=25, budget=200)
        assert rows(found, *COLUMNS) == true_collocations(data, 15, 25, longest)
    assert collocations.collocations(docs.where("false")).count() == 0


def test_a_group_holds_each_leaf_once():
    prefixes = collocations.Prefixes(None, 3)
    trees = collocations.Subtrees(prefixes, 10)
    for _ in range(50):
        trees.add(np.array([[1, 2, 3], [1, 2, 0]], np.uint64), np.array([2, 1]))
    assert sum(len(p[0]) for p in trees.parts) <= 24
    found = [(words.tolist(), counts.tolist()) for words, counts in trees.phrases(10) if len(words)]
    assert found == [([[1, 2]], [150]), ([[1, 2, 3]], [100])]
