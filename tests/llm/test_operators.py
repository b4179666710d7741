"""Every operator on awkward rows, against brute force, and the pipeline's stages."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from capture_analytics.llm import (
    bpe, brown, fmindex, idfiles, jaccard, langid, licenses, phrases, tables, tokens, topk, toxic)
from tests.llm.conftest import CLASH, PASSAGE, ROWS, table


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def in_order(found):
    return sorted(found, key=repr)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(0, 0.3, 6).round(3).tolist(), 0) for i in range(400)]
    data += [(400 + i, [0.5] * 6, 1) for i in range(60)]                 # ties
    data += [(50, data[50][1], 9), (501, None, 0), (502, [None] * 6, 0), (503, [math.nan] * 6, 0),
             (504, [math.inf] + [0.1] * 5, 0), (505, [], 0), (506, [0.5] * 3, 0), (None, [1.0] * 6, 0)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    found = topk.nearest(vectors, F.col("vec_id") % 50 == 0)
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in data
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, x in own:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in own if i != q))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert rows(found, "query_id", "rank", "vec_id", "score") == in_order(expected)
    assert topk.nearest(vectors.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_uses_its_bounds_and_slices(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 4))
    data = [(i, (centres[i % 6] + rng.normal(0, 0.05, 4)).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    x = np.floor(256 * np.array([v for _, v in data]))
    expected = []
    for q in range(0, 900, 50):
        scores = x @ x[q]
        best = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        expected += [(q, k + 1, int(i), int(scores[i])) for k, i in enumerate(best)]
    assert rows(topk.nearest(vectors, F.col("vec_id") % 50 == 0),
                "query_id", "rank", "vec_id", "score") == in_order(expected)


def test_token_files_round_trip(spark, docs, empty):
    with open(public_tokenizers.path(idfiles.TOKENIZER)) as definition:
        text = definition.read()
    folder = tables.new_folder(spark)
    manifest = idfiles.write_ids(docs, folder, text)
    found = rows(idfiles.read_ids(spark, folder, manifest), "doc_id", "start", "n_tokens", "ids_crc32")
    library = Tokenizer.from_str(text)
    encoded = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
               for i, t in ROWS]
    assert sorted((n, c) for _, _, n, c in found) == sorted(
        (len(x), zlib.crc32(x.tobytes())) for _, x in encoded)
    assert [r[0] for r in sorted(found, key=lambda r: r[1])] == sorted(
        (i for i, _ in ROWS), key=lambda i: (i is not None, i))
    starts = sorted((s, n) for _, s, n, _ in found)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]
    for key, ids in encoded:
        if key is not None:
            assert (idfiles.lookup(folder, manifest, key) == ids).all()
    assert idfiles.lookup(folder, manifest, 10 ** 6) is None
    other = tables.new_folder(spark)
    nothing = idfiles.write_ids(empty, other, text)
    assert idfiles.read_ids(spark, other, nothing).count() == 0


def test_licences(spark, docs, empty):
    notices = [(1, "Some words.\nLicensed under the Apache License, Version 2.0.\nmore"),
               (2, "Released under the MIT License."), (3, None), (4, ""),
               (5, "\n\nThis work is licensed under the GNU General Public License, version 3."),
               (6, "Licensed under CC BY-NC 4.0."), (7, "ALL RIGHTS RESERVED."),
               (8, "It was the work of the year and the end of the road."),
               (9, "Use is subject to license terms."), (None, "Released under the MIT License.")]
    both = docs.unionByName(table(spark, notices))
    model = licenses.fit(both)
    found = rows(licenses.license_notices(both, model), "doc_id", "line", "family")
    assert found == in_order([(1, 1, "apache"), (2, 0, "mit"), (5, 2, "gpl"), (6, 0, "cc-by-nc"),
                              (7, 0, "reserved"), (9, 0, "unknown"), (None, 0, "mit")])
    assert licenses.license_notices(empty, licenses.fit(empty)).count() == 0


def test_licence_scan_runs_no_python(spark, docs):
    plan = licenses.license_notices(docs, licenses.fit(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_language_model(spark, docs, empty):
    found = {(r["doc_id"], r["n_tokens"], r["base_score"]): r for r in brown.scores(docs).collect()}
    assert len(list(found)) >= len({(i, t) for i, t in ROWS}) - 4
    words = [(i, (t or "").encode().translate(bytes.maketrans(
        bytes(range(65, 91)), bytes(range(97, 123)))).split()) for i, t in ROWS]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, own in words:
        if not held(i):
            counts.update([*own, "end"])
    total, distinct = sum(counts.values()), len(counts)
    got = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 5)) for r in brown.scores(docs).collect())
    expected = sorted((i or 0, held(i), len(own) + 1, sum(counts[w] > 0 for w in [*own, "end"]), total,
                       round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1)))
                                 for w in [*own, "end"]), 5)) for i, own in words)
    assert got == expected
    assert brown.scores(empty).count() == 0
    one = brown.scores(table(spark, [(4, None)])).first()
    assert one["n_tokens"] == 1 and math.isfinite(one["score"])


def test_language_model_beats_words_alone(spark, sf):
    scored = brown.scores(tables.documents(spark, sf.replace("0.001", "0.01")))
    base, model = scored.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert model > 0.97 * base


def test_class_model_is_a_distribution():
    units = brown.Units(np.array([], np.uint64))
    table_ = np.array([[5.0, 1.0], [2.0, 0.0]])
    model = brown.Model(units, np.zeros(units.size, int), table_, np.array([6.0, 2.0]), np.array([2, 1]))
    assert np.allclose((10 ** model.transition).sum(1), 1)


def test_jaccard_equals_brute_force(known, empty):
    expected = jaccard.brute_force([r for r in ROWS if r[0] is not None])
    found = jaccard.jaccard_components(known)
    assert rows(found, "doc_id", "n_shingles", "component_id") == in_order(expected)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_nulls(docs):
    found = {r["n_shingles"]: r["component_id"] for r in jaccard.jaccard_components(docs).where(
        "doc_id is null").collect()}
    assert found == {0: None, 1: None}


def test_jaccard_of_large_groups_in_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "BLOCK_VISITORS", 7)
    rng = np.random.default_rng(3)
    data = []
    for group in range(3):
        original = [f"g{group}w{i}" for i in range(60)]
        data.append((group * 1000, " ".join(original)))
        for k in range(1, 60):
            copy = list(original)
            for at in rng.integers(0, 60, k % 4):
                copy[at] = f"edit{rng.integers(5)}"
            data.append((group * 1000 + k, " ".join(copy)))
    # a chain: each links to the next only
    line = [f"c{i}" for i in range(130)]
    data += [(5000 + k, " ".join(line[k * 2:k * 2 + 60])) for k in range(30)]
    found = jaccard.jaccard_components(table(spark, data, 4))
    assert rows(found, "doc_id", "n_shingles", "component_id") == in_order(jaccard.brute_force(data))


def test_substring_dedup_equals_brute_force(docs, empty):
    found = phrases.digests(docs)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(
        phrases.brute_force(ROWS))
    assert phrases.digests(empty).count() == 0


def test_substring_dedup_of_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_CHARS", 2000)
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 3000)
    rng = np.random.default_rng(4)
    passages = [[f"p{k}x{i}" for i in range(rng.integers(40, 130))] for k in range(8)]
    data = []
    for doc in range(150):
        words = [f"d{doc}y{i}" for i in range(rng.integers(0, 30))]
        for k in rng.integers(0, 8, rng.integers(0, 4)):
            own = passages[k]
            begin = rng.integers(0, max(1, len(own) - 60))
            words += own[begin:begin + rng.integers(30, 130)]
            words += [f"e{rng.integers(50)}" for _ in range(rng.integers(0, 5))]
        data.append((int(doc), " ".join(words)))
    data += [(1000 + i, data[5][1]) for i in range(30)]
    found = phrases.digests(table(spark, data, 5))
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(
        phrases.brute_force(data))


def test_toxicity(spark, sf, docs, empty):
    folder = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    index = toxic.fit(tables.documents(spark, folder), labels)
    scored = toxic.toxicity_scores(tables.documents(spark, folder), index).join(labels, "doc_id")
    clean = scored.where("toxic = 0").agg(F.avg("predicted"), F.max("score")).first()
    marked = scored.where("toxic = 1").agg(F.avg("score")).first()
    assert clean[0] < 0.01 and clean[1] <= 1 and marked[0] > 0.5
    odd = toxic.toxicity_scores(docs, index)
    assert odd.count() == len(ROWS) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxic.toxicity_scores(empty, index).count() == 0


def nearest_votes(docs, labels):
    """doc_id, score and the nearest example by cosines of all words with all examples, in Python."""
    def words(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    marks, examples = {}, {}
    for i, toxic_ in labels:
        if zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(toxic_, marks.get(i, 0))
    for i, text in sorted(docs):
        if i in marks:
            examples.setdefault((frozenset(words(text)), marks[i]), (i, words(text)))
    examples = [(i, label, own) for (_, label), (i, own) in examples.items()]
    n, n_toxic = len(examples), sum(label for _, label, _ in examples)
    df, a = Counter(), Counter()
    for _, label, own in examples:
        df.update(own.keys())
        a.update({w: label for w in own})

    def weight(w):
        cells = [a[w] + 0.5, n_toxic - a[w] + 0.5, df[w] - a[w] + 0.5, n - n_toxic - df[w] + a[w] + 0.5]
        odds = math.log(cells[0] / cells[1] / (cells[2] / cells[3]))
        return math.log((n + 1) / df[w]) * (toxic.PLAIN + max(
            0, odds - toxic.ERRORS * math.sqrt(sum(1 / x for x in cells))))
    weights = {w: weight(w) for w in df}

    def unit(own):
        own = {w: (1 + math.log(m)) * weights[w] for w, m in own.items() if w in weights}
        size = math.sqrt(sum(v * v for v in own.values()))
        return {w: v / size for w, v in own.items()}
    vectors, share = [(i, label, unit(own)) for i, label, own in examples], n_toxic / n
    bare = [label for _, label, own in vectors if not own]
    for i, text in docs:
        own = unit(words(text))
        near = sorted((-round(sum(v * other.get(w, 0) for w, v in own.items()), 9), j, label)
                      for j, label, other in vectors)
        near = [(min(-c, 1), j, label) for c, j, label in near if c < 0][:toxic.NEIGHBOURS]
        votes = [(c / (1.05 - c), label) for c, _, label in near]
        score = (sum(v * label for v, label in votes) + toxic.SHRINK * share) / (
            sum(v for v, _ in votes) + toxic.SHRINK) if own else (sum(bare) + share) / (len(bare) + 1)
        yield i, score, near[0][1] if near else None


def test_toxicity_is_by_the_nearest_of_all_examples(spark, sf):
    docs_, labels = tables.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r["doc_id"]: r for r in toxic.toxicity_scores(docs_, toxic.fit(docs_, labels)).collect()}
    expected = list(nearest_votes([tuple(r) for r in docs_.select("doc_id", "text").collect()],
                                  [tuple(r) for r in labels.select("doc_id", "toxic").collect()]))
    assert len(found) == len(expected) == docs_.count()
    for i, score, near in expected:
        row = found[i]
        assert math.isclose(row["score"], score, abs_tol=1e-6)
        assert [e["doc_id"] for e in row["evidence"][:1]] == ([] if near is None else [near])
    # few labels do not switch it off
    assert len({round(r["score"], 6) for r in found.values()}) > 100


def test_toxicity_of_held_out_documents(spark, sf):
    folder = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxic.op7_toxicity(spark, folder).where("held_out").join(labels, "doc_id")
    rates = {r["toxic"]: r["share"] for r in scored.groupBy("toxic").agg(
        F.avg("predicted").alias("share")).collect()}
    assert rates[1] >= 0.9 and rates[0] <= 0.02


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = toxic.toxicity_scores(docs, toxic.fit(docs, none))
    assert {r[0] for r in scored.select("score").collect()} == {0.0}
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 0, 1), (2, 0, None)],
                                "doc_id long, quality int, toxic int")
    assert toxic.toxicity_scores(docs, toxic.fit(docs, odd)).count() == len(ROWS)


BENCHMARK = [("1", "A b c d e f g h i j k l m n"), ("2", "the old"), ("3", None), ("4", ""), ("2", "mill")]


@pytest.mark.parametrize("block_chars", [fmindex.BLOCK_CHARS, 10])
def test_decontamination_equals_brute_force(spark, docs, empty, block_chars):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    found = fmindex.verdicts(fmindex.contaminated_spans(docs, benchmark, block_chars=block_chars))
    expected = fmindex.brute_force([t for _, t in ROWS], BENCHMARK)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == \
        in_order((i, *r) for (i, _), r in zip(ROWS, expected))
    assert fmindex.contaminated_spans(empty, benchmark).count() == 0
    nothing = fmindex.verdicts(fmindex.contaminated_spans(docs, benchmark.where("false")))
    assert nothing.where("n_hit > 0 or contaminated").count() == 0


def test_bpe_round_trip(spark, docs, empty):
    path = public_tokenizers.path(bpe.RANKS)
    encode = bpe.encoding(bpe.read_ranks(path), public_tokenizers.PATTERN).encode_ordinary
    found = bpe.round_trip(docs, path, with_ids=True)
    expected = []
    for i, text in ROWS:
        ids = np.array(encode(text or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest(), ids.tolist()))
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == in_order(expected)
    decoded = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(bytes(r["bytes"]).decode() for r in decoded.collect()) == sorted(
        t or "" for _, t in ROWS)
    assert bpe.round_trip(empty, path).count() == 0


def test_language_id(spark, sf, docs, empty):
    whole = tables.documents(spark, sf.replace("0.001", "0.01"))
    dictionaries = langid.fit(whole)
    found = langid.languages(whole, dictionaries).join(whole.select("doc_id", "lang"), "doc_id")
    held = found.where(tables.remainder(3) == 1)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = langid.languages(docs, dictionaries)
    assert odd.count() == len(ROWS)
    assert odd.where("doc_id in (4, 5, 6) and (lang_pred <> 'und' or score <> 0)").count() == 0
    assert odd.where("doc_id = 1 and lang_pred = 'und'").count() == 0
    assert langid.languages(empty, dictionaries).count() == 0
    assert {r[0] for r in langid.languages(docs, langid.fit(empty)).select("lang_pred").collect()} == {
        "und"}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in tables.components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    own = {i: {i} for p in pairs for i in p}
    for a, b in pairs:
        joined = own[a] | own[b]
        for i in joined:
            own[i] = joined
    assert found == {i: min(s) for i, s in own.items() if len(s) > 1}


def test_pipeline_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(BENCHMARK[:1], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    now, left = spark.read.parquet(f"{folder}/documents.parquet"), list(ROWS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        assert now.columns == docs.columns
        assert now.where(" or ".join(f"{c} <> 'clash'" for c in CLASH)).count() == 0
        if name == "ngram_jaccard_join":
            known = jaccard.brute_force([r for r in left if r[0] is not None])
            gone = {i for i, _, root in known if i != root}
            left = [r for r in left if r[0] not in gone]
        elif name == "substring_dedup":
            lost = phrases.brute_force(left)
            for i, (doc, text) in enumerate(left):
                if lost[i][2]:
                    assert doc in (14, 15, 16)
                    kept = " ".join(w for w in text.split() if w not in PASSAGE.split())
                    left[i] = (doc, kept)
        elif name == "benchmark_decontamination":
            left = [r for r, v in zip(left, fmindex.brute_force([t for _, t in left], BENCHMARK[:1]))
                    if not v[4]]
        assert rows(now, "doc_id", "text") == in_order(left)
        assert now.where("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert rows(out, "doc_id", "decoded_sha256") == in_order(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left)


def test_every_training_word_is_a_unit(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEADS", 4)
    monkeypatch.setattr(brown, "LOOKUP", 12)
    rng = np.random.default_rng(9)
    # words of two kinds take turns, so the classes can be told from the neighbours only
    data = [(i, " ".join(f"{'ab'[k % 2]}{rng.integers(40)}xyz" for k in range(30))) for i in range(80)]
    docs_ = table(spark, data)
    units = brown.Units(np.array([], np.uint64))
    classes, bigrams, others = brown.cluster(docs_.select("doc_id", "text"), units, 3)
    seen = {w for _, t in data for w in t.split()}
    assert others.count() == len(seen) and classes.tolist() == [2]
    assert bigrams.sum() == 80 * 31
    own = {r["word"]: r["class"] for r in others.collect()}
    kinds = [{own[int(tokens.Words([w]).hashes.view(np.int64)[0])] for w in seen if w[0] == k}
             for k in "ab"]
    assert kinds in ([{0}, {1}], [{1}, {0}])
    # scores do not depend on which words are broadcast
    some = rows(brown.scores(docs_, 3, 0), "doc_id", "n_known", "base_score")
    monkeypatch.setattr(brown, "LOOKUP", 1 << 18)
    every = rows(brown.scores(docs_, 3, 0), "doc_id", "n_known", "base_score")
    assert [r[:2] for r in some] == [r[:2] for r in every]
    assert np.allclose([r[2] for r in some], [r[2] for r in every])


def test_class_counts_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEADS", 3)
    rng = np.random.default_rng(1)
    # one word stands very often, also beside itself
    data = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.5, 30), 60))) for i in range(40)]
    data += [(40, "w1 " * 500), (41, None), (42, "")]
    texts = [["end", *(t or "").split(), "end"] for _, t in data]
    counts = Counter(w for t in texts for w in t[1:-1])
    hashed = {int(tokens.Words([w]).hashes.view(np.int64)[0]): w for w in counts}
    top = [w for w, _ in counts.most_common(8)]
    by_word = {w: h for h, w in hashed.items()}
    units = brown.Units(np.array([by_word[w] for w in top]).view(np.uint64), 3)
    docs_, n = table(spark, data).select("doc_id", "text"), 4
    get = tables.shared(spark, units)
    rows_ = tables.written(brown.word_rows(docs_, get, n))
    placed = tables.written(brown.met(rows_, n))
    numbered = np.append(np.arange(8) % 3, 3)
    own = dict(zip([*top, "end"], numbered.tolist()))
    for r in rows_.collect():
        assert r["n"] == counts[hashed[r["word"]]]
        own[hashed[r["word"]]] = r["class"]
    assert len(own) == len(counts) + 1
    counted = tables.written(brown.contexts(tables.written(brown.links(docs_, get)), rows_, units, numbered, n))
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    after, before, same, found = brown.sums(counted, placed, units, numbered, n)
    expected = np.zeros((n, n))
    heads = [*top[:3], "end"]
    beside = np.zeros((2, 4, n))
    for (a, b), times in pairs.items():
        expected[own[a], own[b]] += times
        for side, word, near in ((0, a, b), (1, b, a)):
            if word in heads:
                beside[side, heads.index(word), own[near]] += times
    assert (found == expected).all() and (after == beside[0]).all() and (before == beside[1]).all()
    assert same.tolist() == [pairs[w, w] for w in heads]
    # words that are no heads go where the gain, with all others in place, is largest
    moved = brown.moved_units(counted, units, numbered, found)
    again = {r["word"]: r["class"] for r in brown.moved_rows(rows_, placed, numbered, found).collect()}
    gain = lambda x: x * math.log(max(x, 1))
    for word in [w for w in counts if w not in heads]:
        near = Counter()
        for (a, b), times in pairs.items():
            if a == word:
                near[0, own[b]] += times
            if b == word:
                near[1, own[a]] += times
        values = []
        for c in range(n - 1):
            sign, value = (-1 if c == own[word] else 1), 0.0
            for (side, k), m in near.items():
                there = expected[c, k] if side == 0 else expected[k, c]
                value += sign * (gain(max(there + sign * m, 0)) - gain(there))
            for whole in (expected[c].sum(), expected[:, c].sum()):
                value -= sign * (gain(max(whole + sign * counts[word], 0)) - gain(whole))
            values.append(value)
        got = int(moved[top.index(word)]) if word in top else again[by_word[word]]
        assert values[got] >= max(values) - 1e-6


def test_rare_words_travel_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEADS", 4)
    monkeypatch.setattr(brown, "LOOKUP", 12)
    rng = np.random.default_rng(3)
    data = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.2, 40), 200))) for i in range(60)]
    data += [(60, None), (61, ""), (62, "new1 new2 new3"), (None, "w1 w150 w151"), (None, "w1 w150 w151")]
    docs_, columns = table(spark, data), ("doc_id", "n_known", "base_score", "score")
    seen, write = [], brown.written

    def watched(df):
        out = write(df)
        if {"class", "classes"} & set(df.columns) and "doc_id" not in df.columns:
            seen.append(out.count())
        return out
    monkeypatch.setattr(brown, "written", watched)
    once = rows(brown.scores(docs_, 5, 2), *columns)
    # one row for all the words that are not frequent, not one for each
    assert seen and set(seen) == {1}
    # the scores do not depend on the blocks, on how often counts are merged or on who is put together
    for name, value in (("BLOCK_TOKENS", 100), ("COMBINE", 50), ("TOGETHER", 7), ("SLICE", 3)):
        monkeypatch.setattr(brown, name, value)
    seen.clear()
    again = rows(brown.scores(docs_, 5, 2), *columns)
    assert min(seen) > 5
    assert [r[:2] for r in once] == [r[:2] for r in again]
    assert np.allclose([r[2:] for r in once], [r[2:] for r in again])


def test_units_are_found_by_hash():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    # many words with the same first bits
    words = np.unique(np.append(words, words[7] + np.arange(1, 50, dtype=np.uint64)))
    rng.shuffle(words)
    units = brown.Units(words[:3000], 10)
    asked = np.concatenate([words, units.words, words + np.uint64(1), [np.uint64(0), ~np.uint64(0)]])
    number = {int(w): i for i, w in enumerate(units.words)}
    assert units.of(asked).tolist() == [number.get(int(w), -1) for w in asked]
    assert brown.Units(np.array([], np.uint64)).of(np.array([brown.END, 5], np.uint64)).tolist() == [0, -1]
    assert units.of(np.array([], np.uint64)).tolist() == []


def test_large_bigram_counts_are_split():
    times = np.array([3, (1 << 31) - 1, 1 << 31, 5 << 31], np.int64)
    batch = brown.packed(np.array([0, 0, 1, 1]), np.array([0, 0, 16, 17]), np.array([4, 5, 6, 7]), times)
    cells, row = brown.opened(batch["cells"], np.int32)
    found = brown.opened(batch["times"], np.int32)[0]
    assert batch["part"].to_pylist() == [0, 16, 17] and batch["block"].to_pylist() == [0, 1, 1]
    keys, sums = brown.merged([(cells.astype(np.int64), found.astype(np.int64))])
    assert keys.tolist() == [4, 5, 6, 7] and sums.tolist() == times.tolist()


def link_numbers(data):
    sets = []
    for _, text in data:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        sets.append(runs or ({tuple(words)} if words else set()))
    return [(data[i][0], sum(i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b)
                             for j, b in enumerate(sets))) for i, a in enumerate(sets)]


def test_jaccard_counts_every_link(spark, docs, monkeypatch):
    assert rows(jaccard.jaccard_components(docs, counted=True), "doc_id", "n_links") == in_order(
        link_numbers(ROWS))
    monkeypatch.setattr(jaccard, "SLICE_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "BLOCK_VISITORS", 7)
    rng = np.random.default_rng(5)
    data = []
    for group in range(2):
        for k in range(40):
            copy = [f"g{group}w{i}" for i in range(60)]
            for at in rng.integers(0, 60, k % 4):
                copy[at] = f"edit{rng.integers(5)}"
            data.append((group * 1000 + k, " ".join(copy)))
    data += [(2000 + i, data[7][1]) for i in range(3)]
    found = jaccard.jaccard_components(table(spark, data, 4), counted=True)
    assert rows(found, "doc_id", "n_links") == in_order(link_numbers(data))


def test_examples_that_share_a_passage_stay(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:62]
    data = [(i, f"{PASSAGE} " + ("grok blarg vile" if k % 2 else f"calm{k} kind{k}"))
            for k, i in enumerate(ids[:60])]
    # equal word sets count once for each label
    data += [(ids[60], data[1][1]), (ids[61], data[0][1])]
    labels = spark.createDataFrame(
        [(i, 1, int("vile" in t)) for i, t in data[:61]] + [(ids[61], 1, 1)],
        "doc_id long, quality int, toxic int")
    index = toxic.fit(table(spark, data), labels)
    # one of the toxic copies, 30 clean examples, and the toxic one with a clean one's words
    assert math.isclose(index.share, 2 / 32)


def test_repeated_benchmark_rows_fill_no_block(spark, docs, monkeypatch):
    blocks, search = [], fmindex.block_spans
    monkeypatch.setattr(fmindex, "block_spans", lambda d, items, w: (
        blocks.append(items), search(d, items, w))[1])
    benchmark = spark.createDataFrame([*BENCHMARK, *[BENCHMARK[0]] * 50], "item_id string, text string")
    fmindex.contaminated_spans(docs, benchmark, block_chars=10)
    assert sorted(map(repr, sum(blocks, []))) == sorted(map(repr, BENCHMARK))
