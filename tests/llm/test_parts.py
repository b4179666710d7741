"""The parts that run inside tasks, against plain Python and the libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from capture_analytics.llm import bpe, fmindex, idfiles, jaccard, phrases, tokens, topk, toxic
from capture_analytics.llm.pretokens import pretokens

U = np.uint64


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.RANKS))


def random_text(rng, most=30):
    odd = [chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)]))
           for _ in range(3)]
    pool = [*"  \n\t''abstrelvmd10!?é", "\x1c", "\x85", "\xa0", "￿", *odd]
    return "".join(rng.choice(pool) for _ in range(rng.randrange(most)))


def test_pretokens_encode_like_whole_texts(ranks):
    rng = random.Random(1)
    encode = bpe.encoding(ranks, public_tokenizers.PATTERN).encode_ordinary
    library = Tokenizer.from_file(public_tokenizers.path(idfiles.TOKENIZER))
    library.encode_special_tokens = True
    for _ in range(1500):
        texts = [random_text(rng), None, "", random_text(rng)]
        words, first = pretokens(texts)
        for text, a, b in zip(texts, first[:-1], first[1:]):
            text = text or ""
            assert "".join(words[a:b]) == text
            assert [i for w in words[a:b] for i in encode(w)] == encode(text)
            assert [i for w in words[a:b] for i in library.encode(
                w, add_special_tokens=False).ids] == library.encode(
                text, add_special_tokens=False).ids


def test_pretokens_split_like_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("  \n\t''abstrelvmd10!?é漢￿") for _ in range(rng.randrange(20)))
        assert pretokens([text])[0] == pattern.findall(text)


def test_words_are_those_of_the_patterns():
    rng = random.Random(3)
    spaced, alnum = regex.compile(r"[^\x20\x09-\x0D]+"), regex.compile(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for _ in range(500):
        texts = ["".join(rng.choice("aB z\t\r\x0b-9é\x1f\x7f~") for _ in range(rng.randrange(15)))
                 for _ in range(3)] + [None, ""]
        for inside, pattern in ((tokens.SPACED, spaced), (tokens.ALNUM, alnum)):
            words = tokens.Words(texts, inside, tokens.LOWER)
            found = [words.buffer[a:b].decode() for a, b in zip(words.starts, words.ends)]
            lower = "".maketrans({c: c + 32 for c in range(65, 91)})
            expected = [pattern.findall(
                (t or "") if inside is tokens.SPACED else (t or "").translate(lower)) for t in texts]
            assert words.counts.tolist() == list(map(len, expected))
            assert [w.lower() for w in found] == [w.lower() for e in expected for w in e]
            # equal words have equal hashes wherever they stand, others differ
            by_word = {}
            for word, value in zip(found, words.hashes.tolist()):
                assert by_word.setdefault(word.translate(lower), value) == value
            assert len(set(by_word.values())) == len(by_word)


def test_rolling_hashes_tell_windows_apart():
    values = np.random.default_rng(0).integers(0, 3, 400).astype(U)
    for n in (1, 2, 5, 50):
        for hashes in (tokens.rolling(tokens.mix(values), n), tokens.shingles(tokens.mix(values), n)):
            windows = [tuple(values[i:i + n]) for i in range(len(values) - n + 1)]
            assert len(set(zip(windows, hashes.tolist()))) == len(set(windows)) == len(
                set(hashes.tolist()))


def test_fm_index_finds_every_occurrence():
    rng = random.Random(4)
    for _ in range(150):
        words = ["a", "b", "c", "D", "é", "x1"][:rng.randint(2, 6)]
        line = lambda n: rng.choice([" ", "-"]).join(rng.choice(words) for _ in range(n))
        items = [(str(i), line(rng.randint(0, 8))) for i in range(rng.randint(0, 6))] + [("n", None)]
        texts = [line(rng.randint(0, 40)) + rng.choice(["", " zz q "]) + line(rng.randint(0, 9))
                 for _ in range(rng.randint(1, 8))] + [None, ""]
        window = rng.choice([1, 2, 3, 5])
        counts, spans, found = fmindex.shard_spans(fmindex.Phrases(items, window), texts)
        got = [(int(n), sum(s["end"] - s["begin"] for s in own), len(names))
               for n, own, names in zip(counts, spans, found)]
        assert got == [r[:3] for r in fmindex.brute_force(texts, items, window)]


def test_suffix_order_sorts_suffixes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        symbols = np.concatenate([[0], rng.integers(0, 3, rng.integers(1, 60)), [0]])
        marks = np.cumsum(symbols == 0)
        # an end mark is smaller than any word and smaller than later marks
        line = [(0, int(m)) if s == 0 else (int(s), 0) for s, m in zip(symbols, marks)]
        expected = sorted(range(len(line)), key=lambda i: line[i:])
        assert fmindex.suffix_order(symbols.copy()).tolist() == expected


def test_perfect_hash_is_minimal_and_tells_strangers():
    for n in (0, 1, 2, 1000):
        ids = random.Random(n).sample(range(-10 ** 9, 10 ** 9), n)
        shard = idfiles.Shard.load(idfiles.Shard.build(2, sorted(ids), [3] * n).dump())
        assert sorted(shard.perfect.slots(shard.keys.view(U)).tolist()) == list(range(n))
        assert shard.find(shard.keys).tolist() == list(range(n))
        strangers = np.array([i + 2 * 10 ** 9 for i in ids], np.int64)
        assert (shard.find(strangers) >= 0).sum() <= 1


def test_prefix_tree_links_every_part():
    rng = random.Random(6)
    for _ in range(300):
        universe = list(range(1, rng.randint(5, 40)))
        base = [set(rng.sample(universe, rng.randint(1, len(universe)))) for _ in range(3)]
        sets = {}
        for i in range(rng.randint(1, 25)):
            own = set(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                own ^= {rng.choice(universe)}
            if own and own not in sets.values():
                sets[i] = own
        unique = {i: rng.choice([0, 0, 1]) for i in sets}
        rows = [(i, len(s) + unique[i], np.array(sorted(s), U), i) for i, s in sets.items()]
        cut = rng.randint(0, len(rows))
        found = jaccard.tree_links(rows[:cut], rows[cut:], 80)

        def linked(a, b):
            both = len(sets[a] & sets[b])
            return 100 * both >= 80 * (len(sets[a]) + len(sets[b]) + unique[a] + unique[b] - both)
        assert all(linked(a, b) for a, b in found)
        members = {r[0] for r in rows[:cut]}
        expected = [(a, b) for a in sets for b in sets if a < b and linked(a, b)
                    and (a in members or b in members)]
        assert parts(sets, found) == parts(sets, expected)


def parts(nodes, pairs):
    own = {i: {i} for i in nodes}
    for a, b in pairs:
        joined = own[a] | own[b]
        for i in joined:
            own[i] = joined
    return {i: min(s) for i, s in own.items()}


def test_automaton_finds_windows_of_smaller_documents():
    passage = [f"p{i}" for i in range(120)]
    machine = phrases.Automaton([5], [" ".join(passage)])
    for begin, end in ((0, 120), (0, 49), (3, 53), (30, 95), (70, 120)):
        text = " ".join(["a", "b", *passage[begin:end], "c"])
        spans = machine.spans(9, text)
        assert spans == ([{"begin": 2, "end": 2 + end - begin}] if end - begin >= 50 else [])
        assert machine.spans(5, text) == [] and machine.spans(4, text) == []


def test_block_max_search_is_exact():
    rng = random.Random(7)
    terms = {t: 1 + rng.random() for t in range(30)}
    examples = [(d, rng.randint(0, 1), [(t, rng.randint(1, 3)) for t in rng.sample(
        range(30), rng.randint(0, 4))]) for d in range(300)]
    index = toxic.Index(terms, examples, block=16)
    vectors = {d: dict(zip(*index.vector([t for t, _ in own], [n for _, n in own])))
               for d, _, own in examples}
    for _ in range(100):
        own = index.vector(rng.sample(range(30), 3), [1, 2, 1])
        found, cosines = index.nearest(*own, 7)
        query = dict(zip(*own))
        ranked = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 9), d)
                        for d, v in vectors.items())
        expected = [(d, -c) for c, d in ranked if c < 0][:7]
        assert index.ids[found].tolist() == [d for d, _ in expected]
        assert np.allclose(cosines, [c for _, c in expected])


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(8)
    x, q = rng.normal(0, 50, (500, 8)).round(), rng.normal(0, 50, (40, 8)).round()
    pivot = rng.normal(0, 20, 8)
    d = np.linalg.norm(x - pivot, axis=1)
    room = topk.bounds((q ** 2).sum(1), np.linalg.norm(q - pivot, axis=1), q @ pivot,
                       d.min(), d.max(), (x ** 2).sum(1).max())
    assert (q @ x.T <= room[:, None]).all()
