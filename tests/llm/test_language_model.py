import math
import zlib
from collections import Counter

import numpy as np
import pytest

from edgeloom.llm import language_model, wordblocks
from edgeloom.llm.base import mix, unpack
from edgeloom.llm.language_model import Model, score

from .conftest import frame


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens]


def order(x):
    return (x[0] is None, x[0] or 0, x[2], x[5])


def test_base(docs, rows):
    got = sorted([tuple(r) for r in score(docs, rounds=1).collect()], key=order)
    want = sorted(brute(rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(np.isfinite(g[6]) and g[6] <= 1e-9 for g in got)


def test_empty_table(empty):
    assert score(empty).collect() == []


def test_no_training_texts(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = score(frame(spark, [(i, "a b")])).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (True, 3, 0, 0, 0.0)
    assert np.isfinite(got.score)


def test_states_tell_two_languages_apart(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 60, 200))) for i in range(150)]
    got = score(frame(spark, rows), states=4, rounds=6).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 5
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_chances_add_up():
    """All words, the end and the unknown word: the emissions of every state sum to one."""
    rng = np.random.default_rng(1)
    counts = np.array([50, 40, 3, 2, 1, 7, 0])
    seen, ends = counts > 0, 9
    tokens, distinct = int(counts.sum()) + ends, int(seen.sum()) + 1
    share = lambda x: rng.dirichlet(np.ones(3), len(np.atleast_1d(x))) * np.atleast_1d(x)[:, None]
    expected, end = share(counts), share(ends)[0]
    m = Model(tokens, distinct, ends, np.ones(3) / 3, np.eye(3), expected.sum(0) + end, end)
    emit = m.emissions(counts, expected, np.arange(7, dtype=np.uint64))
    assert np.allclose(emit.sum(0), 1)


def test_forward_is_exact(spark):
    """One state's likelihood is a product, whatever the length: no scaling is lost."""
    rows = [(i, " ".join(["x", "y"][k % 2] for k in range(3000))) for i in range(12)]
    got = score(frame(spark, rows), states=1, rounds=1).collect()
    one = {round(r.score / r.n_tokens, 9) for r in got}
    assert len(one) == 1
    assert -0.32 < one.pop() < -0.29


def whole(tokens, emit, start, moves):
    """Expectations and log likelihood of one sequence, place by place, in plain arithmetic with a scale for each place."""
    n, k = len(tokens), len(start)
    a, c = np.zeros((n, k)), np.zeros(n)
    for t, w in enumerate(tokens):
        x = (start if t == 0 else a[t - 1] @ moves) * emit[w]
        c[t] = x.sum()
        a[t] = x / c[t]
    by_word, xi, b = np.zeros_like(emit), np.zeros((k, k)), np.ones(k)
    for t in range(n - 1, -1, -1):
        by_word[tokens[t]] += a[t] * b
        first = a[t] * b
        if t:
            for i in range(k):
                for j in range(k):
                    xi[i, j] += a[t - 1, i] * moves[i, j] * emit[tokens[t], j] * b[j] / c[t]
            b = moves @ (emit[tokens[t]] * b) / c[t]
    return by_word, first, xi, np.log(c).sum()


@pytest.mark.parametrize("at_once", [40, 1 << 19])
def test_expectations_of_whole_sequences(monkeypatch, at_once):
    """Three states, sequences of one to twenty stretches: counts and scores are those of the uncut sequence."""
    monkeypatch.setattr(language_model, "STRETCH", 7)
    monkeypatch.setattr(language_model, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    lengths = np.array([1, 6, 7, 8, 140, 33, 7, 50])
    tokens = rng.integers(0, 9, lengths.sum())
    emit, start, moves = rng.dirichlet(np.ones(9), 3).T, rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    model = Model(1, 1, 1, start, moves)
    want = [whole(x, emit, start, moves) for x in np.split(tokens, np.cumsum(lengths)[:-1])]
    got = language_model.Sequences(tokens, lengths, emit, model, np.float64)
    for g, w in zip(got.expect(), [sum(x) for x in zip(*want, strict=True)], strict=True):
        assert np.allclose(g, w, rtol=1e-9)
    assert np.allclose(got.scores(len(lengths)), [w[3] / np.log(10) for w in want], rtol=1e-12)
    narrow = language_model.Sequences(tokens, lengths, emit, model).expect()
    assert all(np.allclose(g, w, rtol=1e-3, atol=1e-4) for g, w in zip(narrow, got.expect(), strict=True))


@pytest.mark.parametrize("many", [1, 3, 64])
def test_carried_by_vectors_or_matrices(monkeypatch, many):
    """Texts of more than so many stretches are carried over by matrices, the others by vectors: counts and scores are the same."""
    monkeypatch.setattr(language_model, "STRETCH", 7)
    monkeypatch.setattr(language_model, "MANY", many)
    rng = np.random.default_rng(6)
    lengths = np.array([1, 15, 140, 21, 22, 7, 50, 14])
    tokens = rng.integers(0, 9, lengths.sum())
    emit, start, moves = rng.dirichlet(np.ones(9), 4).T, rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4)
    want = [whole(x, emit, start, moves) for x in np.split(tokens, np.cumsum(lengths)[:-1])]
    got = language_model.Sequences(tokens, lengths, emit, Model(1, 1, 1, start, moves), np.float64)
    assert np.allclose(got.scores(len(lengths)), [w[3] / np.log(10) for w in want], rtol=1e-12)
    for g, w in zip(got.expect(), [sum(x) for x in zip(*want, strict=True)], strict=True):
        assert np.allclose(g, w, rtol=1e-9)


class Counted(np.ndarray):
    """Transitions that count the multiplications of their products."""

    done = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **kw):
        out = getattr(ufunc, method)(*[x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs], **kw)
        if ufunc is np.matmul:
            Counted.done += out.size * inputs[0].shape[-1]
        return out


def test_work_of_texts_of_some_stretches(monkeypatch):
    """Eight states, four stretches a text: vectors go over a token four times at most, matrices would take eight times one's work."""
    monkeypatch.setattr(Counted, "done", 0)
    rng = np.random.default_rng(7)
    lengths = np.full(6, 4 * language_model.STRETCH)
    emit, moves = rng.dirichlet(np.ones(50), 8).T, rng.dirichlet(np.ones(8), 8).view(Counted)
    language_model.Sequences(rng.integers(0, 50, lengths.sum()), lengths, emit, Model(1, 1, 1, np.ones(8) / 8, moves)).expect()
    assert 0 < Counted.done <= 4 * 64 * lengths.sum()


def brute_hmm(rows, k, rounds, salts):
    """Baum-Welch and forward scores over lists of words, every word with emissions of its own."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    own = [t for (i, _), t in zip(rows, texts, strict=True) if not held(i)]
    c = Counter(w for t in own for w in t)
    n, v, words = sum(c.values()), len(c), list({w: 0 for t in texts for w in t})
    number = {w: i for i, w in enumerate(words)}
    base = np.array([(c[w] + 1) / (n + v + 1) for w in words])[:, None]
    noise = mix(np.array([0 if w is None else salts[w] for w in words], np.uint64)[:, None] * np.uint64(64) + np.arange(k, dtype=np.uint64))
    emit, start, moves = base * (0.25 + 1.5 * (noise >> np.uint64(11)) / 2.0**53), np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k)
    for _ in range(rounds):
        by_word, first, xi, _ = [sum(x) for x in zip(*[whole([number[w] for w in t], emit, start, moves) for t in own], strict=True)]
        start, moves = (first + 1 / k) / (first.sum() + 1), (xi + language_model.MOVES / k) / (xi + language_model.MOVES / k).sum(1, keepdims=True)
        share = by_word.sum(0) / by_word.sum()
        emit = (by_word + share + language_model.PRIOR * base) / (by_word.sum(0) + share * (v + 1) + language_model.PRIOR)
    return [whole([number[w] for w in t], emit, start, moves)[3] / math.log(10) for t in texts]


@pytest.mark.parametrize("group", [4096, 1])
def test_equals_brute_force(spark, monkeypatch, group):
    """Three states, three rounds over several blocks: the score of every text, words seen once and unknown ones among them."""
    monkeypatch.setattr(language_model, "STRETCH", 16)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(wordblocks, "GROUP_BLOCKS", group)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(0, 120))) % 300)) for i in range(60)]
    monkeypatch.setattr(wordblocks, "parts_for", lambda *a: 1)  # so a word's salt is its number
    inner = language_model._counting()
    docs = frame(spark, rows).repartition(3).persist()
    numbers = {}
    blocks = wordblocks.store(docs, language_model._split, lambda i: not language_model.is_held(i), 1500)
    monkeypatch.setattr(language_model, "store", lambda *a, **b: blocks)
    for r in wordblocks.look_up(blocks, inner, "tokens seen").join(blocks, "block").collect():
        for w, n in zip(wordblocks.unpack_words(r.words[0].words)[0], unpack(r["values"])[1].tolist(), strict=True):
            assert numbers.setdefault(w, n) == n
    got = {r.doc_id: r for r in score(docs, states=3, rounds=3, tolerance=-1).collect()}
    want = brute_hmm(rows, 3, 3, numbers)
    assert blocks.count() > 5
    assert np.allclose([got[i].score for i, _ in rows], want, rtol=1e-3)  # shares are exchanged in 16 bits
    assert {r.rounds for r in got.values()} == {3}


def test_rounds_stop_when_nothing_is_gained(spark):
    rows = [(i, "a b c") for i in range(20)]
    got = score(frame(spark, rows), states=2, rounds=50).first()
    assert 2 <= got.rounds < 50
    assert got.train_score < 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in language_model.op10_hidden_markov(spark, sf).collect()], key=order)
    want = sorted(brute(rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
