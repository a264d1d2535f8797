"""The choice of priors of the toxicity model: what the driver is given to plan, and sums equal to those of the model."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cloudloom.llm import textkit as tk
from cloudloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    texts = [" ".join([f"w{rng.randrange(60)}x" for _ in range(rng.randrange(60))] + ["bad", "thing"] * (k % 3 if k % 4 == 0 else 0)) for k in range(200)]
    rows = [(int(k % 4 == 0), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "__toxic int, text string")
    other = [(int(k % 2 == 0), t + " never seen") for k, t in enumerate([*texts[::7], "", "bad bad thing"])]
    return toxicity.count(df, "text"), spark.createDataFrame(other, "__toxic int, text string"), [t for _, t in other]


def chosen(counts, sample, monkeypatch):
    """Length of the plan behind what comes to the driver, and that table."""
    seen, frame = [], type(sample)
    real = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: seen.append((len(self._jdf.queryExecution().toString()), real(self))) or seen[-1][1])
    toxicity.choose(counts, sample, "text")
    monkeypatch.undo()
    return seen[-1]


def test_plan_does_not_hold_all_terms(corpus, monkeypatch):
    """The driver writes the plan out at each step of an adaptive run."""
    counts, sample, _ = corpus
    assert chosen(counts, sample, monkeypatch)[0] < 60_000


def test_sums_equal_those_of_the_model(corpus, monkeypatch):
    counts, sample, texts = corpus
    for limit in (toxicity.MERGE_SUMS, 1):  # tasks that pass their sums on once, and after each batch
        monkeypatch.setattr(toxicity, "MERGE_SUMS", limit)
        fit = chosen(counts, sample, monkeypatch)[1]
        data, off = tk.text_buffer(pa.array(texts))
        for i, (q, r) in enumerate((q, r) for q in toxicity.WORD_PRIORS for r in toxicity.PAIR_PRIORS):
            x, n = toxicity.Model.collect(*toxicity.learn(counts, q, r)).sums(tk.words(data, off, loose=True))
            got = fit[["n", f"x{i}"]].to_numpy(float)
            want = np.stack([n, x], axis=1)
            assert np.abs(got[np.lexsort(got.T[::-1])] - want[np.lexsort(want.T[::-1])]).max() < 1e-9


def test_rounds_count_the_same(spark, monkeypatch):
    """However many rounds the pairs are counted in, the counts are those of all pairs; no round shuffles them all."""
    rng = random.Random(8)
    df = spark.createDataFrame([(k % 2, " ".join(f"w{rng.randrange(40)}x" for _ in range(30))) for k in range(80)], "__toxic int, text string")
    seen = []
    for rounds in (1, 2, 5):
        monkeypatch.setattr(toxicity, "ROUNDS", rounds)
        monkeypatch.setattr(toxicity, "cut", lambda t, real=toxicity.cut: sizes.append((t.columns, real(t))) or sizes[-1][1])
        sizes = []
        c = toxicity.count(df, "text")
        monkeypatch.undo()
        assert len([1 for columns, _ in sizes if columns == ["u", "v", "c_t", "c_o"]]) == rounds + 1  # and the pairs that stay
        seen.append((c.rates, *[sorted(tuple(round(x, 9) for x in r) for r in t.collect()) for t in (c.words, c.pairs, c.contexts)]))  # the order of sums is open
    assert seen[0] == seen[1] == seen[2]
