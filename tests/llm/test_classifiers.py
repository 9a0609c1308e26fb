"""The estimators against plain ones: the risk and its gradient, the updates of FTRL one coordinate at a time."""

import math

import numpy as np

from gridloom.llm import quality, toxicity


def test_risk_and_gradient_equal_plain_ones():
    rng = np.random.RandomState(3)
    p, u = rng.randn(40, 5) + 0.5, rng.randn(60, 5)
    for prior, w in ((0.4, rng.randn(5)), (0.9, 3 * np.ones(5)), (0.97, np.array([9.0, 9, 0, 0, 0]))):

        def terms(w):
            f = lambda x: sum(a * b for a, b in zip(x, w))
            loss = lambda z: math.log1p(math.exp(-z))
            mean = lambda values: sum(values) / len(values)
            return prior * mean([loss(f(x)) for x in p]), mean([loss(-f(x)) for x in u]) - prior * mean([loss(-f(x)) for x in p])

        positive, negative, gradient = quality.risk_gradient(w, p, u, prior)
        assert np.allclose((positive, negative), terms(w), atol=1e-6)
        aim = (lambda w: -terms(w)[1]) if negative < 0 else (lambda w: sum(terms(w)))
        slope = [(aim(w + h) - aim(w - h)) / 2e-5 for h in 1e-5 * np.eye(5)]
        assert np.allclose(gradient, slope, atol=1e-5)


def test_the_prior_is_found_where_the_classes_are_apart():
    rng = np.random.RandomState(4)
    good, bad = (lambda n: rng.randn(n, 6) + 1.5), (lambda n: rng.randn(n, 6) - 1.5)
    for share in (0.3, 0.8):
        model = quality.fit_pu(good(500), np.vstack([good(int(1000 * share)), bad(int(1000 * (1 - share)))]))
        assert abs(model.prior - share) < 0.06
        assert (model.score(good(300)) >= 0.5).mean() > 0.95 and (model.score(bad(300)) < 0.5).mean() > 0.95


def test_ftrl_equals_a_plain_one():
    rng = np.random.RandomState(5)
    rows = [(np.unique(rng.randint(0, 30, 6)).astype(np.int32), int(rng.rand() < 0.4)) for _ in range(200)]
    how = toxicity.Ftrl(alpha=0.7, beta=0.5, l1=2.0, l2=0.1, epochs=3, weight=2.0)
    z, n, l1 = {}, {}, how.l1 * math.sqrt(len(rows) / toxicity.SAMPLE_ROWS)

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for at, y in rows:
            w = {int(i): weight(int(i)) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (how.weight if y else 1)
            for i in w:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / how.alpha * w[i]
    at, w = toxicity.train(rows, how)
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), w)).keys() == want.keys() and all(math.isclose(want[i], x, rel_tol=1e-9) for i, x in zip(at.tolist(), w))


def test_grams_are_words_bigrams_and_skips():
    indexes = lambda text: set(toxicity.Hasher().indexes(text).tolist())
    assert len(indexes("a b c")) == 1 + 3 + 2 + 1 and indexes("A b, C") == indexes("a b c") != indexes("a c b")
    assert indexes(None) == indexes("") == {0} and indexes("a b a b a b") == indexes("a b a b a")
