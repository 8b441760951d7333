import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratestep.functions import special as s


@given(st.floats(1e-3, 1e8))
@settings(max_examples=200, deadline=None)
def test_lgamma(x):
    assert float(s.lgamma(x)) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)


@pytest.mark.parametrize("a", [1, 3, 20])
@pytest.mark.parametrize("b", [1, 4, 33])
@pytest.mark.parametrize("x", [0.0, 0.01, 0.3, 0.9, 1.0])
def test_betainc_is_a_binomial_sum(a, b, x):
    n = a + b - 1
    want = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
    assert float(s.betainc(a, b, x)) == pytest.approx(want, abs=1e-13)
    assert float(s.betaincc(a, b, x)) == pytest.approx(1 - want, abs=1e-13)


@pytest.mark.parametrize("a", [1, 3, 20])
@pytest.mark.parametrize("x", [0.0, 0.01, 0.3, 5.0, 40.0])
def test_gammainc_is_a_poisson_tail(a, x):
    want = math.exp(-x) * sum(x**j / math.factorial(j) for j in range(a))
    assert float(s.gammaincc(a, x)) == pytest.approx(want, abs=1e-13)
    assert float(s.gammainc(a, x)) == pytest.approx(1 - want, abs=1e-13)


def test_logsumexp_of_nothing_and_of_impossible():
    assert s.logsumexp(np.array([-np.inf, -np.inf])) == -np.inf
    assert s.logsumexp(np.array([[0.0, 0.0], [-np.inf, 1.0]]), axis=1) == pytest.approx([math.log(2), 1.0])


def test_predictives_sum_to_one():
    x = np.arange(4000)
    assert np.exp(s.gamma_poisson_logpmf(x, 2.0, 3.0, 0.5)).sum() == pytest.approx(1)
    assert np.exp(s.beta_negbinom_logpmf(x, 1.0, 4.0, 30.0, 20.0)).sum() == pytest.approx(1)
    assert np.exp(s.betabinom_logpmf(np.arange(21), 20, 2.0, 5.0)).sum() == pytest.approx(1)


def test_digamma():
    assert s.digamma(np.array([1.0])) == pytest.approx([-0.5772156649015329])


def test_ks():
    assert s.ks_uniform((np.arange(1000) + 0.5) / 1000)[1] > 0.99
    assert s.ks_uniform(np.full(1000, 0.5))[1] < 1e-10
