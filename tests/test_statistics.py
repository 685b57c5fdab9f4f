"""Driver statistics against published constants and identities."""

import math

import numpy as np
import pytest

from tidegauge.functions import bayes, binomial, diagnostics, families, meta, power, sequential
from tidegauge.functions import distributions as D
from tidegauge.operators.designs import bracket_ranks


def test_distributions():
    assert D.norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert D.t_ppf(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert D.t_ppf(0.975, 1) == pytest.approx(12.7062047364, rel=1e-8)
    assert D.chi2_ppf(0.95, 1) == pytest.approx(3.841458821, rel=1e-8)
    assert D.chi2_sf(18.307038, 10) == pytest.approx(0.05, rel=1e-6)
    assert D.f_sf(4.964603, 1, 10) == pytest.approx(0.05, rel=1e-5)
    assert D.beta_ppf(0.5, 2, 2) == pytest.approx(0.5)
    assert D.clopper_pearson(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-6)
    assert D.noncentral_t_cdf(1.0, 10, 0.0) == pytest.approx(1 - D.t_sf(1.0, 10), abs=1e-8)
    assert D.binom_sf(4, 10, 0.5) == pytest.approx(sum(math.comb(10, k) for k in range(5, 11)) / 1024)


def test_binomial_intervals():
    d, lo, hi = binomial.risk_difference(10, 100, 20, 100)
    assert d == pytest.approx(0.1) and lo < 0.1 < hi
    assert abs(binomial.score_z(10, 100, 20, 100, lo)) == pytest.approx(1.959964, abs=1e-4)
    point, lo, hi = binomial.relative_exact(50, 100, 75, 100)
    assert point == pytest.approx(0.5) and lo < 0.5 < hi
    assert binomial.asymptotic_serves([(5000, 10000), (5200, 10000)], 0.025) and not binomial.asymptotic_serves([(5, 100), (9, 100)], 0.025)
    assert binomial.fisher_one_sided(1, 10, 9, 10) == pytest.approx(0.000547, abs=1e-5)


def test_sample_ratio():
    assert not diagnostics.sample_ratio({"a": 5000, "b": 5050}, {"a": 0.5, "b": 0.5})["is_srm"]
    assert diagnostics.sample_ratio({"a": 5000, "b": 5700}, {"a": 0.5, "b": 0.5})["is_srm"]
    assert diagnostics.missing_by_arm({"a": 90, "b": 90}, {"a": 10, "b": 10}) == pytest.approx(1)
    assert diagnostics.e_value(2.0) == pytest.approx(2 + math.sqrt(2))
    t2, p = diagnostics.hotelling(np.array([0.0, 0.0]), np.eye(2), 10, 10)
    assert (t2, p) == pytest.approx((0, 1))


def test_families():
    assert families.bh([0.001, 0.02, 0.03, 0.9], 0.05) == [True, True, True, False]
    assert families.e_bh([5.0, 4.0, 0.0], 0.05) == [True, True, False]
    assert families.holm([0.01, 0.04, 0.03], 0.05) == [True, False, False]
    base = {"metric": "m", "role": "primary", "lb": 0.01, "ub": 0.05}
    assert families.decide([base])["verdict"] == "ship"
    assert families.decide([base, {"metric": "g", "role": "guardrail", "lb": -0.1, "ub": -0.05, "margin": 0.01}])["verdict"] == "stop"
    assert families.decide([{**base, "lb": -0.01}])["verdict"] == "hold"


def test_sequences_hold_more_than_fixed_intervals():
    lo, hi = sequential.bernoulli_sequence(50, 100)
    assert lo < D.clopper_pearson(50, 100)[0] and hi > D.clopper_pearson(50, 100)[1]
    a, b = sequential.gaussian_sequence(1.0, 4.0, 100, 1.0)
    assert sequential.gaussian_log_e(1.0, 4.0, 100, a, 1.0) == pytest.approx(-math.log(0.05))
    assert sequential.count_boundary(100, 0.05, 0.1) == pytest.approx(2 * (math.log(2) - 2 * math.log(0.05)))


def test_bayes():
    p = bayes.normal_posterior(0.1, 0.1, bayes.Normal(0, 0.1))
    assert (p.mean, p.sd) == pytest.approx((0.05, 0.1 / math.sqrt(2)))
    grid = bayes.grid_posterior(0.1, 0.1, bayes.Normal(0, 0.1))
    assert grid["mean"] == pytest.approx(0.05, abs=1e-4)
    m = bayes.mixture_posterior(0.1, 0.1, bayes.Mixture((1.0,), (bayes.Normal(0, 0.1),)))
    assert bayes.summary(m)["mean"] == pytest.approx(0.05)


def test_power_inverts():
    n = power.required_sample_size(0.05, 1.0)
    assert power.achieved_power(0.05, 1.0, n) >= 0.8 > power.achieved_power(0.05, 1.0, n - 2)
    assert power.minimum_detectable_effect(1.0, n) == pytest.approx(0.05, rel=1e-3)
    assert power.switchback_power(1.0, 2.0, power.switchback_units(1.0, 2.0)) >= 0.8
    assert 0.03 < power.exact_binomial_power(0.3, 0.3, 20) < 0.08


def test_meta():
    h = meta.heterogeneity([0.1] * 6, [0.01] * 6)
    assert h["q"] == pytest.approx(0, abs=1e-12) and h["tau2"] == 0 and h["i2"] == 0
    s = meta.shrunk([0.0, 0.2, 0.1], [0.01, 0.01, 0.01])
    assert 0 < s[0]["mean"] < 0.1 < s[1]["mean"] < 0.2
    assert {r["action"] for r in meta.rollout([{"segment": k, "est": 0.3, "var": 1e-4} for k in "abc"])} == {"roll_out"}


def test_bracket_ranks():
    assert bracket_ranks(100, 0.5, 0.05) == (40, 61)
    assert bracket_ranks(5, 0.9, 0.05) is None


def test_exact_ratio_is_the_inverted_test():
    """Against all ratios of a fine grid: those inside aren't rejected at some control rate, those outside are at every one."""
    from math import comb, log

    def p_value(x, n, p):
        mass = [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        return min(1.0, 2 * min(sum(mass[x:]), sum(mass[: x + 1])))

    for x_c, n_c, x_t, n_t in ((4, 20, 9, 22), (5, 18, 10, 18), (12, 25, 11, 24)):
        point, low, high = binomial.relative_exact(x_c, n_c, x_t, n_t, gamma=1e-4, grid=400)
        assert low < point < high and abs(point - ((x_t / n_t) / (x_c / n_c) - 1)) < 1e-12

        def largest(r, x_c=x_c, n_c=n_c, x_t=x_t, n_t=n_t):
            best = 0.0
            for k in range(1, 400):
                p = k / 400
                if r * p < 1:
                    q = p_value(x_c, n_c, p) * p_value(x_t, n_t, r * p)
                    best = max(best, q * (1 - log(q)) if q > 0 else 0.0)
            return best

        for end, inward in ((low, 1.05), (high, 0.95)):
            assert largest((1 + end) * inward) > 0.05 - 0.002 and largest((1 + end) / inward) < 0.05 + 0.002
