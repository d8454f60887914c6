import math

import numpy as np
import pytest

from lociframe.functions import dist
from lociframe.model import FilterParams, WindowParams


def test_t_with_three_and_four_degrees_of_freedom():
    t = np.linspace(0, 30, 61)
    u = t / math.sqrt(3)
    three = 2 * (0.5 - (u / (1 + u * u) + np.arctan(u)) / math.pi)
    s = t * t / 4
    four = 2 * (0.5 - 0.375 * t / np.sqrt(1 + s) * (1 - s / 3 / (1 + s)))
    assert np.allclose(dist.t_two_sided(t, 3), three, atol=1e-12)
    assert np.allclose(dist.t_two_sided(t, 4), four, atol=1e-12)


def test_chi_square_with_even_degrees_of_freedom_is_a_poisson_sum():
    x = np.array([0.0, 0.5, 3.0, 14.0, 60.0])
    want = [math.exp(-v / 2) * sum((v / 2) ** k / math.factorial(k) for k in range(7)) for v in x]
    assert np.allclose(dist.chi2_upper(x, 14), want, atol=1e-13)


def test_normal_cdf_is_that_of_erf():
    x = np.array([-6.0, -1.0, 0.0, 0.3, 2.0])
    assert np.allclose(dist.normal_cdf(x, 0.5, 2.0), [0.5 * (1 + math.erf((v - 0.5) / 2 / math.sqrt(2))) for v in x], atol=1e-14)


def test_beta_cdf_of_small_shapes():
    x = np.linspace(0, 1, 11)
    assert np.allclose(dist.beta_cdf(x, 1.0, 1.0), x)
    assert np.allclose(dist.beta_cdf(x, 2.0, 1.0), x**2)
    assert np.allclose(dist.beta_cdf(x, 1.0, 3.0), 1 - (1 - x) ** 3)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        FilterParams(min_allele_frequency=1.5)
    with pytest.raises(ValueError):
        WindowParams(size=10, slide=20)


def test_shared_folder_is_the_sessions_own():
    from types import SimpleNamespace as Namespace

    from lociframe.sources import shared

    session = lambda folder, master: Namespace(conf=Namespace(get=lambda key, default: folder), sparkContext=Namespace(master=master, applicationId="a"))
    assert shared.shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    made = shared.shared_dir(session(None, "local[2]"))
    assert made.startswith("file:///") and shared.shared_dir(session("", "local")) == made
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(None, master))
