import pytest

from genoframe import config


def test_precedence_and_unknown_keys():
    c = config.effective("fast", {"model": {"epochs": "7"}, "sim": {"prop": "${P:0.3}"}}, {"sim.prop": 0.4}, {"split.by_populations": "yes"})
    assert (c.model.epochs, c.model.rounds, c.sim.prop, c.split.by_populations) == (7, 1, 0.4, True)
    assert config.effective(document='{"preset": "thorough"}').model.rounds == 5
    for wrong in ({"model.nothing": 1}, {"nothing": 1}):
        with pytest.raises(KeyError):
            config.override(config.Config(), wrong)
    with pytest.raises(KeyError):
        config.effective("hasty")


def test_coercion_and_interpolation():
    assert config.coerce("", 3) == 3 and config.coerce("on", False) is True and config.coerce("2.5", 1.0) == 2.5
    assert config.interpolate("a${X}b${Y:z}c${X", {"X": "1"}) == "a1bzc${X"
    assert config.interpolate("${Q}", {}) == "${Q}"


def test_best_parameters():
    assert config.best_parameters('{"lr": 1, "latent_dim": 3}', {"latent_dim": "latent"}, ("lr",)) == {"model.latent": 3}
