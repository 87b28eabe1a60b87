import pytest

from panelspark.plans import SlotWeights, data, draw, op, slot, weighted_fill

X, Y = data("x"), data("y")


def test_weights_mix_scale_and_travel():
    a, b = SlotWeights({"flip": 0.4, "add": 0.0}, 0.1), SlotWeights({"delay": 1.0}, 0.3)
    mixed = a.mixed(b)
    assert mixed.weight("flip") == pytest.approx(0.35) and mixed.weight("add") == pytest.approx(0.15) and mixed.weight("delay") == pytest.approx(0.55)
    assert mixed.weight("rank") == pytest.approx(0.2) and mixed.operators.keys() == {"flip", "add", "delay"}
    assert a.scaled("flip", 0).weight("flip") == 0 and a.scaled("rank", 2).weight("rank") == pytest.approx(0.2) and a.weight("rank") == 0.1
    assert SlotWeights.from_json(mixed.to_json()) == mixed


@pytest.mark.parametrize("weight", [-1.0, float("nan"), float("inf")])
def test_weights_are_checked(weight):
    with pytest.raises(ValueError):
        SlotWeights({"flip": weight})
    with pytest.raises(ValueError):
        SlotWeights({}, weight)


def test_formula_weight_is_the_product_of_its_calls():
    w = SlotWeights({"flip": 0.5, "add": 0.2}, 3.0)
    assert w.of(X) == 1.0 and w.of(op("add", op("flip", X), op("flip", op("delay", Y, 2)))) == pytest.approx(0.2 * 0.5 * 0.5 * 3.0)


def test_fillings_leave_out_weight_0_at_every_depth():
    w = SlotWeights({"flip": 0.5, "add": 0.0})
    found = list(weighted_fill(op("rank", slot()), [X], ["flip", "add", "sign"], w, depth=2))
    assert {e.canonical(): v for e, v in found} == {
        'rank(flip(data("x")))': 0.5, 'rank(sign(data("x")))': 1.0, 'rank(flip(flip(data("x"))))': 0.25, 'rank(flip(sign(data("x"))))': 0.5,
        'rank(sign(flip(data("x"))))': 0.5, 'rank(sign(sign(data("x"))))': 1.0,
    }


def test_draw_is_without_replacement(spark):
    found = list(weighted_fill(op("rank", slot()), [X, Y], ["flip", "sign", "delay", "ts_mean"], SlotWeights({"delay": 5.0}), ints=range(2, 12)))
    rows = draw(spark, found, 3, 0.25).collect()
    assert len(found) == 44 and len(rows) == 33 == len({r.expr for r in rows}) and {r.stage for r in rows} == {0, 1, 2}
    assert {r.expr: r.weight for r in rows}.items() <= {e.canonical(): v for e, v in found}.items()
    assert draw(spark, [], 2, 0.5).isEmpty()
