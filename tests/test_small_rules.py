"""Named tests of small rules: boxes, holes, polar curves, modes, tokens of data lines, file errors, sizes of a case."""

import math

import pytest

from tessera.functions import fields
from tessera.functions.metric import Box
from tessera.operators import stats
from tessera.sources import regions, text


@pytest.mark.parametrize("sides", [(-1.0,), (math.inf, 1.0), (1.0, math.nan)])
def test_box_sides_are_finite_and_not_negative(sides):
    with pytest.raises(ValueError, match="finite"):
        Box(sides)


@pytest.mark.parametrize("sides", [(), (0.0, 1.0), (1.0, 0.0)])
def test_a_closed_box_needs_positive_sides(sides):
    with pytest.raises(ValueError, match="positive"):
        Box(sides).need_positive()
    Box((1.0, 2.0)).need_positive()


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.5])
def test_a_hole_takes_its_fraction_of_the_box(fraction):
    r = regions.hole_radius(fraction, (4.0, 2.5))
    assert math.isclose(math.pi * r * r, fraction * 4.0 * 2.5, abs_tol=1e-15)


def test_polar_series():
    terms = regions.polar_series((1.0, 0.2), (0.0, 0.0, 0.0, 0.15))
    for t in (0.0, 0.7, 2.0, 5.5):
        assert math.isclose(regions.polar(terms, t), 1 + 0.2 * math.cos(t) + 0.15 * math.sin(4 * t))
    assert regions.polar_series((), (2.0,)) == [(0, 0.0, 0.0), (1, 0.0, 2.0)]
    assert terms == regions.BAYONA_OUTER and math.isclose(regions.polar(regions.BAYONA_INNER, 0.0), 0.3)


BOX = Box((2.0, 2.0))


@pytest.mark.parametrize(
    ("modes", "nu", "message"),
    [
        ([], 1.0, "no mode"),
        ([(1.0, 0, 0)], 1.0, "other than"),
        ([(1.0, 1, 0)], 0.0, "exceed zero"),
        ([(1.0, 1, 2), (0.5, -1, -2)], 1.0, "one wave vector"),
        ([(1.0, 1, 0), (1.0, 1, 1)], 1.0, "wave length"),
    ],
)
def test_shear_modes_refuse(modes, nu, message):
    with pytest.raises(ValueError, match=message):
        fields.ShearModes(BOX, [fields.Mode(*m) for m in modes], nu)


def test_shear_modes_of_one_wave_length():
    waves = fields.ShearModes(BOX, [fields.Mode(1.0, 1, 2), fields.Mode(0.5, 2, -1)], 0.1)
    assert math.isclose(waves.ksqr, 5 * math.pi**2) and math.isclose(waves.time_constant, 1 / (0.5 * math.pi**2))
    assert math.isclose(waves.decay_time(0.5), waves.time_constant * math.log(2))


@pytest.mark.parametrize("token", ["1.5", "+ 1", "1_000", "", "-", "--5", "0x1", "١"])
def test_what_is_no_whole_number(token):
    with pytest.raises(ValueError):
        text._int(token)


@pytest.mark.parametrize("token", ["1_0.5", "1,5", "", "one", "1.5f"])
def test_what_is_no_real_number(token):
    with pytest.raises(ValueError):
        text._real(token)


def test_numbers_of_tokens():
    assert (text._int("-7"), text._real("1.5e3"), text._real("-0")) == (-7, 1500.0, 0.0)


def test_data_lines_keep_their_numbers():
    rows = list(text._content("# head\n\n1 2 # tail\n  \n3\t4\n", "#"))
    assert rows == [(3, ["1", "2"]), (5, ["3", "4"])]


def test_a_pair_of_coordinates_is_two_finite_numbers():
    faults = text._Faults("a.points")
    assert text._numbers(["1", "2.5"], "rr", "line 3", faults) == [1.0, 2.5] and not faults
    assert text._numbers(["1"], "rr", "line 4", faults) is None and text._numbers(["1", "x"], "rr", "line 5", faults) is None
    text._finite([1.0, math.inf], "line 6", faults)
    with pytest.raises(text.FormatError) as told:
        faults.check()
    assert told.value.problems == ["a.points: line 4: 1 values instead of 2", "a.points: line 5: not a number", "a.points: line 6: a coordinate is not finite"]


def test_tables_of_a_case_have_one_size(spark):
    stats.same_size(spark.range(3), spark.range(3))
    with pytest.raises(ValueError, match=r"\[3, 4\]"):
        stats.same_size(spark.range(3), spark.range(4))
