"""Scalar functions: fixed points, ties, missing values."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import pitch, values, vector


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_pitch_edges(spark):
    r = one(spark, pitch.hz_to_midi(F.lit(440.0)), pitch.hz_to_midi(F.lit(0.0)), pitch.hz_to_midi(F.lit(float("nan"))), pitch.midi_to_hz(F.lit(57.0)), pitch.cents_off(F.lit(60.5)), pitch.cents_off(F.lit(61.5)))
    assert r[0] == 69 and r[1] is None and r[2] is None and r[3] == pytest.approx(220) and r[4] == 50 and r[5] == -50


def test_positions(spark):
    r = one(spark, pitch.position_of(F.lit(40.0), F.lit(None).cast("int")), pitch.position_of(F.lit(70.2), F.lit(6)), pitch.position_of(F.lit(20.0), F.lit(None).cast("int")), pitch.position_of(F.lit(45.0), F.lit(None).cast("int")))
    assert tuple(r[0]) == (6, 0) and tuple(r[1]) == (6, 30) and r[2] is None and tuple(r[3]) == (6, 5)


def test_frets(spark):
    r = one(spark, pitch.nearest_fret(F.lit(0.0)), pitch.nearest_fret(F.lit(5.0)), pitch.nearest_fret(F.lit(None).cast("double")), pitch.behind_wire(F.lit(0.0), F.lit(1)), pitch.string_at(F.lit(0.5)), pitch.string_at(F.lit(-3.0)), pitch.fret_unit(F.lit(0.0)))
    assert r[0] == 0 and r[1] == 7 and r[2] is None and r[3] < 0 and r[4] == 4 and r[5] == 6 and r[6] == 0


def test_expected_pitches(spark):
    none = F.lit(None).cast("array<int>")
    r = one(
        spark,
        pitch.expected_pitches(F.array(*[F.lit(x) for x in (-1, 0, -1, -1, -1, -1)]), F.lit(1), F.lit(1), F.lit(None).cast("double")),
        pitch.expected_pitches(none, F.lit(5), F.lit(0), F.lit(99.0)),
        pitch.expected_pitches(none, F.lit(0), F.lit(0), F.lit(99.0)),
        pitch.expected_pitches(none, F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("double")),
    )
    assert r[0] == pytest.approx([110]) and r[1] == pytest.approx([110]) and r[2] == [99.0] and r[3] == []


def test_tones(spark):
    r = one(spark, pitch.tone(F.lit(100.0), 0.1, 1000), F.size(pitch.glide(F.lit(10.0), F.lit(20.0), 0.1, 1000)), pitch.pulse_train(F.array(F.lit(1)), F.array(F.lit(0)), F.lit(2)), pitch.envelope(F.lit(0.0), F.lit(1.0)), pitch.envelope(F.lit(3.0), F.lit(1.0)))
    assert len(r[0]) == 100 and abs(r[0][0]) < 1e-12 and r[1] == 100 and r[2] == [1, 0, 1, 0] and r[3] == 1 and r[4] == 0


def test_values(spark):
    nan = F.lit(float("nan"))
    r = one(
        spark, values.status_band(nan, 5, 3), values.status_band(F.lit(5.0), 5, 3), values.status_band(F.lit(6.0), 5, 3), values.status_band(F.lit(0.7), 0.8, 0.92, False),
        values.safe_name(F.lit("//")), values.safe_name(F.lit("a b/c.1")), values.to_int(F.lit("12.9")), values.to_int(F.lit("x")), values.to_double(F.lit("NaN")),
        values.string_number(F.lit(None).cast("int"), F.lit("6 (low E)")), values.string_number(F.lit(None).cast("int"), F.lit("low")), values.percent(F.lit(None).cast("double")), values.percent(F.lit(0.125)),
        values.html_escape(F.lit('<a&"b">')), values.rms(F.array(F.lit(3.0), F.lit(4.0))), values.diagnosis(F.lit(1.0), F.lit(0.1)), values.diagnosis(F.lit(0.1), F.lit(1.0)), values.diagnosis(F.lit(0.0), F.lit(0.0)),
    )
    assert list(r) == ["amber", "amber", "red", "red", "x", "abc.1", 12, None, None, 6, 0, "–", "12.5%", "&lt;a&amp;&quot;b&quot;&gt;", pytest.approx(math.sqrt(12.5)), "PASS", "SWAPPED", "FAIL"]


def test_lists(spark):
    flat = F.array(*[F.lit(x) for x in ("e1", "0.5", "e2", "bad")])
    r = one(spark, values.element_scores(flat), values.channel_list(F.lit("1, 9,2,x"), F.lit(8)), values.channel_list(F.lit(None).cast("string"), F.lit(12)), values.element_scores(F.array().cast("array<string>")))
    assert [x.element for x in r[0]] == ["e1", "e2"] and math.isnan(r[0][1].score) and r[1] == [1, 2] and r[2] == list(range(1, 9)) and r[3] == []


def test_contract_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), "x")], "b int, a double, extra string")
    out = values.contract(values.nan_to_null(df), "a double, b int, c string")
    assert out.columns == ["a", "b", "c"] and tuple(out.first()) == (None, 1, None)


def test_geometry(spark):
    p = lambda x, y: g.point(F.lit(float(x)), F.lit(float(y)))
    quad = F.array(p(0, 0), p(2, 0), p(2, 1), p(0, 1))
    turned = F.array(p(2, 0), p(2, 1), p(0, 1), p(0, 0))
    h = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((2, 0, 1), (0, 2, 1), (0, 0, 1))])
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    r = one(
        spark, g.area(quad), g.centroid(quad), g.align_corners(turned, quad), g.order_along_long_edges(turned), g.in_quad(quad, F.lit(0.5), F.lit(0.5)), g.angle_at(p(1, 0), p(0, 0), p(0, 1)), g.angle_at(p(0, 0), p(0, 0), p(0, 1)),
        g.project(g.invert(h), F.lit(3.0), F.lit(5.0)), g.along_edge(p(1, 1), p(0, 0), p(4, 0)), g.box_jumped(box(0, 0, 10, 10), box(0, 0, 10, 10)), g.box_jumped(box(5, 5, 15, 15), box(0, 0, 10, 10)), g.from_box(g.to_box(p(3, 4), box(1, 1, 5, 9)), box(1, 1, 5, 9)),
        g.wrap_line_angle(F.lit(90.0)), g.invert(F.array(*[F.array(*[F.lit(1.0)] * 3)] * 3)),
    )
    assert r[0] == 2 and tuple(r[1]) == (1, 0.5) and [tuple(q) for q in r[2]] == [(0, 0), (2, 0), (2, 1), (0, 1)] and [tuple(q) for q in r[3]] == [(2, 1), (0, 1), (0, 0), (2, 0)]
    assert tuple(r[4]) == (1, 0.5) and r[5] == pytest.approx(90) and r[6] is None and tuple(r[7]) == (1, 2) and r[8] == 0.25 and r[9] is False and r[10] is True and tuple(r[11]) == (3, 4) and r[12] == -90 and r[13] is None


def test_active_finger(spark):
    offsets = F.create_map(*[x for k, v in (("index", -0.3), ("middle", 0.1)) for x in (F.lit(k), F.lit(v))])
    r = one(spark, g.active_finger(F.lit("index"), offsets, ("index", "middle", "ring")), g.active_finger(F.lit("ring"), offsets, ("index", "middle", "ring")))
    assert list(r) == ["index", "middle"]


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    eye = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    r = one(spark, vector.norm(a), vector.l2_normalised(a), vector.l2_normalised(z), vector.cosine(a, a), vector.cosine(a, z), vector.mahalanobis(a, z, eye))
    assert r[0] == 5 and r[1] == [0.6, 0.8] and r[2] == [0, 0] and r[3] == pytest.approx(1) and r[4] is None and r[5] == 5
