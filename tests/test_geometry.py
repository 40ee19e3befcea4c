import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sphaera.functions import geometry as g
from sphaera.functions import transforms as tf
from sphaera.operators import tessellation as tess

angle = st.floats(-math.pi, math.pi, allow_nan=False)


@given(st.lists(st.tuples(angle, angle, angle), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_rotation_survives_euler_round_trip(spark, angles):
    df = spark.createDataFrame(angles, "phi double, theta double, psi double")
    q = g.euler_to_quaternion(F.col("phi"), F.col("theta"), F.col("psi"))
    df = df.select(*(c.alias(f"q{k}") for k, c in enumerate(q)))
    back = g.quaternion_to_euler([F.col(f"q{k}") for k in range(4)])
    df = df.select("*", *(c.alias(n) for n, c in zip("abc", back, strict=True)))
    again = g.euler_to_quaternion(F.col("a"), F.col("b"), F.col("c"), flip=True)
    for r in df.select("q0", "q1", "q2", "q3", *(c.alias(f"r{k}") for k, c in enumerate(again))).collect():
        p, s = np.array(r[:4]), np.array(r[4:])
        assert abs(abs(p @ s) - 1) < 1e-9


def test_twins_look_the_other_way(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, tf.random_quaternion(rng))) for i in range(20)]
    df = g.with_conjugates(spark.createDataFrame(rows, "img_id long, q0 double, q1 double, q2 double, q3 double"), 20)
    d = {r["img_id"]: np.array(r[1:]) for r in df.select("img_id", *g.direction([F.col(f"q{k}") for k in range(4)])).collect()}
    for i in range(20):
        assert np.allclose(d[i], -d[i + 20]) and abs(np.linalg.norm(d[i]) - 1) < 1e-9


def test_tessellation_sizes():
    for k in (10, 50, 100, 500):
        p = tess.sphere_points(k)
        assert len(p) == k and np.allclose(np.linalg.norm(p, axis=1), 1)
    assert np.allclose(np.linalg.norm(tess.sphere_points(1000), axis=1), 1)  # no made-up zero rows


def test_grid_assignment_equals_scan(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "img_id long, sx double, sy double, sz double")
    c = tess.centres(spark, 100)
    near = {r[0]: r[1] for r in tess.assign(rows, c, 100).collect()}
    monkeypatch.setattr(tess, "BROADCAST_CENTRES", 0)
    assert near == {r[0]: r[1] for r in tess.assign(rows, c, 100).collect()}
    p = tess.sphere_points(100)
    assert near == {i: int(np.argmin(((x - p) ** 2).sum(1))) for i, x in enumerate(v)}


def test_transform_identities():
    rng = np.random.default_rng(0)
    for axes in ("sxyz", "szyx", "rzyz", "szxz", "ryxz", "rxyx"):
        m = tf.euler_matrix(*rng.uniform(-3, 3, 3), axes)
        assert np.allclose(tf.euler_matrix(*tf.euler_of(m, axes), axes), m)
    q = tf.random_quaternion(rng)
    assert tf.same_quaternion(tf.quaternion_of(tf.quaternion_matrix(q)), q)
    assert np.allclose(tf.quaternion_multiply(q, tf.quaternion_inverse(q)), [1, 0, 0, 0])
    for m, back in ((tf.rotation(0.7, [1, 2, 3], [0.1, 0.2, 0.3]), lambda m: tf.rotation(*tf.rotation_of(m))), (tf.reflection([1, 2, 3], np.array([1, 1, 0])), lambda m: tf.reflection(*tf.reflection_of(m))), (tf.scaling(1.7, [1, 2, 3], np.array([0, 1, 1])), lambda m: tf.scaling(*tf.scaling_of(m))), (tf.compose([1, 2, 3], [0.1, 0.2, 0.3], (0.1, -0.4, 0.9), [5, 6, 7]), lambda m: tf.compose(*tf.decompose(m)))):
        assert np.allclose(back(m), m)
    ball = tf.Arcball()
    ball.down((0, 0))
    ball.drag((0.5, 0))
    assert abs(np.linalg.norm(ball.now) - 1) < 1e-9
