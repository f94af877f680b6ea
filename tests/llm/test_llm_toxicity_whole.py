"""The toxicity model learns from every labelled text, whatever their number."""

import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import toxicity


@pytest.mark.parametrize("shard_bytes", [1 << 30, 60_000])
def test_texts_late_in_the_hash_order_count(spark, shard_bytes):
    """A word that only toxic texts behind the first 2500 of their class hold is learned, from one shard or several."""
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    order = sorted(range(2650), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    late = set(order[2500:])
    rows = []
    for i in range(5300):
        words = rng.choices(plain, k=10)
        if i < 2650:
            words[rng.randrange(10)] = "zorp" if i in late else "grum"
        rows.append((i, " ".join(words), int(i < 2650)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels, shard_bytes=shard_bytes, epochs=4)
    asked = spark.createDataFrame([(k, " ".join(rng.choices(plain, k=9) + ([w] if w else []))) for k, w in enumerate(["zorp", "grum", ""] * 20)], "doc_id bigint, text string")
    scores = [r["score"] for r in toxicity.score_toxicity(asked, model).orderBy("doc_id").collect()]
    found = np.array(scores).reshape(-1, 3) >= toxicity.THRESHOLD
    assert found[:, 0].all() and found[:, 1].all() and not found[:, 2].any()


def test_a_state_names_every_parameter():
    rng = np.random.default_rng(1)
    model = toxicity._start_from(rng.integers(0, 9, (2, (1 << toxicity.BITS) + 1)).astype(float), 0.5, rng)
    rates = toxicity._Rates.of(model)
    rates.filters[1].square += 3
    again, squares = toxicity._from_state(toxicity._to_state(model, rates))
    assert (again.vectors == model.vectors).all() and all((a == b).all() for a, b in zip(again.filters, model.filters))
    assert (again.out == model.out).all() and again.base == model.base and (squares.filters[1].square == rates.filters[1].square).all()


def test_equal_margins_share_a_side():
    margin, y = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])
    cuts = toxicity.calibrate(margin, np.zeros(4, dtype=int), y, np.array([5, 4, 6, 3]))
    assert cuts[0] == 0.5


def test_a_shard_sends_its_changes_in_short_form():
    """A third of the bytes: with whole numbers the check projected disk of 5 times the input."""
    rng = np.random.default_rng(3)
    moved = rng.normal(0, 1, (500, toxicity.WIDTH)) * 10.0 ** rng.integers(-6, 1, (500, 1))
    square = 10.0 ** rng.uniform(-7, 3, (500, toxicity.WIDTH))
    moved[0], square[1, :3] = 0, 0
    raw = toxicity._short(np.concatenate([moved, square], axis=1).astype(np.float32))
    again = toxicity._from_short(raw)
    assert len(raw) <= 500 * 20
    assert (np.abs(again[:, :toxicity.WIDTH] - moved) <= np.abs(moved).max(axis=1, keepdims=True) / 250).all()
    assert np.allclose(again[:, toxicity.WIDTH:], square, rtol=0.07, atol=1e-30) and (again[0, :toxicity.WIDTH] == 0).all()
