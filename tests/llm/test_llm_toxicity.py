"""The convolutional classifier: plain loops, numeric gradients, held-out accuracy, odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, toxicity
from tablewright.llm.texts import split_terms


def words_of(texts):
    return toxicity.coded_texts(texts)


def made(seed, n, stem="grobal"):
    """Invented texts of two languages; a third of them hold a bad word or a form of a bad stem."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(2000)]
    out = []
    for i in range(n):
        lang, bad = rng.choice(["en", "de"]), rng.random() < 0.33
        words = rng.choices(plain, k=rng.choice([5, 60, 200])) + rng.choices(toxicity.FUNCTION_WORDS[lang].split(), k=12)
        if bad:
            words += [rng.choice(["nastyword", "vileword"])] if lang == "en" else [stem + "".join(rng.choices("abcdefghij", k=3))]
        rng.shuffle(words)
        out.append((i, " ".join(words), int(bad), lang))
    return out


@pytest.fixture(scope="module")
def fitted():
    rows = made(1, 900)
    return toxicity.fit_network(words_of([r[1] for r in rows]), np.array([r[2] for r in rows]), 8)


def plain_margin(model, text):
    """The network for one text, window by window."""
    words = toxicity.coded(split_terms(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])))
    vectors = [model.vectors[words.features[n]].sum(axis=0) for n in words.number]
    none = np.zeros(toxicity.WIDTH)
    margin = model.base
    for i, (w, f) in enumerate(zip(toxicity.WIDTHS, model.filters)):
        for k in range(toxicity.FILTERS):
            # a window may hang over the end, where places are empty
            top = max(sum(float(((vectors + [none] * 3)[p + j]) @ f[j][:, k]) for j in range(w)) for p in range(len(vectors) + 1))
            c = i * toxicity.FILTERS + k
            margin += max(top + model.bias[c], 0) * model.out[c]
    return margin


@pytest.mark.parametrize("windows", [7, 1 << 16])
def test_margins_equal_plain_loops(fitted, monkeypatch, windows):
    monkeypatch.setattr(toxicity, "WINDOWS", windows)
    texts = ["", "nastyword", "the cat, the nastyword; and", "ä ö ü " * 9, "grobalxyz der die", "..."]
    coded = words_of(texts)
    assert np.allclose(fitted.margins(coded), [plain_margin(fitted, t) for t in texts], atol=1e-3)
    assert [toxicity.LANGUAGES[i] for i in coded.language] == ["other", "other", "en", "other", "de", "other"]


def test_steps_follow_the_gradient():
    """A step with rate r moves each number by -r times the sign of its numeric gradient where nothing moved before."""
    rows = made(5, 12)
    words, y = words_of([r[1] for r in rows]), np.array([r[2] for r in rows])
    rng = np.random.default_rng(0)
    model = toxicity._start(words, y, rng)
    row, begin = toxicity.padded(words.number, words.doc, words.docs)
    share = np.ones(len(y))

    def loss():
        m = model.margins(words)
        p = 1 / (1 + np.exp(-m.astype(float)))
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    numeric = []
    for f, at in ((model.filters[0], (0, 0, 3)), (model.filters[2], (1, 0, 5)), (model.out, (4,)), (model.bias, (20,))):
        old = f[at]
        f[at] = old + 1e-2
        up = loss()
        f[at] = old - 1e-2
        numeric.append(up - loss())
        f[at] = old
    before = [f.copy() for f in model.filters], model.out.copy(), model.bias.copy()
    rates = [toxicity._Rate(f.shape, 1e-3) for f in model.filters]
    toxicity._descend(model, row, begin, words.features, y, share, rates, toxicity._Rate(model.vectors.shape, 1e-3),
                      *[toxicity._Rate(s, 1e-3) for s in (model.bias.shape, model.out.shape, (1,))])
    moved = [model.filters[0][0, 0, 3] - before[0][0][0, 0, 3], model.filters[2][1, 0, 5] - before[0][2][1, 0, 5], model.out[4] - before[1][4], model.bias[20] - before[2][20]]
    assert all(np.sign(m) == -np.sign(g) for m, g in zip(moved, numeric) if abs(g) > 1e-5) and any(abs(g) > 1e-5 for g in numeric)


def test_slices_change_nothing(fitted, monkeypatch):
    texts = [r[1] for r in made(3, 60)] + ["", "one"]
    whole = fitted.margins(words_of(texts))
    from tablewright.llm import texts as module

    monkeypatch.setattr(module.slices, "__defaults__", (300,))
    parts = words_of(texts)
    assert parts.docs == 62 and np.allclose(fitted.margins(parts), whole, atol=1e-4)


def test_thresholds_of_least_errors():
    rng = np.random.default_rng(2)
    margin, language, y = rng.normal(size=400), rng.integers(0, 2, 400), None
    y = (margin > np.where(language == 0, 0.5, -0.5)).astype(int)
    found = toxicity.calibrate(margin, language, y, np.ones(400))
    for i in (0, 1):
        own = language == i
        assert ((margin[own] >= found[i]) == (y[own] == 1)).all()
    assert toxicity.to_score(np.array([0.0]))[0] == pytest.approx(toxicity.THRESHOLD)


def test_held_out_accuracy(spark):
    rows = made(7, 1600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(r[2], scored[r[0]] >= toxicity.THRESHOLD) for r in rows if r[0] % 4 == 0]
    assert np.mean([y == p for y, p in held]) > 0.97


def test_odd_tables(spark):
    long = "fine words " * 100_000 + "nastyword"
    rows = made(9, 400)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "lost"), (902, long), (902, long), (903, " \n.;")], "doc_id bigint, text string")
    docs = docs.select("*", *[F.lit("x").alias(n) for n in "key y place n score toxic".split()])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (900, 0), (5, None), (6, 7), (3, 1), (901, 0)], "doc_id bigint, toxic int").withColumn("text", F.lit("z"))
    model = toxicity.fit_toxicity(docs, labels, epochs=3)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901, 903)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 902}) == 1
    assert toxicity.score_toxicity(docs.filter("false"), model).count() == 0
    for value, at in ((None, toxicity.THRESHOLD), (0, 0.0), (1, 1.0)):
        one = toxicity.fit_toxicity(docs, labels.filter("false") if value is None else labels.filter(F.col("toxic") == value))
        assert all(r["score"] == pytest.approx(at, abs=1e-6) for r in toxicity.score_toxicity(docs.limit(20), one).collect())


def test_query_learns_only_from_its_part(spark, sf):
    got = queries.QUERIES["op13_toxicity"](spark, sf).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    import zlib

    assert {r["doc_id"] for r in got} == docs and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in got)
