import numpy as np
import odd
import pytest
from pyspark.sql import functions as F
from slicewise.llm.factorisation import FACTORS, Machine, fit_quality, loss_gradient, score_quality, train
from slicewise.llm import toxicity, words
from slicewise.llm.features import STATISTICS, is_held_out, labelled_sample, seeded_rows, word_marks
from slicewise.llm.queries import op4_quality, op6_toxicity
from slicewise.llm.tables import read
from slicewise.llm.toxicity import entries, fit_toxicity, nn_risk, score_toxicity, train_nnpu, without_toxic

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    size = 60
    m = Machine(0.3, rng.normal(size=size), rng.normal(size=(size, FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    index, value = rng.choice(size, 12, replace=False), rng.normal(size=12)
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i in range(12) for j in range(i))
    assert m.logit(index, value) == pytest.approx(0.3 + m.weights[index] @ value + pairs)
    many = [(index[:k], value[:k]) for k in (1, 5, 12)]
    assert m.logits(many) == pytest.approx([m.logit(*x) for x in many]) and len(m.logits([])) == 0


def by_pairs(m, index, value):
    """A machine's logit by its definition: every pair of inputs."""
    own = m.factors[index] * np.asarray(value, np.float64)[:, None]
    return m.bias + m.weights[index] @ value + np.triu(own @ own.T, 1).sum()


def test_gradient_against_differences():
    rng = np.random.default_rng(9)
    size = 9
    m = Machine(0.2, rng.normal(size=size), rng.normal(size=(size, FACTORS)), np.zeros(0), np.ones(0))
    inputs = [(rng.choice(size, n, replace=False), rng.normal(size=n)) for n in (1, 4, 7, 3)]
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = np.array([by_pairs(m, *x) for x in inputs])
        return np.mean(np.log(1 + np.exp(np.where(y > 0, -z, z))))

    value, grad, bias_grad = loss_gradient(m, inputs, y)
    assert value == pytest.approx(loss())

    def slope(array, at):
        array[at] += 1e-6
        up = loss()
        array[at] -= 2e-6
        down = loss()
        array[at] += 1e-6
        return (up - down) / 2e-6

    for i in range(size):
        assert grad[i, 0] == pytest.approx(slope(m.weights, i), abs=1e-7)
        for f in range(FACTORS):
            assert grad[i, 1 + f] == pytest.approx(slope(m.factors, (i, f)), abs=1e-7)
    m.bias += 1e-6
    up = loss()
    m.bias -= 2e-6
    assert bias_grad == pytest.approx((up - loss()) / 2e-6, abs=1e-7)


def test_quality_query_against_pair_sums(spark):
    """Every score of op4 on the smallest tables, with the learned machine, by the definition."""
    small = "/root/testdata/sf0.001"
    docs = read(spark, small, "documents")
    machine = fit_quality(docs, read(spark, small, "labels"))
    want = {}
    for r in docs.collect():
        text = np.frombuffer((r.text or "").encode(), np.uint8)
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(by_pairs(machine, *machine.inputs(text, r.n_chars)), -30, 30)))
    got = op4_quality(spark, small).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == (r.score >= 0.3) and r.held_out == is_held_out(r.doc_id) for r in got)


def test_toxicity_query_against_sums_of_marks(spark):
    """Every score of op6 on the smallest tables, with the learned weights, mark by mark."""
    small = "/root/testdata/sf0.001"
    docs = read(spark, small, "documents")
    model = fit_toxicity(docs, read(spark, small, "labels"))
    weight = dict(zip(model.marks.tolist(), model.weights.tolist(), strict=True))
    want = {r.doc_id: 1 / (1 + np.exp(-(model.bias + sum(weight.get(m, 0.0) for m in word_marks(np.frombuffer((r.text or "").encode(), np.uint8)).tolist())))) for r in docs.collect()}
    got = op6_toxicity(spark, small).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.5) and r.held_out == is_held_out(r.doc_id) for r in got)


def test_machine_learns_an_interaction():
    """The label is whether exactly one of two words is there, which no linear score can tell."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([5] * a + [9] * b + [11], np.int32), np.ones(a + b + 1, np.float32), np.zeros(len(STATISTICS)), int(a != b)))
    m = train(rows, epochs=150, rate=0.2)
    right = [(m.logit(*m.placed(*r[:3])) > 0) == bool(r[3]) for r in rows]
    assert np.mean(right) > 0.95


def test_word_marks(monkeypatch):
    marks = lambda text: set(word_marks(np.frombuffer(text.encode(), np.uint8)).tolist())
    one, same, other = marks("abcdxyz"), marks("abcdxyz, ABCDXYZ!"), marks("abcdxyz abcdqrs")
    assert one == same and len(one) == 1 + 4  # the word and its first 3 to 6 bytes
    assert len(other) == 2 + (2 + 2 * 2) + 2  # two words, beginnings both shared and not, and the marks of two shared ones
    assert marks("") == set() == marks(" -- ")
    long = " ".join(f"word{i}" for i in range(500))
    whole = marks(long)
    monkeypatch.setattr(words, "PIECE", 64)
    assert len(whole - marks(long)) < 150  # only words at the pieces' ends differ


def test_word_marks_at_a_cut(monkeypatch):
    """A text cut into pieces has the marks of the whole text, wherever a cut falls."""
    texts = [np.frombuffer(t.encode(), np.uint8) for t in (" ".join(f"word{i}" for i in range(500)), "x " * 20 + "longword" * 40 + " end", "-" * 300, "größe " * 60)]
    whole = [word_marks(t) for t in texts]
    for piece in (16, 17, 31, 64):
        monkeypatch.setattr(words, "PIECE", piece)
        assert all((word_marks(t) == w).all() for t, w in zip(texts, whole, strict=True))


def test_seeded_rows(spark):
    ids = spark.range(5000).select("id")
    found = [sorted(r.id for r in seeded_rows(x, 50, 3).collect()) for x in (ids, ids.repartition(7))]
    assert found[0] == found[1] and len(set(found[0])) == 50
    assert seeded_rows(ids.where("id < 20"), 50, 3).count() == 20
    repeated = spark.range(5000).select((F.col("id") % 3).alias("id"))
    assert all(seeded_rows(repeated, 50, seed).count() == 50 for seed in range(4))
    assert seeded_rows(ids.limit(0), 50, 3).count() == 0


def test_risk_is_kept_from_falling_below_zero():
    """With few positives the correction keeps the classifier from calling every unlabelled text clean."""
    rng = np.random.default_rng(3)
    text = lambda toxic: np.array(sorted({0} & {0 if toxic else 1} | set(rng.integers(2, 40, 6).tolist())))
    positive, hidden, clean = [text(True) for _ in range(200)], [text(True) for _ in range(300)], [text(False) for _ in range(2700)]
    weights, bias = train_nnpu(positive, hidden + clean, 40, prior=0.1)
    score = lambda t: bias + weights[t].sum()
    assert np.mean([score(t) > 0 for t in hidden]) > 0.9 and np.mean([score(t) > 0 for t in clean]) < 0.05
    assert train_nnpu([], clean, 40, 0.1)[0].sum() == 0


def test_risk_against_its_formula():
    """The risk and its gradient against sums over texts and differences, on both sides of zero."""
    rng = np.random.default_rng(4)
    positive = [np.array(x) for x in ([0, 1], [1], [0, 2, 3])]
    unlabelled = [np.array(x, np.int64) for x in ([], [3], [0, 1, 2], [2, 3])]
    loss = lambda z: np.log(1 + np.exp(-z))
    sides = set()
    for prior in (0.1, 0.9):
        for _ in range(20):
            theta = rng.normal(0, 2, 5)

            def formula(theta, prior=prior):
                g = lambda texts: [theta[-1] + sum(theta[m] for m in t) for t in texts]
                mean = lambda texts, sign: sum(loss(sign * z) for z in g(texts)) / len(texts)
                return prior * mean(positive, 1), mean(unlabelled, -1) - prior * mean(positive, -1)

            first, second = formula(theta)
            value, direction = nn_risk(theta, entries(positive), entries(unlabelled), prior)
            assert value == pytest.approx(first + max(0, second))
            sides.add(second >= 0)
            for i in range(5):
                step = np.eye(5)[i] * 1e-6
                up, down = formula(theta + step), formula(theta - step)
                slope = [(a - b) / 2e-6 for a, b in zip(up, down, strict=True)]
                assert direction[i] == pytest.approx(sum(slope) if second >= 0 else -slope[1], abs=1e-5)
    assert sides == {True, False}


def held_out_scores(spark, label, fit, score):
    docs, labels = read(spark, LARGE, "documents"), read(spark, LARGE, "labels")
    out = score(docs, fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(is_held_out(r["doc_id"]) for r in out)
    return [r for r in out if r[label]], [r for r in out if not r[label]]


def test_held_out_quality(spark):
    """Of a good and a bad text that it didn't learn from the good one scores higher, and few are called wrong."""
    good, bad = held_out_scores(spark, "quality", fit_quality, score_quality)
    assert min(len(good), len(bad)) > 100
    area = np.mean([(g["score"] > b["score"]) + (g["score"] == b["score"]) / 2 for g in good for b in bad])
    assert area >= 0.98
    assert np.mean([r["predicted"] for r in good]) >= 0.95 and np.mean([r["predicted"] for r in bad]) <= 0.05


def test_held_out_toxicity(spark):
    toxic, clean = held_out_scores(spark, "toxic", fit_toxicity, score_toxicity)
    assert len(toxic) > 80
    assert np.mean([r["predicted"] for r in toxic]) >= 0.88 and np.mean([r["predicted"] for r in clean]) <= 0.01


def test_samples_are_bounded_in_rows(spark):
    """Each document stands 40 times under its id, and one id holds a third of the rows: what is collected stays within the bound."""
    docs = spark.range(8000).selectExpr("if(id % 3 = 0, 1, id % 200) AS doc_id", "concat('text ', id) AS text", "10L AS n_chars")
    labels = spark.range(200).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(id % 2) AS toxic")
    for rows in (100, 37):
        sample = labelled_sample(docs, labels, "quality", rows).collect()
        assert len(sample) == len({r["id"] for r in sample}) == rows
    few = labelled_sample(docs, labels.unionByName(labels), "quality", 100).collect()
    assert len(few) == 100 and all(r["label"] == r["id"] % 2 for r in few)
    seen = []
    real = toxicity.train_nnpu
    toxicity.train_nnpu = lambda positive, unlabelled, *rest: (seen.append((len(positive), len(unlabelled))), real(positive, unlabelled, *rest))[1]
    try:
        fit_toxicity(docs, labels, positives=30, unlabelled=50)
    finally:
        toxicity.train_nnpu = real
    assert seen[0][0] == 30 and 0 < seen[0][1] <= 50


@pytest.mark.parametrize("fit,score", [(fit_quality, score_quality), (fit_toxicity, score_toxicity)])
def test_odd_documents(spark, fit, score):
    docs = odd.docs(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(1, 18)] + [(1, None, None, "x"), (None, 1, 1, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    for own in (labels, labels.limit(0)):  # without labels there is still a score
        out = score(docs, fit(docs, own)).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in odd.rows())
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in out)
    # held-out labels change nothing
    flipped = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    same = [sorted(str(r) for r in score(docs, fit(docs, x)).collect()) for x in (labels, flipped)]
    assert same[0] == same[1]
    assert score(odd.empty(spark), fit(odd.empty(spark), labels)).count() == 0


def test_logits_of_a_batch():
    """Texts with and without marks, empty ones among them, and no text."""
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ("alpha beta", "", "gamma", "beta beta")]
    marks = np.sort(np.unique(np.concatenate([word_marks(t) for t in texts])))
    model = toxicity.Classifier(marks, np.arange(1.0, len(marks) + 1), -2.0)
    want = [-2.0 + sum(model.weights[k] for k, m in enumerate(marks) if m in set(word_marks(t))) for t in texts]
    assert model.logits(texts).tolist() == want and want[1] == -2.0
    assert len(model.logits([])) == 0 and toxicity.Classifier(marks[:0], np.zeros(0), 0.5).logits(texts).tolist() == [0.5] * 4


def test_without_toxic(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = fit_toxicity(docs, labels)
    kept = {r.doc_id for r in without_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in score_toxicity(docs, model).where("predicted = 0").collect()}
    odd_docs = odd.docs(spark)
    assert without_toxic(odd_docs, model).columns == odd_docs.columns
