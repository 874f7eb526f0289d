"""Learned operators: held-out accuracy on the bundled tables, gradients, and defined results for odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def held_out(rows, label):
    own = [(r["predicted"], r[label]) for r in rows if r["held_out"]]
    return sum(p == t for p, t in own) / len(own)


def test_toxicity_on_held_out(tables):
    docs, labels = tables
    rows = toxicity.detect(docs, labels).join(labels, "doc_id").collect()
    assert held_out(rows, "toxic") >= 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_on_held_out(tables):
    docs, labels = tables
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert held_out(rows, "quality") >= 0.95


def test_language_on_held_out(tables):
    docs, _ = tables
    rows = language.identify(docs, rows=600, steps=80).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) >= 0.95


def test_language_of_odd_texts(spark, tables):
    docs, _ = tables
    net = language.train([b"ab", b"cd" * 90, b"", b"x"], np.array([0, 1, 0, 1]), 2, steps=2)
    means, votes = language.pooled(net, [b"", b"abc", b"x" * 200])
    assert means[0].tolist() == [0, 0] and votes.sum(axis=1).tolist() == [0, 3, 200]
    assert means[1].sum() == pytest.approx(1, abs=1e-5) and means[2].sum() == pytest.approx(1, abs=1e-5)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "", None), (4, "\u00bd \u2167 _", "fr")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(odd).collect()} == {"und"}


def test_language_gradient():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = language.Network(*(p.astype(np.float64) for p in language.fresh(3)))
    _, grad = language.gradient(net, x, y)
    for k, part in enumerate(net):
        at = np.unravel_index(np.abs(grad[k]).argmax(), part.shape)
        part[at] += 1e-3
        up, _ = language.gradient(net, x, y)
        part[at] -= 2e-3
        down, _ = language.gradient(net, x, y)
        part[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grad[k][at], rel=2e-2, abs=1e-5)


def test_quality_gradient():
    rng = np.random.default_rng(1)
    rows, starts, y = rng.random((9, quality.FEATURES)), np.array([0, 3, 4]), np.array([0.0, 1, 1])
    net = quality.train(rng.random((9, quality.FEATURES)), starts, y, steps=3)

    def loss():
        p, _ = quality.attention(net, rows, starts)
        return -np.log(np.where(y == 1, p, 1 - p)).mean()

    grad = quality.gradient(net, rows, starts, y)
    for k in range(2, len(net)):
        at = np.unravel_index(np.abs(grad[k]).argmax(), net[k].shape)
        net[k][at] += 1e-5
        up = loss()
        net[k][at] -= 2e-5
        down = loss()
        net[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[k][at], rel=1e-3, abs=1e-7)


def test_attention_weights_sum_to_one():
    rows, starts = quality.describe([b"", b"some words here. " * 100, b"x"])
    net = quality.train(rows.astype(float), starts, np.array([0.0, 1, 0]), steps=5)
    _, weight = quality.attention(net, rows, starts)
    assert np.add.reduceat(weight, starts).tolist() == pytest.approx([1, 1, 1])


def test_same_labels_give_a_constant(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, labels).collect()} == {1.0}
    assert {r["score"] for r in toxicity.detect(docs, labels).collect()} == {0.0}


def test_folding_finds_disguises():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " lowei": 3.0}, frozenset({" idiot savant "}))
    matcher = toxicity.Matcher(lexicon)
    total = lambda text: matcher.total(toxicity.fold(text))
    assert total("You 1d10t!") == (5.0, 1)
    assert total("an іdіоt (Cyrillic)") == (5.0, 1)
    assert total("ＩＤＩＯＴ") == (5.0, 1)
    assert total("idiots") == (0, 0)
    assert total("an idiot savant") == (0, 0)
    assert total("Loweischaft und loweint") == (6.0, 2)
    assert total("") == (0, 0)


def test_longest_sufficient_entry_stays():
    assert toxicity.evidence(17, 0, 450, 3500) > toxicity.EVIDENCE > toxicity.evidence(4, 0, 450, 3500)
    rows = [(" path", 90, 0), (" pathet", 90, 0), (" pathetic ", 90, 0), (" lowe", 80, 0), (" lowein ", 20, 0), (" rare ", 1, 0), (" common ", 50, 50)]
    assert set(toxicity.choose(rows, 100, 100)) == {" pathetic ", " lowe"}


def plain_toxicity(model, text):
    """The score by a search for every entry at every place of the folded text."""
    folded, best = toxicity.fold(text), {}
    for entry, weight in model.lexicon.weights.items():
        for at in range(len(folded)):
            if folded[at : at + len(entry)] == entry:
                best[at] = max(best.get(at, 0), weight)
    words, starts = folded.split(), [i for i in range(len(folded) - 1) if folded[i] == " " and folded[i + 1] != " "]
    total = hits = 0
    for k, at in enumerate(starts):
        near = {f" {words[k]} {words[k + 1] if k + 1 < len(words) else ''} ", f" {words[k - 1] if k else ''} {words[k]} " if k else f" {words[k]} "}
        if at in best and not near & model.lexicon.exceptions:
            total, hits = total + best[at], hits + 1
    return 1 / (1 + np.exp(-np.dot(toxicity.signals(total, hits, len(words)), model.coefficients))), hits


def test_toxicity_equals_plain_search(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    assert len(model.lexicon.weights) > 5
    own = docs.orderBy("n_chars").limit(250).unionByName(docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi").limit(40))
    own = own.unionByName(spark.createDataFrame([(-1, "a - b   c!! | $  idiot -- no.", None, None, 0), (-2, "", None, None, 0), (-3, None, None, None, 0)], own.schema))
    for r in toxicity.score(own, model).collect():
        assert (r["toxicity"], r["n_matches"]) == pytest.approx(plain_toxicity(model, r["text"] or ""), abs=1e-9)


def plain_gru(net, data, way):
    """States of one direction over bytes, one position after the other."""
    h, out = np.zeros(language.STATE), []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for byte in data if way == 0 else data[::-1]:
        z = sigmoid(net.inputs[way][0][byte] + h @ net.states[way][0])
        r = sigmoid(net.inputs[way][1][byte] + h @ net.states[way][1])
        n = np.tanh(net.inputs[way][2][byte] + r * (h @ net.states[way][2]))
        h = n + z * (h - n)
        out.append(h)
    return out if way == 0 else out[::-1]


def test_language_equals_plain_loops():
    texts = [b"Short one", b"", b"The long text goes on and on. " * 30, b"y" * language.WINDOW, bytes(range(1, 250)) * 2]
    net = language.train(texts, np.array([0, 1, 2, 0, 1]), 3, steps=5)
    means, votes = language.pooled(net, texts)
    for k, text in enumerate(texts):
        total, seen = np.zeros(3), np.zeros(3, int)
        folded = text.lower()
        for start in range(0, len(text), language.WINDOW):
            stop = min(len(text), start + language.WINDOW)
            before, after = max(0, start - language.LEAD), min(len(text), start + language.WINDOW + language.LEAD)
            ahead = plain_gru(net, folded[before:stop], 0)[start - before :]
            behind = plain_gru(net, folded[start:after], 1)
            for a, b in zip(ahead, behind):
                scores = np.concatenate([a, b]) @ net.out + net.out_bias
                share = np.exp(scores - scores.max())
                total += share / share.sum()
                seen[share.argmax()] += 1
        assert means[k] == pytest.approx(total / max(1, len(text)), abs=1e-4)
        assert np.abs(votes[k] - seen).max() <= 1


def test_quality_equals_plain_loops():
    texts = [b"", b"Some words here, and MORE!! " * 40, b"x\ny", "ünï ".encode() * 300]
    rows, starts = quality.describe(texts)
    net = quality.train(rows.astype(float), starts, np.array([0.0, 1, 0, 1]), steps=5)
    p, weight = quality.attention(net, rows, starts)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    at = 0
    for k, text in enumerate(texts):
        passages = [text[i : i + quality.PASSAGE] for i in range(0, max(1, len(text)), quality.PASSAGE)]
        encoded, raw = [], []
        for passage in passages:
            features, _ = quality.describe([passage])
            h = np.tanh(((features[0] - net.shift) / net.scale) @ net.encode + net.encode_bias)
            encoded.append(h)
            raw.append(float((np.tanh(h @ net.what) * sigmoid(h @ net.gate)) @ net.pick))
        share = np.exp(raw) / np.exp(raw).sum()
        assert weight[at : at + len(share)] == pytest.approx(share, abs=2e-3)
        assert p[k] == pytest.approx(sigmoid(sum(s * h for s, h in zip(share, encoded)) @ net.score + net.score_bias[0]), abs=2e-3)
        at += len(share)
    assert at == len(weight)


def test_models_agree_between_runs(spark, tables):
    """Rows in another order and repeated ids with other texts and labels give the same model."""
    docs, labels = tables
    docs, labels = docs.limit(300), labels.limit(200)
    docs = docs.unionByName(docs.limit(40).withColumn("text", F.concat(F.lit("zz "), "text")))
    labels = labels.unionByName(labels.limit(30).withColumns({"toxic": 1 - F.col("toxic"), "quality": 1 - F.col("quality")}))
    for run in (lambda d, x: toxicity.detect(d, x), lambda d, x: quality.classify(d, x), lambda d, _: language.identify(d, steps=5)):
        first, again = (sorted(run(d, x).collect(), key=str) for d, x in ((docs, labels), (docs.repartition(7), labels.repartition(5))))
        pairs = [(r["doc_id"], r["held_out"], r["score"]) for r in first], [(r["doc_id"], r["held_out"], r["score"]) for r in again]
        for a, b in zip(sorted(pairs[0]), sorted(pairs[1]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)


def test_repeated_passages_of_any_length_and_clashing_columns(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, "word " * 60000, "x"), (None, None, "y"), (2, "", "z"), (2, "", "z")], "doc_id long, text string, score string")
    odd = odd.withColumns({c: F.lit("mine") for c in ("held_out", "predicted", "toxicity", "n_matches", "quality_score", "best_passage", "label", "lang", "half")})
    for found in (toxicity.detect(odd, labels), quality.classify(odd, labels), language.identify(odd, steps=2)):
        rows = found.collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
