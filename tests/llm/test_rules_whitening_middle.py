"""Quality rules, whitening and fill-in-middle against plain versions, with their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import queries
from fieldloom.llm.fill_middle import fill_in_middle, restored
from fieldloom.llm.ngram_quality import Model, base_counts, calibrated, grams, quality_rules
from fieldloom.llm.whitening import centred, squares, whiten

SCHEMA = "doc_id long, text string, id long, label double, n long, form string, output string, margin double, weight double, part int, fim_id long, score double"
GOOD = "the river runs past the old mill and the children watch boats drift under a stone bridge while evening light fades over quiet fields".split()
BAD = "win $$$ now &&& click | here ### free %%% cash *** deal !!! offer <<< best >>> price".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, 0.5, 6, "x", "y", 0.1, 0.2, 3, 7, 0.3) for i, t in rows], SCHEMA)


# -- fill-in-middle


def plain_middle(i, text, sentinels=("<P>", "<S>", "<M>"), seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in sentinels):
        return (i, len(units), "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    x, y, z = sentinels
    spm = h4 % 100 < 50
    return (i, len(units), "spm" if spm else "psm", len(p), len(m), y + s + x + p + z + m if spm else x + p + y + s + z + m)


def test_fill_in_middle(spark):
    rng = random.Random(5)
    pieces = ["a", "\n", "é", "\U0001d11e", "$1", "\\2", "<", "P>", " ", "\r", " ", "\x85", "<P", "\x00"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "a<S>b\n"), (203, "\n" * 150_000 + "x" * 200_000), (204, ("line of text\n" * 60_000) + "end"), (None, "no id\nat all"), (5, "twice\nan id"), (5, "twice\nan id")]
    out = fill_in_middle(docs(spark, rows)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((*plain_middle(i, t), t or "") for i, t in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs(spark, [])).count() == 0


def test_fill_in_middle_rates_and_sentinels(spark):
    rows = [(i, f"one {i}\ntwo\nthree") for i in range(300)]
    assert {r.form for r in fill_in_middle(docs(spark, rows), rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(docs(spark, rows), spm_rate=100).collect()} == {"spm"}
    marks = ("$<pre>", "\\<suf>", "|<mid>")
    out = fill_in_middle(docs(spark, rows), sentinels=marks, unit=r"\w+|\W+", seed=9)
    assert [r.t for r in out.select("doc_id", restored(F.col("output"), F.col("form"), marks).alias("t")).orderBy("doc_id").collect()] == [t for _, t in rows]
    for wrong in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "x", "y"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(docs(spark, rows), sentinels=wrong)


# -- whitening

WIDTH = 5
TABLE = "vec_id long, embedding array<float>, label int, x array<long>, id long, v string, n long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], 2, "v", 3, 4) for i, v in rows], TABLE)


def plain_whitening(rows, k):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) / n**3 for b in range(d)] for a in range(d)])
    e, basis = np.linalg.eigh(cov)
    e, basis = e[::-1], basis[:, ::-1]
    out = {}
    for i, x in kept:
        y = [n * c - s for c, s in zip(x, sums)]
        for c in range(min(k, d)):
            out[i, c + 1] = (n, sum(v * v for v in y), float(np.dot([v / n for v in y], basis[:, c]) / math.sqrt(e[c])), e[c] / e.sum())
    return out


def test_whitening_against_a_plain_version(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1 + j) for j in range(WIDTH)] for _ in range(60)]
    rows = list(enumerate(base)) + [(100 + i, base[3]) for i in range(40)]
    broken = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * WIDTH), (203, [float("inf")] + [0.0] * 4), (204, []), (205, [1.0, 2.0]), (206, [3e38] * WIDTH)]
    for k in (3, 16):
        got = {(r.vec_id, r.component): r for r in whiten(table(spark, rows + broken).repartition(5), k).collect()}
        want = plain_whitening(rows, k)
        assert got.keys() == want.keys()
        signs = {c: 1 if got[0, c].whitened * want[0, c][2] > 0 else -1 for c in range(1, min(k, WIDTH) + 1)}
        for key, (n, deviation, whitened, explained) in want.items():
            r = got[key]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert math.isclose(r.whitened, signs[key[1]] * whitened, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.explained, explained, rel_tol=1e-12)
        assert {r.identity_error for r in got.values()} == {got[0, 1].identity_error} and got[0, 1].identity_error < 1e-9


def test_whitening_of_few_vectors_and_none(spark):
    assert whiten(table(spark, [])).count() == 0 and whiten(table(spark, [(1, None)])).count() == 0
    one = whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in one)
    two = whiten(table(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])])).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in two] == [False, True, True] * 2 and math.isclose(abs(two[0].whitened), 1.0) and math.isclose(two[0].explained, 1.0)


def test_squares_are_exact_at_every_size():
    rng = random.Random(1)
    for bits in (5, 20, 31, 45, 61):
        u = np.array([[rng.randrange(-(2**bits), 2**bits) for _ in range(7)] for _ in range(50)])
        for axis in (0, 1):
            for values in (u, u.astype(object)):
                high, low = squares(values, axis)
                want = [sum(int(v) ** 2 for v in line) for line in (u.T if axis == 0 else u)]
                assert [int(h) * 10**18 + int(v) for h, v in zip(high, low)] == want
    x = np.array([[2**60, 5], [0, 7]])
    y = centred(x, 10**9, np.array([3, 6]), np.array([1, 2]))
    assert y.tolist() == [[10**9 * (2**60 - 3) - 1, -(10**9) - 2], [-3 * 10**9 - 1, 10**9 - 2]]


# -- quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def encoded(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_counts_against_a_plain_version():
    rng = random.Random(4)
    pieces = ["a", "b", "a b a b a b a b", "é", "\n", "\n", " ", " ", "\t", "\r", "\x0b", "#", "<|", "\U0001d11e", " ", "line again\n", "\xa0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", "\n", "\n\n", "x", "x\nx", "x\nx\n", " x\nx", "a\r\na\r\na", "one " * 8, "one " * 9, ("w%d " * 8) % tuple(range(8)) * 2, "no end\nno end"]
    texts += [" ".join(f"w{i * i % 97}" for i in range(20_000)), ""]
    for part in (texts, texts[::-1], [""], []):
        assert base_counts(*encoded(part)).tolist() == [plain_counts(t) for t in part]


def test_grams_and_margins_do_not_depend_on_neighbours():
    texts = ["", "a", "ab cd", "éàü ça", "x" * 50, "ab cd"]
    model = Model(np.random.default_rng(0).normal(size=1 << 17), -0.3)
    together = model.margins(*encoded(texts))
    assert np.allclose(together, [model.margins(*encoded([t]))[0] for t in texts], atol=1e-12) and together[0] == -0.3
    (words, doc), (chars, at) = grams(*encoded(texts))
    assert np.bincount(doc, minlength=6).tolist() == [0, 1, 3, 3, 1, 3] and np.bincount(at, minlength=6).tolist() == [0, 1, 12, 15, 147, 12]


def test_calibration_gives_the_share_of_each_score():
    rng = np.random.default_rng(3)
    margin = rng.normal(0, 2, 20_000)
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * margin + 1)))).astype(float)
    slope, shift = calibrated(margin, label, np.ones(20_000))
    assert abs(slope - 0.5) < 0.05 and abs(shift - 1) < 0.08
    half = (label == 0) & (rng.random(20_000) < 0.5)  # half of label 0 is sampled, so each row of it stands for two
    keep = (label == 1) | half
    slope, shift = calibrated(margin[keep], label[keep], np.where(label[keep] == 1, 1.0, 2.0))
    assert abs(slope - 0.5) < 0.05 and abs(shift - 1) < 0.1
    assert calibrated(np.zeros(3), np.ones(3), np.ones(3)) == (1.0, 0.0) and calibrated(np.zeros(0), np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_quality_rules(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choice(GOOD) for _ in range(40))) for i in range(160)]
    bad = [(200 + i, " ".join(rng.choice(BAD) for _ in range(40))) for i in range(80)]
    odd = [(500, None), (501, ""), (502, " \n\t"), (503, "too few words"), (504, "the same eight words again and again here " * 10), (505, " ".join(GOOD * 3_000)), (None, " ".join(GOOD)), (7, good[7][1])]
    rows = good + bad + odd
    marks = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (500, None), (501, 0), (503, 1), (503, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = quality_rules(docs(spark, rows).repartition(3), labels, rows=100)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert len(got) == len(rows)
    for i, *counts, failed, kept, score, held in got:
        text = next(t for j, t in rows if j == i)
        assert counts == plain_counts(text) and 0 <= score <= 1
        assert failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and kept == (not failed and score >= 0.5)
        if i is not None and (i < 160 or 200 <= i < 280):
            assert kept == (i < 160)
    assert got == sorted((tuple(r) for r in quality_rules(docs(spark, rows).repartition(2), labels, rows=100).select(*out.columns).collect()), key=repr) or all(
        abs(a[8] - b[8]) < 1e-6 for a, b in zip(got, sorted((tuple(r) for r in out.collect()), key=repr))
    )
    assert quality_rules(docs(spark, []), labels).count() == 0
    one_kind = quality_rules(docs(spark, rows[:5]), labels.filter("quality = 1"))
    assert {r.score for r in one_kind.collect()} == {0.5}


def test_the_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = queries.QUERIES["op11_ngram_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert queries.QUERIES["op13_fill_in_middle"](spark, sf).filter("restored_sha256 is null").count() == 0
    held = out.filter("held_out and not base_failed").toPandas()
    assert queries.QUERIES["op12_whitening"](spark, sf).filter("deviation is null or identity_error > 1e-4").count() == 0
    assert n == queries.QUERIES["op13_fill_in_middle"](spark, sf).count()
    assert (held.kept == (held.quality == 1)).mean() > 0.8


def test_held_out_rows_are_ranked_by_their_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op11_ngram_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = out.filter("held_out and not base_failed").toPandas()
    good, bad = (held.score[held.quality == q].values for q in (1, 0))
    assert len(bad) > 5 and (good[:, None] > bad[None]).mean() > 0.97
    assert (held.kept == (held.quality == 1)).mean() > 0.9  # with some forty rows of label 0 to learn from
