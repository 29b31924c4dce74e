"""Whitening against plain eigenvectors, line rules and resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import line_rules, queries, resampling, whitening

VECTORS = [
    (1, [0.1, 0.2, 0.3], "x"), (1, [0.1, 0.2, 0.3], "x"), (2, [0.5, -0.25, 0.0], "y"), (3, None, "x"), (4, [0.1, None, 0.3], "x"), (5, [float("nan"), 0.0, 0.0], "x"),
    (6, [float("inf"), 0.0, 0.0], "x"), (7, [], "x"), (None, [-0.7, 0.9, 0.05], None), (8, [0.3, 0.3, 0.3], "x"), (9, [-0.0, 0.0009, -0.0009], "x"),
]


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, w string" + more)


def plain_whitening(rows, k):
    x = np.floor(1024 * np.array(rows, np.float64)) + 100_000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    whole = x.astype(np.int64).astype(object)
    far = whole * n - whole.sum(axis=0)
    return (far * far).sum(axis=1), centred @ vecs / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_of_the_table(spark, sf):
    frame = cases.read(sf, "embeddings")
    want_far, want, shares = plain_whitening(np.stack(frame["embedding"]).astype(np.float64), 8)
    got = queries.QUERIES["op11_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(frame) and set(got["n"]) == {len(frame)} and got["identity_error"].nunique() == 1
    assert got["identity_error"].iloc[0] < 1e-10
    order = np.argsort(frame["vec_id"].to_numpy())
    w = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(np.abs(w) - np.abs(want[order])).max() < 1e-8
    assert np.abs(np.abs((w * want[order]).sum(axis=0)) / (want ** 2).sum(axis=0) - 1).max() < 1e-9  # one sign for a component
    assert got["deviation"].to_numpy()[::8].tolist() == want_far[order].tolist()
    assert np.allclose(got["explained"].to_numpy()[:8], shares, rtol=1e-9)


def test_whitening_edges(spark):
    got = whitening.whitened(vectors(spark, VECTORS), components=8).toPandas()
    part = [r for r in VECTORS if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    assert len(got) == 3 * len(part) and got["vec_id"].isna().sum() == 3 and (got["vec_id"] == 1).sum() == 6
    far, want, _ = plain_whitening([r[1] for r in part], 3)
    assert sorted(int(v) for v in got["deviation"]) == sorted(int(v) for v in np.repeat(far, 3))
    assert np.allclose(sorted(got["whitened"].abs()), sorted(np.abs(want).ravel()), atol=1e-9)
    assert whitening.whitened(vectors(spark, [])).count() == 0
    one = whitening.whitened(vectors(spark, [(1, [0.5, 0.5], "x")])).toPandas()
    assert len(one) == 2 and one["whitened"].isna().all() and (one["deviation"] == 0).all() and one["identity_error"].isna().all()
    flat = whitening.whitened(vectors(spark, [(i, [0.5, i / 7], "x") for i in range(9)])).toPandas()  # a constant dimension
    assert flat[flat["component"] == 2]["whitened"].isna().all() and flat["identity_error"].iloc[0] < 1e-12
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(vectors(spark, [(1, [1e300], "x")]))
    with pytest.raises(Exception, match="entries"):
        whitening.whitened(vectors(spark, [(1, [1.0], "x"), (2, [1.0, 2.0], "x")]))


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(i, [1e10 * math.sin(i), 1e11 * math.cos(3 * i)], "x") for i in range(40)]
    got = whitening.whitened(vectors(spark, rows)).toPandas().sort_values(["vec_id", "component"])
    far, want, _ = plain_whitening([r[1] for r in rows], 2)
    assert [int(v) for v in got["deviation"][::2]] == [int(v) for v in far]
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 2)), np.abs(want), rtol=1e-7) and got["identity_error"].iloc[0] < 1e-10


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), np.array([5.0] * 10 + [3.0] * 10 + [1.0] * 20), 1 + np.arange(40) * 1e-9, np.array([1.0, 1 + 1e-12, 1 + 1e-12, 0.5] * 10), 10.0 ** -np.arange(40), np.zeros(40)])
def test_eigenvectors_with_clusters(values):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(40, 40)))[0].astype(np.longdouble)
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    got, x = whitening.eigen(matrix)
    assert np.all(np.diff(got) <= 0) and np.allclose(got, np.sort(values)[::-1], rtol=0, atol=4e-16 * 40 * max(values.max(), 1e-300))
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15 * 8
    assert np.abs(matrix.astype(np.float64) @ x - x * got).max() <= 1e-15 * 8 * max(values.max(), 1e-300)


def test_eigenvectors_are_better_than_those_of_doubles():
    rng = np.random.default_rng(5)
    values = np.sort(1 + rng.random(24) * 1e-5)[::-1]
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):
        turn = turn @ (1.5 * np.eye(24, dtype=np.longdouble) - turn.T @ turn / 2)  # orthonormal in extended precision
    matrix = (turn * values) @ turn.T
    ours = np.abs(np.abs((turn * whitening.eigen(matrix)[1]).sum(axis=0)) - 1).max()
    apart = np.abs(np.abs(turn) - np.abs(whitening.eigen(matrix)[1])).max()
    plain = np.abs(np.abs(turn) - np.abs(np.linalg.eigh(matrix.astype(np.float64))[1][:, ::-1])).max()
    assert ours < 1e-15 and apart < 1e-11 and apart * 20 < plain


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [line for line in text.split("\n") if SPACE.search(line)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


CLEAN = "One line of plain words that ends as a sentence does.\n"
MESSY = [
    (20, CLEAN + "A second one has none of the words before it, but a comma.\n" + "Another line of words, which is different from the first.\nHome | About | Contact | Help\n", "en", "a", 1),
    (21, CLEAN + "\n".join(f"word{i} word | link{i} | text | more |" for i in range(9)), "en", "a", 1),
    (22, CLEAN + "We use cookies on this site. " * 1 + "\n" + "Plain text goes on here for a while, and then ends.\n" * 1, "en", "a", 1),
    (23, " ".join(f"w{i}!!" for i in range(30)), "en", "a", 1),
    (24, " ".join(f"w{i}$$$" for i in range(30)), "en", "a", 1),
    (25, " ".join(f"w{i}" for i in range(30)), "en", "a", 1),
    (26, "a b c d e f g h\ti j k\x0bl\r\na b c d e f g h i\r\n" + " ".join(f"w{i}" for i in range(100)) + ".", "en", "a", 1),
    (27, "same same same same same same same same same same same same same same same same same same same same same.", "en", "a", 1),
    (28, "    nbsp is a word\x85char here and\x1f so on; twenty words are needed for a text to pass its base rules here now.", "en", "a", 1),
]


def test_base_figures_against_brute_force(spark, sf):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = cases.DOCS + MESSY
    got = line_rules.judged(cases.docs(spark, rows)).collect()
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == Counter((r[0], *plain_figures(r[1])) for r in rows)
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.QUERIES["op12_line_rules"](spark, sf).collect()}
    assert got == {i: plain_figures(t) for i, t in cases.texts(sf)}
    assert line_rules.judged(cases.docs(spark, [])).count() == 0


def test_line_verdicts(spark):
    docs = cases.docs(spark, MESSY + cases.DOCS)
    kept = {r["doc_id"]: r["kept"] for r in line_rules.judged(docs).filter("doc_id >= 20").collect()}
    assert kept == {20: True, 21: False, 22: True, 23: False, 24: False, 25: False, 26: True, 27: False, 28: True}
    lost = {r["doc_id"]: r["lost_words"] for r in line_rules.judged(docs).filter("doc_id >= 20").collect()}
    assert lost == {20: 7, 21: 81, 22: 6, 23: 30, 24: 30, 25: 30, 26: 21, 27: 0, 28: 0}
    left = {r["doc_id"]: r for r in line_rules.cleaned(docs).collect()}
    assert set(left) >= {20, 22, 26, 28} and not set(left) & {21, 23, 24, 25, 27}
    assert left[20]["text"] == CLEAN + "A second one has none of the words before it, but a comma.\n" + "Another line of words, which is different from the first.\n" and left[22]["text"] == CLEAN + "Plain text goes on here for a while, and then ends.\n"
    assert left[20].asDict().keys() == set(docs.columns) and left[20]["kept"] == "x" and left[20]["lang"] == "en"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resampling(rows, target, grams=1, buckets=10_000, percent=10, least=20):
    def features(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + g]).encode()) % buckets for g in range(1, grams + 1) for i in range(len(words) - g + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    sums, totals = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sums + buckets) / ((s[b] + 1) * (totals + buckets)))) for b in s}
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = Counter()
    for place, r in enumerate(fit[:percent * len(fit) // 100], 1):
        drawn[(r[0], *r[2:], place)] += 1
    taken = Counter(fit[:percent * len(fit) // 100])
    for r in out:
        if taken[r]:
            taken[r] -= 1
        else:
            drawn[(r[0], *r[2:], None)] += 1
    return drawn


@pytest.mark.parametrize("grams,buckets,percent,least", [(1, 10_000, 10, 20), (2, 70_000, 37, 0), (1, 3, 100, 0), (1, 50, 0, 0)])
def test_resampling_against_brute_force(spark, grams, buckets, percent, least):
    rows = cases.DOCS + MESSY + [(i, f"word{i % 3} and benchmark {i % 5} words" * 5, "en", "a", 1) for i in range(100, 160)]
    target = ["benchmark words of the target, benchmark 3", None, "ÄÖ and more"]
    got = resampling.resampled(cases.docs(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, rank string"), percent, grams, buckets, least)
    assert Counter(map(tuple, got.collect())) == plain_resampling([r[:2] for r in rows], target, grams, buckets, percent, least)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(cases.docs(spark, []), none).count() == 0
    assert resampling.resampled(cases.docs(spark), none).count() == len(cases.DOCS)


def test_cutoff_among_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), None if i % 50 == 0 else int(i) % 40, int(n), i) for i, (s, n) in enumerate(zip(rng.integers(0, 4, 3000), rng.integers(0, 3, 3000)))]
    keys = spark.createDataFrame(rows, "score long, doc_id long, n_features long, row long").repartition(7)
    order = sorted((-s, resampling.LAST if d is None else d, n, r) for s, d, n, r in rows)
    for k in (1, 2, 750, 1501, 2999, 3000):
        assert resampling.cutoff(keys, k) == order[k - 1]
    same = spark.range(2000).select(F.lit(5).cast("long").alias("score"), F.lit(1).cast("long").alias("doc_id"), F.lit(9).cast("long").alias("n_features"), F.col("id").alias("row"))
    assert resampling.cutoff(same, 667) == (-5, 1, 9, 666)


def test_each_round_discards_a_quarter(spark, monkeypatch):
    left = []
    real = resampling.medians

    def counted(keys, low, high, pivot):
        found = real(keys, low, high, pivot)
        left.append(found)
        return found

    monkeypatch.setattr(resampling, "medians", counted)
    monkeypatch.setattr(resampling, "GROUP", 64)
    keys = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("score"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.col("id").alias("row"))
    resampling.cutoff(keys.repartition(5), 1234)
    sizes = [[sum(n for side, n, _ in found if side == s) for s in (0, 1)] for found in left]
    for (a, b), (c, d) in zip(sizes, sizes[1:]):
        before = c + d + 1
        assert max(c, d) <= 3 * before // 4 + 32  # an even number has two medians, and a group the smaller one
    assert len(sizes) <= math.ceil(math.log(4000, 4 / 3))
