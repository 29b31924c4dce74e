import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cases import DOCS, SCHEMA, docs, labels, read, texts
from netsift.llm import factorization, labelled, line_dedup, string_kernel
from netsift.llm.common import materialize


def _brute_lines(rows, noise=line_dedup.NOISE, guarantee=line_dedup.GUARANTEE):
    """The contract of the operator with the anchors in a dictionary; rows ordered, ids unique."""
    lines = {i: t.split("\n") for i, t in rows}
    solid = {i: [k for k, line in enumerate(ls) if line.split()] for i, ls in lines.items()}
    anchors, gone = {}, defaultdict(set)
    found = [(i, g) for i, t in rows for g in line_dedup.selected(t, noise, guarantee)]
    for i, g in found:
        anchors.setdefault(g[0], (i, g[1]))
    for i, (gram, line, _, before, after, *_) in found:
        a, at = anchors[gram]
        if (a, at) == (i, line):
            continue
        x, y = solid[a].index(at), solid[i].index(line)
        left = right = 0
        while left < min(len(before), x, y) and lines[a][solid[a][x - left - 1]] == lines[i][solid[i][y - left - 1]]:
            left += 1
        while right < len(after) and x + right < len(solid[a]) and lines[a][solid[a][x + right]] == lines[i][solid[i][y + right]]:
            right += 1
        gone[i].update(range(solid[i][y - left], solid[i][y + right - 1] + 1))
    return {i: "\n".join(line for k, line in enumerate(ls) if k not in gone[i]) for i, ls in lines.items()}


def test_line_runs_are_those_of_brute_force(spark, sf):
    rows = texts(sf)
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == _brute_lines(rows)
    assert {line for t in got.values() for line in t.split("\n") if line.split()} == {line for _, t in rows for line in t.split("\n") if line.split()}


def test_every_shared_run_with_the_guaranteed_words_is_found(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n))
    shared = [[line(rng.randint(1, 60)) for _ in range(rng.randint(1, 12))] for _ in range(12)]
    shared = [s for s in shared if sum(len(x.split()) for x in s) >= line_dedup.GUARANTEE]
    rows = []
    for i in range(60):
        body = [line(rng.randint(1, 20)) for _ in range(4)] + ["", " "]
        at = rng.randrange(len(body))
        rows.append((i, "\n".join(body[:at] + shared[i % len(shared)] + body[at:]), "en", "a", 1))
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        passage = "\n".join(shared[i % len(shared)])
        assert (passage in got[i]) == (i < len(shared))
    unique = {i: [x for x in text.split("\n") if x.split() and x not in sum(shared, [])] for i, text, *_ in rows}
    assert all(x in got[i].split("\n") for i, xs in unique.items() for x in xs)


def _shared_runs(rows, least):
    """By document, the lines of all runs of `least` words or more that stand earlier, in the order of (doc_id, line)."""
    seen, found = set(), defaultdict(set)
    for i, text in rows:
        solid = [(k, line, len(line.split())) for k, line in enumerate(text.split("\n")) if line.split()]
        for a in range(len(solid)):
            for b in range(a + 1, len(solid) + 1):
                if sum(n for _, _, n in solid[a:b]) >= least:
                    run = tuple(line for _, line, _ in solid[a:b])
                    found[i].update(k for k, _, _ in solid[a:b]) if run in seen else seen.add(run)
    return found


def _left_of(spark, rows):
    got = line_dedup.without_repeats(docs(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
    return {r["doc_id"]: r["text"].split("\n") for r in got}


def test_repeats_at_the_end_and_around_a_common_line_are_found(spark):
    rng = random.Random(21)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    footer, common, mate = [line(20), line(13)], line(20), line(12)
    ends = [(i, "\n".join([line(12), line(12), line(60), *footer])) for i in range(6)]
    left = _left_of(spark, ends)
    assert [len(left[i]) for i in range(6)] == [5, 3, 3, 3, 3, 3]
    around = [(0, "\n".join([line(14), common, line(14)])), *((i, "\n".join([line(14), common, mate, line(14)])) for i in (1, 2)), (3, "\n".join([line(14), mate, common, line(14)]))]
    left = _left_of(spark, around)
    assert mate in left[1] and mate not in left[2] and mate in left[3]


def test_all_runs_of_an_enumeration_are_removed(spark):
    rng = random.Random(22)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    pool = [line(rng.choice([1, 3, 7, 10, 12, 15, 17, 20, 31, 33, 50])) for _ in range(14)]
    rows = []
    for i in range(150):
        body = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(pool))
            body += pool[at:at + rng.randint(1, 5)] + [line(rng.randint(1, 20)) for _ in range(rng.randint(0, 2))]
        rows.append((i, "\n".join(body)))
    left = _left_of(spark, rows)
    whole, noise = _shared_runs(rows, line_dedup.GUARANTEE), _shared_runs(rows, line_dedup.NOISE)
    for i, text in rows:
        lines = text.split("\n")
        must = [x for k, x in enumerate(lines) if k not in whole[i]]
        may = [x for k, x in enumerate(lines) if k not in noise[i]]
        inside = lambda few, many: all(x in it for it in [iter(many)] for x in few)
        assert inside([x for x in left[i] if x], must) and inside(may, left[i]), i


def test_line_dedup_of_awkward_rows(spark):
    got = line_dedup.without_repeats(docs(spark))
    assert got.columns == docs(spark).columns
    key = lambda rows: sorted(str((r[0], (r[1] or "?")[:50])) for r in rows)
    assert key(got.collect()) == key(DOCS)
    twice = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8", "en", "a", 1)] * 3
    assert [r["text"] for r in line_dedup.without_repeats(docs(spark, twice)).collect()] == [twice[0][1]] * 3
    later = [(5, twice[0][1], "en", "a", 1), (None, twice[0][1] + "\nmine", "en", "a", 1)]
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs(spark, twice + later)).collect()} == {None: later[1][1], 1: "", 5: ""}
    assert line_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def _kernel(a, b, decay=string_kernel.DECAY):
    total = 0.0
    from itertools import combinations

    for x in combinations(range(len(a)), 3):
        for y in combinations(range(len(b)), 3):
            if all(a[i] == b[j] for i, j in zip(x, y)):
                total += decay ** (x[2] - x[0] + 1 + y[2] - y[0] + 1)
    return total


def test_word_scores_are_the_kernel_with_the_landmarks():
    landmarks, alphas = ["idiot", "moron", "abcab"], np.array([0.7, -0.2, 0.4])
    numbers, matrix = string_kernel._landmark_features(landmarks)
    weights = np.zeros(string_kernel.CODES**3)
    weights[numbers] = matrix @ alphas
    words = ["idiot", "i*diot", "xyz", "aabbcc", "on", "", "morons"]
    got = string_kernel.word_scores(words, weights, 0.25)
    for word, value in zip(words, got):
        norm = _kernel(word, word) ** 0.5
        want = 0.25 + sum(a * _kernel(word, l) / norm / _kernel(l, l) ** 0.5 for a, l in zip(alphas, landmarks)) if norm else 0.25
        assert value == pytest.approx(want, abs=1e-4)
    assert string_kernel._kernel(["i*diot"], numbers, matrix)[0, 0] == pytest.approx(_kernel("i*diot", "idiot") / (_kernel("i*diot", "i*diot") * _kernel("idiot", "idiot")) ** 0.5, abs=1e-5)


def _toxic_corpus(n=400):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(60)]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            body[rng.randrange(60)] = rng.choice(["grumbug", "snorfle", "wazzock"])
        out.append((" ".join(body), toxic))
    return out


def test_toxicity_tolerates_gaps_and_insertions():
    corpus = _toxic_corpus()
    machine = string_kernel.Machine(string_kernel.fit(np.array([y for _, y in corpus]), [t for t, _ in corpus]))
    score = machine.scores([t for t, _ in corpus])
    assert ((score >= 0.3) == np.array([y for _, y in corpus])).mean() > 0.98
    for text in ("you grumbug", "you g*r*u*m*b*u*g", "you grum-bug!!", "GRUMBUUG", "g r u m b u g", "x " * 5000 + "snorffle"):
        assert machine.scores([text])[0] >= 0.3, text
    assert (machine.scores(["", "  ", "a of", "a" * 5000]) < 0.3).all()


def test_toxicity_on_held_out_documents(spark, sf):
    found = string_kernel.toxicity(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).toPandas()
    known = found.merge(read("/root/testdata/sf0.01", "labels"), on="doc_id")
    held = known[known["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held["doc_id"]]).all() and len(held) > 50
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
    assert ((found["score"] >= 0.3) == found["predicted"]).all() and found["score"].between(0, 1).all()


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = factorization.quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    known = found.merge(read(sf, "labels"), on="doc_id")
    held = known[known["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert held[held["quality"] == 1]["predicted"].mean() > 0.97


def test_pairwise_interactions_are_those_of_the_double_sum():
    rng = np.random.default_rng(1)
    k = len(factorization.STATISTICS)
    inputs = factorization.HASHED + k * factorization.BINS
    machine = factorization.Machine({"edges": rng.normal(size=(k, factorization.BINS - 1)).cumsum(axis=1), "bias": np.array(0.3), "weights": rng.normal(size=inputs), "vectors": rng.normal(size=(inputs, factorization.RANK))})
    found = [factorization.described(t) for t in ("", "one two three", "a b c d e f g\nA B")]
    numbers, values, starts = machine.inputs(found)
    got, _ = machine.raw(numbers, values, starts)
    for i, value in enumerate(got):
        a, b = starts[i], np.append(starts, len(numbers))[i + 1]
        own, x = numbers[a:b], values[a:b]
        want = 0.3 + (machine.weights[own] * x).sum()
        want += sum(machine.vectors[own[p]] @ machine.vectors[own[q]] * x[p] * x[q] for p in range(len(own)) for q in range(p))
        assert value == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("score", [string_kernel.toxicity, factorization.quality])
def test_classifiers_on_awkward_rows_and_few_labels(spark, score):
    for known in ([], [(1, 1, 0), (None, 1, 1), (2, None, None)], [(i, i % 2, i % 2) for i in range(1, 11)] * 2):
        got = score(docs(spark), labels(spark, known)).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in DOCS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert score(spark.createDataFrame([], SCHEMA), labels(spark)).count() == 0


def test_filters_keep_columns_and_clean_rows(spark):
    none = labels(spark)
    assert string_kernel.without_toxic(docs(spark), docs(spark), none).columns == docs(spark).columns
    assert string_kernel.without_toxic(docs(spark), docs(spark), none).count() == len(DOCS)  # nothing is known to be toxic
    assert factorization.of_quality(spark.createDataFrame([], SCHEMA), docs(spark), none).count() == 0


def test_sample_is_bounded_and_keeps_out_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = labelled.sample(d, l, "toxic", labelled.fold(4) != 2, most=100).collect()
    assert 50 < len(rows) < 150
    allowed = {t for i, t in texts(sf) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(r["text"] in allowed for r in rows)


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_duplicates", "packing"]
    kept = {}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        frame = materialize(stage(spark, frame, sf), "test-stage")
        assert frame.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        kept[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert len(kept["toxicity"]) < len(texts(sf)) and len(kept["quality"]) < len(kept["toxicity"])
    assert kept["line_dedup"] == _brute_lines(sorted(kept["quality"].items()))
    assert set(kept["near_duplicates"]) <= set(kept["line_dedup"])
    last = pipeline.run(spark, sf)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == set(kept["near_duplicates"])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
