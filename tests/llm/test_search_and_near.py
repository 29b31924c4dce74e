import itertools
import random

import numpy as np
import pytest
import xxhash

from cases import DOCS, SCHEMA, docs, texts
from netsift.llm import components, simhash, topk
from pyspark.sql import functions as F


def _brute_topk(rows, k, is_query):
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if is_query(q):
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def _topk(spark, rows, k, block=4096):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score string")
    got = topk.top_k(topk.quantised(frame), F.col("vec_id") % 5 == 0, k, block_size=block, slice_rows=7)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_top_k_with_ties_and_unusable_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    rows += [(120 + i, [0.5, 0.5, 0.5]) for i in range(60)]
    rows += [(500, None), (505, [1.0, None, 0.0]), (510, [float("nan"), 0.0, 1.0]), (515, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (520, []), (525, [9.0])]
    extended = [(*r, "x", "y") for r in rows]
    for block in (4096, 7):
        assert _topk(spark, extended, 20, block) == _brute_topk(rows, 20, lambda q: q % 5 == 0)


def test_top_k_of_few_and_no_rows(spark):
    assert _topk(spark, [(0, [1.0], "", ""), (1, [2.0], "", "")], 20) == [(0, 1, 1, 64 * 128)]
    assert _topk(spark, [(0, [1.0], "", "")], 20) == []
    assert _topk(spark, [], 20) == []


def test_top_k_of_large_numbers_is_exact(spark):
    rows = [(i, [float((i * 7919) % 1000 - 500) * 1e4, float(i) * 1e4]) for i in range(40)]
    assert _topk(spark, [(*r, "", "") for r in rows], 5) == _brute_topk(rows, 5, lambda q: q % 5 == 0)


def _brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def _brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_are_those_of_brute_force(spark, sf):
    rows = texts(sf)
    fps = [_brute_fingerprint(t) for _, t in rows]
    want = {i: (f, rows[r][0]) for (i, _), f, r in zip(rows, fps, _brute_components(fps, 4))}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    fps = [_brute_fingerprint(t) for _, t, *_ in DOCS]
    roots = _brute_components(fps, 4)
    least = {r: min((DOCS[i][0] for i in range(len(DOCS)) if roots[i] == r and DOCS[i][0] is not None), default=None) for r in roots}
    assert sorted(map(str, ((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got))) == sorted(
        map(str, ((d[0], f, least[r]) for d, f, r in zip(DOCS, fps, roots))))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_component_stays(spark):
    kept = simhash.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(str((r["doc_id"], r["text"] if r["doc_id"] is None else "")) for r in kept.collect()) == sorted(
        str(x) for x in [(1, ""), (3, ""), (6, ""), (7, ""), (8, ""), (9, ""), (None, "no id at all")])
    nobody = docs(spark, [(None, t, "en", "a", 1) for t in ("one two three four five", "ONE two three four five", "another text", None, "")])
    assert sorted(len(r["text"] or "") for r in simhash.one_of_each(nobody).collect()) == [0, 12, 23]
    assert simhash.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_are_complete_for_every_plan_and_cell_size(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(20)}
    fps = sorted(fps)
    unique = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = _brute_components(fps, 4)
    want = {frozenset(f for f, r in zip(fps, roots) if r == k) for k in set(roots)}
    counts = simhash.bit_counts(unique)
    assert counts[64, 64] == len(fps)
    plans = [simhash.plan(counts, 4)] + [[simhash.Part(b, t) for b, t in zip(simhash._grouped(counts, m), ts)] for m, ts in ((5, (0,) * 5), (3, (1, 0, 1)), (2, (3, 0)))]
    for parts in plans:
        assert sorted(b for p in parts for b in p.bits) == list(range(64))
        assert sum(p.threshold for p in parts) == 4 - len(parts) + 1
        for cell in (1024, 8):
            found = components.components(simhash.links(unique, parts, 4, cell=cell)).collect()
            root = {r["node"] % (1 << 64): r["root"] for r in found}
            got = {}
            for f in fps:
                got.setdefault(root.get(f, ("alone", f)), set()).add(f)
            assert {frozenset(v) for v in got.values()} == want


def test_unrelated_texts_of_one_doc_id_stay(spark):
    rows = [(1, t, "en", "a", 1) for t in ("one two three four five six", "quite another text under the same id", "One two three four five six")]
    kept = simhash.one_of_each(docs(spark, rows)).collect()
    assert sorted(r["text"].lower() for r in kept) == ["one two three four five six", "quite another text under the same id"]


def test_one_of_each_links_similar_texts_only(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for k in range(3):  # k edits touch 5k shingles
            copy = list(body)
            for e in range(k):
                copy[(e + 1) * len(body) // 4] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    head = [rng.choice(words) for _ in range(90)]
    for _ in range(4):  # a common beginning, similarity under 0.8
        rows.append((len(rows), " ".join(head + [rng.choice(words) for _ in range(25)])))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert any(4 < (_brute_fingerprint(rows[i][1]) ^ _brute_fingerprint(rows[j][1])).bit_count() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
               for i, j in itertools.combinations(range(len(rows)), 2))
    parent = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
            parent = [new if p == old else p for p in parent]
    for cell in (1024, 16):
        # radius 20: every pair of this table is a candidate that should be, so the result is brute force's, and some candidates are refused
        got = simhash.one_of_each(docs(spark, [(i, t, "en", "a", 1) for i, t in rows]), radius=20, both=44, cell=cell)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(parent))


def _nodes(spark, rng):
    """Nodes in families of few changed bits, a crowd that shares one minimum among them, with the pairs that are candidates."""
    rows = []
    for f in range(60):
        fp, second, minima = rng.getrandbits(64), rng.getrandbits(64), [rng.getrandbits(16) for _ in range(4)]
        if f < 20:
            minima[2] = 65_535  # the crowd
        for k in range(4):
            own = [m if rng.random() < 0.6 else rng.getrandbits(16) for m in minima] if k else minima
            flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12)))
            rows.append((len(rows), flip(fp), flip(second), own, rng.choice([90, 100, 130])))
    rows += [(len(rows) + i, 7, 7, [9, 9, 9, 9], 50) for i in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    packed = [(n, signed(a), signed(b), signed(sum(m << (16 * i) for i, m in enumerate(ms))), size) for n, a, b, ms, size in rows]
    wanted = [(x[0], y[0]) for x, y in itertools.combinations(rows, 2)
              if (d := (x[1] ^ y[1]).bit_count()) <= 16 and d + (x[2] ^ y[2]).bit_count() <= 32 and set(x[3]) & set(y[3]) and 5 * min(x[4], y[4]) >= 4 * max(x[4], y[4])]
    return spark.createDataFrame(packed, "node long, fp long, second long, minima long, size int"), wanted


def _joined(pairs):
    root = {}
    for a, b in pairs:
        a, b = root.get(a, a), root.get(b, b)
        root |= {n: min(a, b) for n in [a, b, *(m for m, r in root.items() if r in (a, b))]}
    return {frozenset(n for n, r in root.items() if r == one) for one in root.values()}


def test_candidates_meet_by_their_smallest_shingles(spark, monkeypatch):
    nodes, wanted = _nodes(spark, random.Random(5))
    sent, plain = [], simhash.dealt
    monkeypatch.setattr(simhash, "dealt", lambda unique, *rest: sent.append(unique.count()) or plain(unique, *rest))
    for cell, crowd in ((1024, 32), (8, 32), (4, 4), (1, 1)):  # in one cell, in cut buckets, with the crowd by parts
        sent.clear()
        got = [(r["a"], r["b"]) for r in simhash.candidates(nodes, 16, 32, (4, 5), cell=cell, crowd=crowd).collect()]
        assert _joined(got) == _joined(wanted)
        assert bool(sent) == (cell < 8) and (cell != 4 or 20 <= sent[0] < 80)
    rows = [(i, " ".join(random.Random(i % 50).choices("abcdefgh", k=60)) + " x" * (i % 3), "en", "a", 1) for i in range(150)]
    sent.clear()
    assert simhash.one_of_each(docs(spark, rows)).count() <= 100
    assert not sent  # no flipped keys for ordinary texts


def test_plan_widens_parts_as_the_corpus_grows():
    counts = np.full((65, 65), 0.25)
    np.fill_diagonal(counts, 0.5)
    counts[64, :] = counts[:, 64] = 0.5
    counts[64, 64] = 1
    sizes = [len(simhash.plan(counts * n, 4)) for n in (1e3, 1e6, 1e9)]
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[0] > sizes[2]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (70, 71), (71, 70)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 70: 70, 71: 70}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_shingles_of_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 30, 80, 200, 7, 40, 41, 0)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for many, columns in ((32, 4096), (2, 3), (0, 7)):
        got = simhash.common_shingles(sets, many, columns)
        assert all(got[i, j] == want[i][j] for i in range(10) for j in range(10) if i != j)


def test_groups_larger_than_a_cell(spark):
    rng = np.random.default_rng(9)
    sets, roots = [], []

    def add(root, values):
        sets.append(np.unique(values.astype(np.uint64)))
        roots.append(root)

    base = rng.integers(0, 1 << 60, 200)
    for _ in range(70):  # copies with a few changes
        add(0, np.append(base[rng.permutation(200)[:196]], rng.integers(0, 1 << 60, 4)))
    for _ in range(3):  # three families in one group, and some that are alone
        family = rng.integers(0, 1 << 60, 150)
        for _ in range(17):
            add(1000, np.append(family[rng.permutation(150)[:146]], rng.integers(0, 1 << 60, 4)))
    for _ in range(12):
        add(1000, rng.integers(0, 1 << 60, 100))
    path = rng.integers(0, 1 << 60, 900)
    for i in range(40):  # a path: only neighbours are similar
        add(2000, path[20 * i:20 * i + 200])
    for _ in range(3):
        add(3000, np.append(base[:100], rng.integers(0, 1 << 60, 3)))
    nodes = [10 * i + 7 for i in range(len(sets))]
    members = spark.createDataFrame([(n, r, len(x)) for n, r, x in zip(nodes, roots, sets)], "node long, root long, size int")
    table = spark.createDataFrame([(n, bytearray(x.astype("<u8").tobytes())) for n, x in zip(nodes, sets)], "node long, set binary")
    parent = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if roots[i] == roots[j] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
            parent = [new if p == old else p for p in parent]
    assert len(set(parent)) == 1 + 3 + 12 + 1 + 1
    for cell in (512, 8):
        got = {r["node"]: r["root"] for r in components.components(simhash.connected(members, table, (4, 5), cell=cell)).collect()}
        assert [got.get(n, n) for n in nodes] == [nodes[p] for p in parent]


def test_smallest_shingles_meet():
    some = np.array([3, 9, 70_000, 1 << 40, 1 << 50], dtype=np.uint64)
    assert np.array([simhash.smallest(some)]).view("<u2").tolist() == [3, 9, 70_000 & 0xFFFF, 0]
    assert np.array([simhash.smallest(some[:1])]).view("<u2").tolist() == [3] * 4 and simhash.smallest(some[:0]) == 0


def test_a_repeated_query_has_its_own_ranks(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(20, [2.0, -1.0]), (20, [2.0, -1.0])]
    got = _topk(spark, [(*r, "x", "y") for r in rows], 20)
    assert got == _brute_topk(rows, 20, lambda q: q % 5 == 0) and sum(r[0] == 20 for r in got) == 60


def test_scores_beyond_64_bits_are_refused(spark):
    for value in (1e17, 1e300):
        frame = spark.createDataFrame([(0, [value]), (1, [value])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(topk.quantised(frame), F.col("vec_id") == 0, 5).collect()
