"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `radius` differing bits are linked; a document's component is all it can reach by links.

Two 64-bit fingerprints at distance <= radius, cut into m parts with thresholds t_1..t_m whose sum is
radius - m + 1, agree within t_i bits on some part i. `plan` groups correlated bits into parts and gives the
thresholds by dynamic programming on the estimated candidates, both from the counts of single bits and bit pairs
over all distinct fingerprints; the number of parts is part of the search, so a larger corpus gets wider parts.
`links` enters a fingerprint under its value on each part and under all values within t_i flips, and verifies
every pair that meets. Only a spanning forest of the pairs of a bucket leaves a task. Buckets of many
fingerprints are cut into cells of bounded size, which together see every pair.

Edge cases: a null text is empty; a text without words has fingerprint 0 and is linked like any other; fewer words
than a shingle make one shingle; a null doc_id takes part but is never a component's id unless it has no other.
Columns other than doc_id and text are not read.

The pipeline's stage, `one_of_each`, has another contract: texts are linked if their sets of five-word shingles have a
Jaccard similarity of 0.8 or more. Candidates are fingerprints within 16 bits (a pair at 0.8 differs in about 10); a
second fingerprint and the four smallest shingles drop pairs that met by chance, so unrelated texts don't grow
together however many there are. Texts meet by these shingles, which part a corpus better than 16 bits do, and by parts
of the fingerprint only where very many share one. The candidates' components are groups, and similarity is decided inside a group by
the sets themselves (`connected`): a task takes a cell of bounded size and counts the common shingles of all its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import materialize, text_or_empty
from netsift.llm.components import components

BITS = 64
STAGE_WORDS, STAGE_RADIUS, STAGE_BOTH = 5, 16, 32  # words of a shingle, bits of the first fingerprint, bits of both together
LEAST = (4, 5)  # the similarity of a link, as a fraction
MINIMA = 4  # smallest shingles of a set, of which a pair has one in common
CELL = 512  # sets that a task compares at once
STAGE_ROW_COST = 300.0  # its rows are wider, and its pairs are compared in blocks
ROW_COST, PAIR_COST = 30.0, 1.0  # moving a row to a bucket against comparing a pair in it


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the shingles of `words` words."""
    found = text.lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= words:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def row_name() -> Column:
    """The doc_id as text; of a row without one, a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text "), F.sha2(text_or_empty().cast("binary"), 256)))


def document_name() -> Column:
    """The doc_id and a hash of the text together."""
    return F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.sha2(text_or_empty().cast("binary"), 256))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, name, fp long) of every row; name is that of `row_name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            values = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=["doc_id", "name", "fp"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_name().alias("name"), text_or_empty().alias("text"))
    return named.mapInArrow(run, "doc_id long, name string, fp long")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """The masks of all sets of at most `threshold` bits, the empty one first."""
        return [sum(1 << b for b in some) for t in range(self.threshold + 1) for some in itertools.combinations(self.bits, t)]


def bit_counts(unique: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, 64 x 64, with their number at [64, 64]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
            total += bits.T @ bits
        i, j = np.triu_indices(BITS + 1)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    rows = unique.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect()  # 2,145 rows
    out = np.zeros((BITS + 1, BITS + 1))
    for i, j, n in rows:
        out[i, j] = out[j, i] = n
    return out


def _grouped(counts: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The bits in m parts of near equal size, correlated bits together."""
    n = counts[BITS, BITS]
    p = counts[:BITS, BITS] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((counts[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (related[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(tuple(sorted(part)))
    return parts


def plan(counts: np.ndarray, radius: int, row_cost: float = ROW_COST) -> list[Part]:
    """The parts and thresholds with the least estimated cost for the counted fingerprints."""
    n = counts[BITS, BITS]
    if not n:
        return []
    p = counts[:BITS, BITS] / n
    best, least = [], math.inf
    for m in range(1, radius + 2):
        parts = _grouped(counts, m)
        goal = radius - m + 1
        cost = []
        for bits in parts:
            apart = np.array([1.0])  # chance of two fingerprints to differ in 0, 1, 2 .. bits of the part
            for b in bits:
                apart = np.convolve(apart, [p[b] ** 2 + (1 - p[b]) ** 2, 2 * p[b] * (1 - p[b])])
            rows = np.cumsum([math.comb(len(bits), t) for t in range(goal + 1)])
            apart = np.append(apart, np.zeros(max(0, goal + 1 - len(apart))))
            cost.append(row_cost * n * rows + PAIR_COST * n * n * np.cumsum(apart[:goal + 1]))
        table = {0: (0.0, ())}  # sum of thresholds -> cost, thresholds
        for own in cost:
            table = {s: min((c + own[t], ts + (t,)) for prev, (c, ts) in table.items() if (t := s - prev) >= 0)
                     for s in range(goal + 1)}
        if table[goal][0] < least:
            least, best = table[goal][0], [Part(b, t) for b, t in zip(parts, table[goal][1])]
    return best


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; `parent` has the smallest row of every row's component, before and after."""
    a, b = parent[i], parent[j]
    while len(a):
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent[:] = above
        a, b = parent[a], parent[b]


def _forest(fps: np.ndarray, starts: np.ndarray, index: np.ndarray, radius: int, pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs within `radius` connect.

    Segments begin at `starts`; the index rows come first in a segment and meet every later row of it.
    """
    n = len(fps)
    parent = np.arange(n)
    ends = np.append(starts[1:], n)
    rows = np.flatnonzero(index)
    more = ends[np.searchsorted(starts, rows, side="right") - 1] - rows - 1
    rows, more = rows[more > 0], more[more > 0]
    reach = np.cumsum(more)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + pairs, side="right")))
        count = more[at:to]
        i = np.repeat(rows[at:to], count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        _merge(parent, i[near], j[near])
        at = to
    moved = np.flatnonzero(parent != np.arange(n))
    a, b = fps[moved], fps[parent[moved]]
    return a[a != b], b[a != b]


def dealt(unique: DataFrame, parts: list[Part], cell: int, hot_keys: int, spread: str = "fp") -> DataFrame:
    """(part, bucket, cell, role, columns of `unique`) sorted by the first four; every pair that agrees on a part meets
    in a cell, where rows of role 0 come first and are compared with all later ones."""
    n = unique.count()
    cell = max(cell, len(parts) * n // hot_keys)  # so at most hot_keys buckets are larger than a cell
    masks = [(k, np.uint64(part.mask), np.array(part.flips(), dtype=np.uint64)) for k, part in enumerate(parts)]
    columns = unique.columns

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(columns.index("fp"))).astype(np.int64).view(np.uint64)
            for part, mask, flips in masks:
                step = max(1, 500_000 // len(flips))
                for at in range(0, len(fps), step):
                    some = fps[at:at + step]
                    keys = (some & mask)[:, None] ^ flips[None, :]
                    exact = np.zeros(keys.shape, bool)
                    exact[:, 0] = True
                    rows = pa.array(np.repeat(np.arange(at, at + len(some)), len(flips)))
                    yield pa.record_batch([pa.array(np.full(keys.size, part, np.int32)), pa.array(keys.ravel().view(np.int64)), pa.array(exact.ravel()),
                                           *(c.take(rows) for c in batch.columns)], names=["part", "bucket", "exact", *columns])

    schema = "part int, bucket long, exact boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unique.schema)
    entered = unique.mapInArrow(entries, schema)
    exact_only = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(int(np.uint64(part.mask).view(np.int64)))).alias("bucket")) for k, part in enumerate(parts)])
    hot = (unique.select(F.explode(exact_only).alias("e")).select("e.*").groupBy("part", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
           .select("part", "bucket", F.ceil(F.col("n") / cell).cast("int").alias("cuts")))
    own = F.pmod(F.xxhash64(spread), F.col("cuts")).cast("int")
    # cell c * cuts + d compares the index rows of cut c with each other and with the rows of cut d
    as_index = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda d: F.struct((own * F.col("cuts") + d).alias("cell"), F.lit(0).alias("role")))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: F.struct((c * F.col("cuts") + own).alias("cell"), F.lit(1).alias("role")))
    others = F.filter(as_probe, lambda x: F.floor(x["cell"] / F.col("cuts")) != own)
    cells = (F.when(F.col("cuts").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("exact"), 0).otherwise(1).alias("role"))))
             .when(F.col("exact"), F.concat(as_index, others)).otherwise(as_probe))
    return (entered.join(F.broadcast(hot), ["part", "bucket"], "left").select("part", "bucket", *columns, F.explode(cells).alias("c"))
            .select("part", "bucket", "c.cell", "c.role", *columns).repartition("part", "bucket", "cell").sortWithinPartitions("part", "bucket", "cell", "role"))


def links(unique: DataFrame, parts: list[Part], radius: int, cell: int = 1024, hot_keys: int = 100_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all pairs within `radius`."""

    def compare(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
        def edges(cols: list[np.ndarray], changes: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(cols[4].view(np.uint64), np.append([0], changes), cols[3] == 0, radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(batch.column(c)).astype(np.int64) for c in range(5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) < most:
                continue
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:3]], axis=0)) + 1
            if len(changes):
                yield edges([c[:changes[-1]] for c in held], changes[:-1])
                held = [c[changes[-1]:] for c in held]
        if held is not None and len(held[0]):
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:3]], axis=0)) + 1
            yield edges(held, changes)

    return dealt(unique.select("fp"), parts, cell, hot_keys).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, stays) of every row.

    component_id is the smallest doc_id of the component, and `stays` the name of the row that represents it: that
    doc_id or, where no row has one, the smallest name.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    unnamed = F.when(F.col("doc_id").isNull(), F.col("name"))
    unique = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(unnamed).alias("least_name")), "distinct-fingerprints")
    counts = bit_counts(unique)
    parts = plan(counts, radius)
    if not parts:
        return rows.select("doc_id", "fp", F.col("doc_id").alias("component_id"), F.col("name").alias("stays"))
    roots = materialize(components(links(unique, parts, radius)), "components")
    rooted = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", "least_name", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("least_name").alias("least_name"))
    smallest = materialize(smallest.select("root", "component_id", F.coalesce(F.col("component_id").cast("string"), "least_name").alias("stays")), "component-ids")
    named = materialize(rooted.join(smallest, "root").select("fp", "component_id", "stays"), "named-fingerprints")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "stays")


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 values of the shingles of `words` words, sorted; fewer words make one shingle, no words none."""
    found = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), 42)] if found else [], dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.append([0], ends)[: len(found) - words + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def two_fingerprints(hashes: np.ndarray) -> tuple[int, int]:
    """Of a set of shingles, and of the same set with its values mixed again."""
    mixed = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(hashes), _majority(mixed ^ (mixed >> np.uint64(31)))


def smallest(hashes: np.ndarray) -> int:
    """The low 16 bits of the MINIMA smallest shingles, in one number; fewer are repeated."""
    low = (hashes[:MINIMA] & np.uint64(0xFFFF)).astype("<u2")
    return int(np.resize(low, MINIMA).view("<i8")[0]) if len(low) else 0


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, name, node, fp, second, minima, size) of every row; rows with the same set of shingles have the same node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            both = np.array([two_fingerprints(x) for x in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(map(smallest, sets)), pa.int64()),
                                   pa.array(list(map(len, sets)), pa.int32())], names=["doc_id", "name", "node", "fp", "second", "minima", "size"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_name().alias("name"), text_or_empty().alias("text"))
    return named.mapInArrow(run, "doc_id long, name string, node long, fp long, second long, minima long, size int")


def _near(cols: dict[str, np.ndarray], changes: np.ndarray, radius: int, both: int, least: tuple[int, int], block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the candidates in segments that begin at `changes`, a block at a time."""
    fps, second, size = cols["fp"].view(np.uint64), cols["second"].view(np.uint64), cols["size"]
    low = np.ascontiguousarray(cols["minima"]).view("<u2").reshape(-1, MINIMA)
    ends = np.append(changes[1:], len(fps))
    indexed = np.add.reduceat(cols["role"] == 0, changes) if len(changes) else []
    for start, end, index in zip(changes.tolist(), ends.tolist(), np.asarray(indexed).tolist()):
        step = max(1, block // (end - start))
        for at in range(start, start + index, step):
            rows = min(step, start + index - at)
            i, j = np.nonzero(np.bitwise_count(fps[at:at + rows, None] ^ fps[None, at:end]) <= radius)
            later = j > i
            i, j = i[later] + at, j[later] + at
            bits = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64) + np.bitwise_count(second[i] ^ second[j])
            fit = (bits <= both) & (np.minimum(size[i], size[j]) * least[1] >= np.maximum(size[i], size[j]) * least[0])
            i, j = i[fit], j[fit]
            fit = (low[i][:, :, None] == low[j][:, None, :]).any(axis=(1, 2))
            if fit.any():
                yield i[fit], j[fit]


def _segments(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by `keys`, in tables of whole groups of about `most` rows, with the groups' beginnings."""
    def changed(held: pa.Table) -> np.ndarray:
        own = [np.asarray(held.column(c)) for c in keys]
        return np.flatnonzero(np.any([k[1:] != k[:-1] for k in own], axis=0)) + 1

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) < most:
            continue
        held = pa.Table.from_batches(kept)
        changes = changed(held)
        if len(changes):
            yield held.slice(0, changes[-1]), np.append([0], changes[:-1])
            held = held.slice(changes[-1])
        kept = held.combine_chunks().to_batches()
    if kept and sum(b.num_rows for b in kept):
        held = pa.Table.from_batches(kept)
        yield held, np.append([0], changed(held))


def _low_bits() -> Column:
    """The distinct values packed in `minima`."""
    return F.array_distinct(F.array(*[F.shiftrightunsigned("minima", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("long") for k in range(MINIMA)]))


def sharing(entered: DataFrame, sizes: DataFrame, cell: int) -> DataFrame:
    """(part, bucket, cell, role, columns of `entered`) as of `dealt`: every pair of a bucket meets in a cell.

    `sizes` is (bucket, n), 65,536 rows at most; buckets that it lacks are left out. A bucket of more than `cell` rows is cut,
    and cell c * cuts + d compares the rows of cut c with each other and with those of cut d, which is a later one.
    """
    columns = [c for c in entered.columns if c != "bucket"]
    cut = entered.join(F.broadcast(sizes.select("bucket", F.ceil(F.col("n") / cell).cast("int").alias("cuts"))), "bucket")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    as_index = F.transform(F.sequence("own", F.col("cuts") - 1), lambda d: F.struct((F.col("own") * F.col("cuts") + d).alias("cell"), F.lit(0).alias("role")))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda c: F.struct((c * F.col("cuts") + F.col("own")).alias("cell"), F.lit(1).alias("role")))
    cells = F.when(F.col("own") > 0, F.concat(as_index, as_probe)).otherwise(as_index)
    return (cut.select(F.lit(-1).alias("part"), "bucket", F.explode(cells).alias("c"), *columns).select("part", "bucket", "c.cell", "c.role", *columns)
            .repartition("part", "bucket", "cell").sortWithinPartitions("part", "bucket", "cell", "role"))


def candidates(nodes: DataFrame, radius: int, both: int, least: tuple[int, int], cell: int, crowd: int = 32, hot_keys: int = 100_000) -> DataFrame:
    """Edges (a, b) of nodes that connect what the candidates connect: one at most for a row of a cell.

    A candidate has one of its smallest shingles in common with the other, so a node is sent once for each of these. What
    more than `crowd` cells share parts too little: nodes that have such a shingle go through the search by parts.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, changes in _segments(batches, ("part", "bucket", "cell"), 200_000):
            cols = {c: np.asarray(held.column(c)).astype(np.int64) for c in ("role", "fp", "second", "minima", "node", "size")}
            parent = np.arange(held.num_rows)
            for i, j in _near(cols, changes, radius, both, least):
                _merge(parent, i, j)
            moved = np.flatnonzero(parent != np.arange(len(parent)))
            yield pa.record_batch([pa.array(cols["node"][moved]), pa.array(cols["node"][parent[moved]])], names=["a", "b"])

    entered = nodes.withColumn("bucket", F.explode(_low_bits()))
    sizes = materialize(entered.groupBy("bucket").agg(F.count("*").alias("n")), "minima")
    found = sharing(entered, sizes.filter(F.col("n").between(2, crowd * cell)), cell).mapInArrow(compare, "a long, b long")
    full = sizes.filter(F.col("n") > crowd * cell).select("bucket")
    if full.isEmpty():
        return found
    crowded = materialize(entered.join(F.broadcast(full), "bucket", "left_semi").select(*nodes.columns).distinct(), "crowded")
    parts = plan(bit_counts(crowded), radius, STAGE_ROW_COST)
    return found.unionByName(dealt(crowded, parts, cell, hot_keys, "node").mapInArrow(compare, "a long, b long"))


def sets_of(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, set binary) for `members` (node, example): the sorted shingles, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).astype("<u8").tobytes() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = docs.select(document_name().alias("example"), text_or_empty().alias("text")).join(members.select("node", "example"), "example")
    return texts.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node long, set binary")


def common_shingles(sets: list[np.ndarray], many: int = 32, columns: int = 4096) -> np.ndarray:
    """How many shingles two sets have in common, for all pairs.

    A shingle of more than `many` sets is a column of a matrix that is multiplied by itself; those of fewer are
    counted pair by pair, so the work is about `many` times the shingles whatever they have in common.
    """
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begins = np.flatnonzero(np.append([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.append(begins, len(values)))
    out = np.zeros(n * n, np.int64)
    for k in np.unique(times[(times > 1) & (times <= many)]).tolist():
        own = begins[times == k]
        step = max(1, (1 << 20) // (k * k))
        for at in range(0, len(own), step):
            sharing = owner[own[at:at + step, None] + np.arange(k)]
            out += np.bincount((sharing[:, :, None] * n + sharing[:, None, :]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    wide = np.flatnonzero(times > many)
    for at in range(0, len(wide), columns):
        some = wide[at:at + columns]
        rows = np.concatenate([owner[b:b + t] for b, t in zip(begins[some].tolist(), times[some].tolist())])
        matrix = np.zeros((n, len(some)), np.float32)
        matrix[rows, np.repeat(np.arange(len(some)), times[some])] = 1
        out += np.rint(matrix @ matrix.T).astype(np.int64)
    return out


def similar_in_cells(placed: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between labels that connect the similar pairs of a cell.

    `placed` is (root, one, two, role, node, label): rows with the same root, one and two are a cell, a pair has at
    least one row of role 0 and two labels. An edge is given for a label at most.
    """
    keys = ("root", "one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, changes in _segments(batches, keys, 1):
            for start, end in zip(changes.tolist(), [*changes[1:].tolist(), held.num_rows]):
                if end - start < 2:
                    continue
                cell = held.slice(start, end - start)
                found = [np.frombuffer(b, "<u8") for b in cell.column("set").to_pylist()]
                labels, own = np.unique(np.asarray(cell.column("label")), return_inverse=True)
                own = own.reshape(-1)
                first = np.asarray(cell.column("role")) == 0
                size = np.array(list(map(len, found)))
                common = common_shingles(found)
                near = common * least[1] >= (size[:, None] + size[None, :] - common) * least[0]
                i, j = np.nonzero(near & first[:, None] & (own[:, None] != own[None, :]))
                parent = np.arange(len(labels))
                _merge(parent, own[i], own[j])
                moved = np.flatnonzero(parent != np.arange(len(parent)))
                yield pa.record_batch([pa.array(labels[moved], pa.int64()), pa.array(labels[parent[moved]], pa.int64())], names=["a", "b"])

    rows = placed.join(sets, "node").select(*keys, "role", "label", "set")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def connected(members: DataFrame, sets: DataFrame, least: tuple[int, int], cell: int = CELL, shingles_at_once: int = 1 << 21) -> DataFrame:
    """Edges that connect all pairs of the similarity `least` inside the groups of `members` (node, root, size).

    A group that fits a cell is one, and decided there. A larger one is dealt over cells by a hash; what a cell joins
    is one label from then on, and one node for each label is dealt again until they fit a cell or don't join. What is
    then apart from the largest label of its group is compared with every node of it, block by block. So a large group
    of copies costs a pass over its nodes, and only nodes that stay apart are compared with all.
    """
    cuts = F.greatest(F.ceil(F.col("n") / cell), F.ceil(F.col("s") / shingles_at_once)).cast("int")
    groups = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    large = materialize(groups.select("root", cuts.alias("cuts")).filter("cuts > 1"), "large-groups")
    zero = F.lit(0)
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("cuts", F.lit(1))).cast("int")
    placed = members.join(large, "root", "left").select("root", chunk.alias("one"), zero.alias("two"), zero.alias("role"), "node", F.col("node").alias("label"))
    written = [materialize(similar_in_cells(placed, sets, least), "similar")]
    if large.isEmpty():
        return written[0]
    inside = materialize(members.join(large, "root"), "large-members")
    before = None

    def edges() -> DataFrame:
        return functools.reduce(DataFrame.unionByName, written)

    while True:  # logarithmic in the largest group, to the base of a cell
        joined = components(edges())
        labelled = materialize(inside.join(joined.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        apart = materialize(labelled.filter("node = label").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s")).filter("n > 1"), "groups-apart")
        left, widest = apart.agg(F.sum("n"), F.max("n")).first()
        if not left or (before is not None and (before[1] or left > 3 * before[0] / 4)):
            break
        before = (left, widest <= cell)
        leaders = labelled.filter("node = label").join(apart.select("root", cuts.alias("now")), "root")
        placed = leaders.select("root", F.pmod(F.xxhash64("node", F.lit(left)), "now").cast("int").alias("one"), zero.alias("two"), zero.alias("role"), "node", "label")
        written.append(materialize(similar_in_cells(placed, sets, least), "similar"))
    if not left:
        return edges()
    sizes = labelled.join(apart.select("root"), "root", "left_semi").groupBy("root", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    main = materialize(main.select("root", "main", F.ceil((F.col("n") - F.col("most")) / cell).cast("int").alias("blocks")), "main-labels")
    last = labelled.join(main, "root")
    every = lambda n: F.sequence(zero, F.col(n) - 1)
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    rest = last.filter("label <> main").select("root", block.alias("one"), F.explode(every("cuts")).alias("two"), zero.alias("role"), "node", "label")
    all_of_them = last.select("root", F.explode(every("blocks")).alias("one"), own.alias("two"), F.lit(1).alias("role"), "node", "label")
    written.append(materialize(similar_in_cells(rest.unionByName(all_of_them), sets, least), "similar"))
    return edges()


def similar(nodes: DataFrame, docs: DataFrame, words: int, radius: int, both: int, least: tuple[int, int], cell: int = 1024) -> DataFrame:
    """Edges of `nodes` that connect all pairs of the similarity `least` inside a component of candidates."""
    met = candidates(nodes.select("node", "fp", "second", "minima", "size"), radius, both, least, cell)
    groups = components(materialize(met.distinct(), "candidate-forest"))
    members = materialize(groups.join(nodes.select("node", "size", "example"), "node"), "candidate-groups")
    sets = materialize(sets_of(members, docs, words), "sets")
    return connected(members.select("node", "root", "size"), sets, least)


def one_of_each(docs: DataFrame, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS, both: int = STAGE_BOTH, least: tuple[int, int] = LEAST, cell: int = 1024) -> DataFrame:
    """`docs` with one row of each component of similar texts, that of the smallest doc_id; all columns stay.

    Rows that repeat both doc_id and text are the same document, so one of them stays.
    """
    rows = materialize(shingle_sets(docs, words), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("first")
    nodes = materialize(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("second").alias("second"), F.min("minima").alias("minima"), F.min("size").alias("size"), F.min("name").alias("example"), first), "distinct-sets")
    roots = materialize(components(similar(nodes, docs, words, radius, both, least, cell)), "components")
    rooted = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(rooted.select("first.name").distinct(), "kept-rows")
    whole = docs.select(F.struct("*").alias("row"), document_name().alias("name"))
    return whole.join(kept, "name", "left_semi").groupBy("name").agg(F.min_by("row", F.xxhash64(F.col("row.text"))).alias("row")).select("row.*")
