import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cases import DOCS, SCHEMA, docs
from netsift.llm import exact_dedup, sharding
from netsift.llm.cuckoo import CuckooFilter, Overflow
from netsift.llm.exact_dedup import LiveDigests


def test_cuckoo_filter_inserts_finds_and_deletes():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    f = CuckooFilter.for_keys(3000)
    for k in keys:
        f.insert(k)
    assert all(k in f for k in keys)
    for k in keys[:1500]:
        assert f.delete(k)
    assert all(k in f for k in keys[1500:])
    assert sum(k in f for k in keys[:1500]) < 15
    again = CuckooFilter.from_bytes(f.to_bytes(), f.used)
    assert all(k in again for k in keys[1500:])


def test_overflow_is_reported_and_index_resizes_from_stored_keys():
    f = CuckooFilter(1)
    with pytest.raises(Overflow):
        for k in range(100):
            f.insert(k << 48 | k)
    index = LiveDigests(expect=1)
    digests = [random.Random(i).randbytes(32) for i in range(2000)]
    for i, d in enumerate(digests):
        index.add(d, i)
    assert index.resized > 0 and len(index.stored) == 2000
    assert all(LiveDigests.key(d) in index.filter for d in digests)


def test_a_hit_is_verified():
    index = LiveDigests(expect=4)
    a, b = bytes(32), bytes(8) + bytes(8) + b"\1" * 16  # the same filter key, other content
    index.add(a, 1)
    index.add(b, 2)
    assert {d: v for d, v in index.stored.items()} == {a: [1, 1], b: [2, 1]}
    assert index.remove(a) and not index.remove(a) and b in index.stored


def _brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), i == (max(known) if known else None)) for i in ids]
    return Counter(out)


def test_exact_duplicates_of_awkward_rows(spark):
    got = exact_dedup.exact_duplicates(docs(spark), least_shards=4).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, got)) == _brute(DOCS)


def test_exact_duplicates_of_an_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA), least_shards=4).count() == 0


def test_index_takes_batches_and_removals(spark, tmp_path):
    index = exact_dedup.ExactIndex(spark, str(tmp_path / "index"), shards=4)
    first = exact_dedup.digests(docs(spark, [(i, f"text {i % 7}", "en", "a", 1) for i in range(20)]))
    index.ingest(first)
    index.ingest(exact_dedup.digests(docs(spark, [(100, "TEXT 3", "en", "a", 1), (5, "new", "en", "a", 1)])))
    live = {tuple(r) for r in index.stored().select("keep_id", "copies").collect()}
    assert (100, 4) in live and (5, 1) in live and len(live) == 8
    index.remove(exact_dedup.digests(docs(spark, [(0, "text 3", "en", "a", 1), (0, "never seen", "en", "a", 1)])))
    assert index.stored().count() == 7
    index.ingest(exact_dedup.digests(docs(spark, [(2, "text 3", "en", "a", 1)])))
    assert (2, 1) in {tuple(r) for r in index.stored().select("keep_id", "copies").collect()}


def test_shards_are_even_and_gapless(spark, sf):
    placed = sharding.sharded(spark.read.parquet(f"{sf}/documents.parquet"), 8).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in placed:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["position"])
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_awkward_rows(spark):
    import zlib

    rows = sharding.place(sharding.slot_rows(docs(spark)), sharding.first_map(sharding.slot_totals(sharding.slot_rows(docs(spark))), 4), per_bucket=1).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in DOCS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["position"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_edited_map_moves_little_and_serves_more_shards(spark, sf):
    rows = sharding.slot_rows(spark.read.parquet(f"{sf}/documents.parquet"))
    second = sharding.edit_map(sharding.first_map(sharding.slot_totals(rows), 8), 8)
    third = {r["slot"]: r for r in sharding.edit_map(second, 9).collect()}
    before = {r["slot"]: r["shard"] for r in second.collect()}
    loads = Counter()
    for r in third.values():
        loads[r["shard"]] += r["bytes"]
    moved = sum(r["bytes"] for s, r in third.items() if before[s] != r["shard"])
    assert len(third) == sharding.SLOTS and {r["version"] for r in third.values()} == {3}
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 9
    assert moved < 0.3 * sum(loads.values())


def _plain_map(rows, shards, slack=0.02):
    """Slot, size of every row; the map by the same law, row by row."""
    slots = [xxhash.xxh64_intdigest((t or "").encode(), xxhash.xxh64_intdigest(struct.pack("<q", i), 42) if i is not None else 42) % sharding.SLOTS for i, t in rows]
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    bytes_of = [0] * sharding.SLOTS
    for slot, size in zip(slots, sizes):
        bytes_of[slot] += size
    most, loads, gone, out = sum(sizes) / shards * (1 - slack), [0] * shards, [], {}
    for shard in range(shards):
        filled = 0
        for slot in sorted((s for s in range(sharding.SLOTS) if s % shards == shard), key=lambda s: (-bytes_of[s], s)):
            filled += bytes_of[slot]
            if filled <= most:
                out[slot], loads[shard] = shard, loads[shard] + bytes_of[slot]
            else:
                gone.append((bytes_of[slot], slot))
    for size, slot in sorted(gone, reverse=True):
        out[slot] = loads.index(min(loads))
        loads[out[slot]] += size
    return sorted(str((i, size, slot, out[slot])) for (i, _), size, slot in zip(rows, sizes, slots))


def test_sharding_against_a_plain_map(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for table, rows in ((frame, [(r["doc_id"], r["text"]) for r in frame.collect()]), (docs(spark), [(r[0], r[1]) for r in DOCS])):
        got = sharding.sharded(table, 8).collect()
        assert sorted(str((r["doc_id"], r["size"], r["slot"], r["shard"])) for r in got) == _plain_map(rows, 8)


def test_rows_of_one_doc_id_are_dealt(spark):
    table = spark.range(6000).select(F.lit(77).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    sizes = [r["n"] for r in sharding.sharded(table, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.05 * min(sizes)
