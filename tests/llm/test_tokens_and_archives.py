import array
import hashlib
import io
import json
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard

from cases import DOCS, SCHEMA, docs, texts
from netsift.llm import bpe, byte_tokens, cutting_stock, packing, warc
from netsift.llm.queries import TOKENIZERS

WORD, BYTE = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_50k.json"
ODD = ["", " ", "  a  b ", "a\n b", "a \nb", "a\n  b", " a", "a ", "x  y", "x\u0085y", "it's WE'LL don't", "ΑΣ ΣΑΣ İI", "é ́x", "\x1c\x1d q",
       "12345 6", "<|endoftext|>a <|startoftext|><|endoftext|>", "a <|endoftext|> b", "日本語テキスト", "😀👍🏽 ok", "\t\ttabs\r\nline", "…—“quotes”", "ﬁ ligature ½ ²"]


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def _random_texts(vocabulary, n=60):
    rng = random.Random(2)
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(vocabulary).replace("</w>", "") for _ in range(rng.choice([2, 40, 900]))))
        out.append("".join(rng.choice("abeinrst") for _ in range(rng.choice([5, 80, 3000]))))
        out.append("".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x3FF), 0x2003, 0x1F600])) for _ in range(50)))
    return out


def test_transducer_equals_the_library(word_library):
    ours = bpe.loaded(WORD)
    for text in ODD + _random_texts(list(word_library.get_vocab())):
        want = word_library.encode(text, add_special_tokens=False).ids
        assert list(ours.encode(text)) == want, text[:80]
        assert "".join(ours.decode(want, block=7)) == word_library.decode(want, skip_special_tokens=False)


def test_transducer_holds_a_bounded_window():
    ours = bpe.loaded(WORD)
    assert 0 < ours.ahead < 1000
    rng = random.Random(4)
    word = "".join(rng.choice("abeinrst") for _ in range(50_000))
    machine, most, out = ours.transducer, 0, []
    for token in machine.feed(map(ours.symbol.__getitem__, word.encode())):
        out.append(token)
        most = max(most, len(machine.held))
    out += machine.finish()
    assert most <= ours.ahead + bpe.WORK + 1
    assert "".join(ours.decode(out, spaced=False)) == word


def test_lookahead_of_a_chain():
    # "ab" waits for "bc", which waits for "cd"
    assert bpe.lookahead([("c", "d"), ("b", "c"), ("a", "b")], len) == 3
    assert bpe.lookahead([("a", "b"), ("b", "c")], len) == 1
    assert bpe.lookahead([], len) == 0


def test_bytes_become_text_across_tokens():
    ours = bpe.loaded(WORD)
    for text in ("naïve 😀 日本", "\U0001f600"):
        ids = list(ours.encode(text))
        assert "".join(ours.decode(ids, spaced=False, block=1)).replace(" ", "") == text.replace(" ", "")
    lone = [ours.symbol[0xF0], ours.final[0x41]]
    assert "".join(ours.decode(lone, spaced=False, block=1)) == "�A "


def test_round_trip_query(spark, word_library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs(spark), WORD).collect()}
    want = set()
    for doc_id, text, *_ in DOCS:
        ids = word_library.encode(text or "", add_special_tokens=False).ids
        decoded = word_library.decode(ids, skip_special_tokens=False)
        want.add((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_encoded_and_decoded_tables(spark, word_library):
    ids = bpe.encoded(docs(spark), WORD)
    back = bpe.decoded(ids, WORD).collect()
    assert len(back) == len(DOCS)
    want = {word_library.decode(word_library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, *_ in DOCS}
    assert {r["text"] for r in back} == want


def test_packed_ids_equal_the_library(byte_library):
    ours = byte_tokens.PackedEncoder(BYTE)
    some = ODD + _random_texts(list(byte_library.get_vocab()), 10)
    for text, got in zip(some, ours.encode(some)):
        assert array.array("I", got).tolist() == byte_library.encode(text, add_special_tokens=False).ids, text[:80]


def test_packed_ids_of_spaces_between_white_space(byte_library):
    ours = byte_tokens.PackedEncoder(BYTE)
    odd = ["a \u00a0 \u00a0 b", "a" + " \u00a0" * 8 + " b", "a\n \nb", "a\t \r\n c", "a\u00a0 ", "\u3000 \u3000 x", "a\n <|endoftext|> b", "a\u00a0 b \u00a0c", " \u00a0 \u00a0", "\u2003 \u2003x"]
    rng = random.Random(4)
    odd += ["".join(rng.choice(["a", "b1", " ", " ", "\u00a0", "\n", "\u2003", "<|endoftext|>", "<", "\x1c"]) for _ in range(30)) for _ in range(500)]
    odd += [t.replace("  ", " ") for t in odd]
    for text, got in zip(odd, ours.encode(odd)):
        assert array.array("I", got).tolist() == byte_library.encode(text, add_special_tokens=False).ids, text


def _check_packing(rows, documents, library, capacity):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(int)
    for doc_id, text in documents:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), capacity):
            piece = ids[start:start + capacity]
            want[(doc_id, start, len(piece), zlib.crc32(array.array("I", piece).tobytes()), len(ids))] += 1
    got = defaultdict(int)
    for r in rows:
        got[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    assert got == want
    return sum(r["length"] for r in rows) / (len(sequences) * capacity)


def test_packing_covers_every_id_once_with_little_padding(spark, sf, byte_library):
    rows = packing.packed(spark.read.parquet(f"{sf}/documents.parquet"), BYTE).collect()
    assert _check_packing(rows, texts(sf), byte_library, 1024) > 0.97


def test_packing_of_awkward_rows(spark, byte_library):
    few = [d for d in DOCS if d[0] != 7] + [(7, "word " * 300, "en", "c", 1)]
    rows = packing.packed(docs(spark, few), BYTE, capacity=16, per_bucket=2).collect()
    _check_packing(rows, [(i, t or "") for i, t, *_ in few], byte_library, 16)
    assert packing.packed(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_cutting_stock_takes_all_pieces_and_nears_the_bound():
    rng = np.random.default_rng(1)
    for n, room in ((0, 1.0), (1, 1.0), (40, 1.2), (3000, 1.01)):
        lengths = rng.integers(1, 129, n)
        demand = np.bincount(lengths, minlength=129)
        patterns = cutting_stock.cut(demand, 128)
        used = np.zeros(129, int)
        for pattern, times in patterns:
            assert times > 0 and sum(l * k for l, k in pattern.items()) <= 128
            for l, k in pattern.items():
                used[l] += k * times
        assert (used == demand).all()
        assert sum(t for _, t in patterns) <= max(1, room * lengths.sum() / 128 + 1)


def test_column_generation_finds_the_optimum_that_greedy_misses():
    demand = np.zeros(11)
    demand[[3, 4]] = 30, 20  # two of 3 and one of 4 fill ten: 20 sequences need 40 of 3; bound (90 + 80) / 10
    found = cutting_stock.column_generation(demand, 10, gap=0.0)
    assert sum(t for _, t in found) == pytest.approx(17.5, abs=0.1)
    value, pattern = cutting_stock.knapsack(np.array([0, 0, 0, 0.35, 0.3, 0, 0, 0, 0, 0, 0]), 10)
    assert value == pytest.approx(1.05) and pattern == {3: 3}


PAGES = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, "http://c", ""), (4, None, None), (5, "bad\r\nurl", "ünï\r\n\r\nWARC/1.1"),
         (-7, "http://neg", "<p>same</p>"), (None, "http://none", "only"), (None, "http://none", "<p>same</p>"), (1 << 62, "x", "big id"), (9, "r", "rep"), (9, "r", "rep")]


def _want(pages, least=0):
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        first = min((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        again = len(data) >= least and first is not None and page_id != first
        out.append((page_id, len(data), warc.base32_sha1(data), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, revisit string")


@pytest.mark.parametrize("least", [0, 5])
def test_archives_of_awkward_pages(spark, least):
    got = warc.archived(_pages(spark, PAGES), least_bytes=least).drop("url").collect()
    assert sorted(str(tuple(r)) for r in got) == _want(PAGES, least)


def test_archives_of_no_pages(spark):
    assert warc.archived(_pages(spark, [])).count() == 0


def test_an_archive_starts_with_its_dictionary_and_its_records_stand_alone(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    many = pages.selectExpr(
        "page_id", "url", "html", "explode(sequence(0, 3)) as k").selectExpr("page_id + 1000 * k as page_id", "url", "html || k as html").repartition(1)
    manifest = warc.write(warc.decided(many).coalesce(1), str(tmp_path / "archives"))
    (entry,) = manifest.collect()
    data = open(entry["path"], "rb").read()
    assert entry["records"] == many.count() and entry["bytes"] == len(data) == os.path.getsize(entry["path"])
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    first = warc.parse_record(one.decompress(data[8 + size:]))
    assert one.eof and first["record_type"] == "response"
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(manifest).collect() if r["record_type"] == "response"}
    assert back == {r["page_id"]: r["html"] for r in many.collect()}


def test_record_ids_hold_page_ids():
    for page in (0, 1, -1, (1 << 63) - 1, -(1 << 63), None, 1 << 62):
        assert warc.page_of(warc.record_id(page)) == page


def test_broken_archives_are_refused():
    sink = io.BytesIO()
    warc.write_archive(iter([(1, "u", b"payload", warc.base32_sha1(b"payload"), None, False)]), sink)
    data = sink.getvalue()
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(data))] == [b"payload"]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))


def test_ids_of_random_texts_equal_the_library(tmp_path):
    path = BYTE
    encoder = byte_tokens.PackedEncoder(path)
    assert encoder.plain is not None
    letters = byte_tokens.bytes_of_letters()
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    tokens = [t for t in (bytes(letters[c] for c in token).decode("utf-8", "ignore") for token in held["model"]["vocab"] if not token.startswith("<|")) if t]
    rng = random.Random(11)
    odd = ["  ", "  ", "   ", "\n", "\t\t", "\r\n", "\x85", "\x1c", "'s", "'ll", "<", "|", "<|", "<|endoftext|>", "0", "²", "é", "é", "ß", "日本", "가", "　", "…", "\U0001F600", "͸", "Ⴀ", "ꟊ"]

    def piece() -> str:
        kind = rng.random()
        return rng.choice(tokens) if kind < 0.5 else rng.choice(tokens).strip()[:rng.randint(0, 9)] if kind < 0.65 else rng.choice(odd) if kind < 0.8 else "".join(
            rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randint(1, 12)))

    texts = ["".join(piece() for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["x" * 5000, " " * 3000, "ab " * 4000]
    want = [array.array("I", c.ids).tobytes() for c in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    # a file whose merges are in another order has no ranks, and its texts go through the library
    merges = held["model"]["merges"]
    merges[300], merges[900] = merges[900], merges[300]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(held), encoding="utf-8")
    changed = byte_tokens.PackedEncoder(str(other))
    assert changed.plain is None
    assert changed.encode(texts[:500]) == [array.array("I", c.ids).tobytes() for c in changed.tokenizer.encode_batch(texts[:500], add_special_tokens=False)]


@pytest.mark.parametrize("count,size,has", [(1, 100_000, False), (7, 3000, False), (8, 1200, True), (40, 300, True), (3000, 150, True), (20_000, 60, True)])
def test_bytes_decide_about_the_dictionary(count, size, has):
    rng = random.Random(count)
    words = [f"<div class='c{i}'>text {i * 7919}</div>" for i in range(50)]
    payloads = ["".join(rng.choice(words) for _ in range(size // 28 + 1))[:size].encode() for _ in range(count)]
    sink = io.BytesIO()
    records, written, known = warc.write_archive(iter([(i, "u", p, warc.base32_sha1(p), None, False) for i, p in enumerate(payloads)]), sink)
    data = sink.getvalue()
    assert (records, written) == (count, len(data)) and (known > 0) == has == (int.from_bytes(data[:4], "little") == warc.SKIPPABLE)
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(data))] == payloads
