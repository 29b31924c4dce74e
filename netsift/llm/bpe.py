"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge list has a sufficient lookahead: a token can only be changed by what follows it through a chain of merges
of ever higher priority, each of which takes away the first symbol that the merge before it waits for. `lookahead`
computes the longest such chain, in symbols. The transducer keeps that many symbols and a working window, emits
tokens as soon as they are stable, and so encodes a word of any length in constant memory.

Texts are taken piece by piece: no token crosses white space. Pieces and words that come again are looked up in
two-generation caches of bounded size.

Decoding feeds the bytes of the tokens to an incremental UTF-8 state machine, so a character whose bytes lie in
several tokens or blocks comes out whole, and invalid bytes come out as U+FFFD.

Edge cases: a null text is empty; the empty text and texts of white space have no tokens; the strings of added
tokens in a text become those tokens. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import text_or_empty

NONE = 1 << 60
WORK = 512  # symbols of the working window beside the lookahead


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is one, else the next of those from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(extra)) for b in range(256)]


class Cache(dict):
    """A mapping filled by `make`, of two generations: what isn't used while one fills up is dropped."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token that can still change it or its end, at most.

    The right part of a merge waits for its own last symbols; any of its tails may be taken by a merge of higher
    priority with what follows, which in turn may be prevented in the same way. Merges are visited by priority, so
    the answer for those of higher priority is known.
    """
    tails: dict[str, tuple[str, int]] = {}  # token -> its right part, the merge that made it
    after: dict[str, tuple[list[int], list[int]]] = {}  # left part -> its merges, the longest reach up to each
    longest = 0
    for rank, (a, b) in enumerate(merges):
        reach, limit, tail = 0, rank, b
        while True:
            if tail in after:
                ranks, best = after[tail]
                k = bisect.bisect_left(ranks, limit)
                reach = max(reach, best[k - 1] if k else 0)
            if tail not in tails:
                break
            tail, limit = tails[tail]
        ranks, best = after.setdefault(a, ([], []))
        ranks.append(rank)
        best.append(max(best[-1] if best else 0, length(b) + reach))
        longest = max(longest, best[-1])
        tails.setdefault(a + b, (b, rank))
    return longest


class Transducer:
    """Symbols in, stable token ids out."""

    def __init__(self, merges: dict[int, int], symbols: dict[int, int], ahead: int):
        self.merges, self.symbols, self.ahead = merges, symbols, ahead
        self.held: list[int] = []

    def _merged(self, ids: list[int]) -> list[int]:
        """The merges of highest priority first, the leftmost of equal ones. `ids` is used up."""
        get = self.merges.get
        pairs = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i, token = pairs.index(best), best & 0xFFFFF
            ids[i] = token
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(token << 20 | ids[i + 1], NONE)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | token, NONE)
        return ids

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        symbols = iter(symbols)
        while more := list(islice(symbols, self.ahead + WORK - len(self.held) + 1)):
            self.held += more
            if len(self.held) > self.ahead + WORK:
                yield from self._stable(len(self.held) - self.ahead)

    def _stable(self, upto: int) -> Iterator[int]:
        at = 0
        for token in self._merged(self.held.copy()):
            if at + self.symbols[token] > upto:
                break
            at += self.symbols[token]
            yield token
        self.held = self.held[at:]

    def finish(self) -> list[int]:
        out, self.held = self._merged(self.held), []
        return out

    def whole(self, symbols: list[int]) -> list[int]:
        """The tokens of symbols that fit into the window, so that none is emitted before the end."""
        return self._merged(symbols)


class WordBpe:
    """The encoder of a `tokenizers` file with NFC, lower case and an end-of-word suffix, and its decoder."""

    PIECE = 250_000
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\p{Z}\p{L}\p{N}]+"  # as the file has it, \s spelt out

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        plain = lambda t: len(t) - len(end) * t.endswith(end)
        self.ahead = lookahead(merges, plain)
        self.transducer = Transducer({vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))},
                                     {i: plain(t) for t, i in vocab.items()}, self.ahead)
        alphabet = byte_alphabet()
        self.symbol = [vocab[c] for c in alphabet]
        self.final = [vocab[c + end] for c in alphabet]
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in {**vocab, **self.added}.items()}
        from_char = {c: b for b, c in enumerate(alphabet)}
        self.raw = {i: bytes(from_char[c] for c in t.removesuffix(end)) + b" " * t.endswith(end) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.decimal = {i: str(i).encode() for i in self.tokens}
        self._split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self._words = regex.compile(self.PATTERN)
        self.words = Cache(lambda w: tuple(self.stream(w)), self.PIECE)
        self.pieces = Cache(self._piece, self.PIECE)

    def stream(self, word: str) -> Iterator[int]:
        """The tokens of one word."""
        data = word.encode()
        if len(data) <= self.ahead + WORK:
            symbols = list(map(self.symbol.__getitem__, data))
            symbols[-1] = self.final[data[-1]]
            yield from self.transducer.whole(symbols)
            return
        yield from self.transducer.feed(map(self.symbol.__getitem__, memoryview(data)[:-1]))
        yield from self.transducer.feed((self.final[data[-1]],))
        yield from self.transducer.finish()

    def _may_be_added(self, piece: str) -> bool:
        return any(t in piece for t in self.added)

    def _piece(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        for part in self._split_added.split(piece) if self._may_be_added(piece) else (piece,):
            if part in self.added:
                out.append(self.added[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))  # no final sigma
            for word in self._words.findall(part):
                out += self.words[word] if len(word) <= 64 else self.stream(word)
        return tuple(out)

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text, as they become stable."""
        lines = text.replace("\n", " ").replace("\t", " ")
        return chain.from_iterable(map(self.pieces.__getitem__, lines.split(" ")))

    def decode(self, ids: Iterable[int], spaced: bool = True, block: int = 1 << 16) -> Iterator[str]:
        """The text of ids, block by block. Spaced: the tokens as they are written in the vocabulary with a space
        between, which is what a file without a decoder gives; else the bytes they stand for."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        table, between = (self.tokens, b" ") if spaced else (self.raw, b"")
        ids, first = iter(ids), True
        while some := list(islice(ids, block)):
            yield machine.decode((b"" if first else between) + between.join(map(table.__getitem__, some)))
            first = False
        yield machine.decode(b"", final=True)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [list(bpe.encode(t)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str, spaced: bool = True) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = ["".join(bpe.decode(i or (), spaced)) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, block: int = 1 << 16) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, block by block."""

    def digests(bpe: WordBpe, text: str) -> tuple[int, str, str]:
        ids, n, of_ids, of_text = iter(bpe.encode(text)), 0, hashlib.sha256(), hashlib.sha256()

        def noted() -> Iterator[int]:
            nonlocal n
            while some := list(islice(ids, block)):
                of_ids.update((b" " if n else b"") + b" ".join(map(bpe.decimal.__getitem__, some)))
                n += len(some)
                yield from some

        for text_block in bpe.decode(noted(), block=block):
            of_text.update(text_block.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            done = [digests(bpe, t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in zip(*done))] if done else [[], [], [], []], schema=_CODED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
