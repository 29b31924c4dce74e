"""Token ids of whole texts as packed 32-bit numbers, as the `tokenizers` library gives them for a byte-level file.

Where a vocabulary numbers its tokens in the order of its merges, and every token comes from one merge, the rank of a
merge is the id of its token, and `tiktoken` finds the same ids from the vocabulary alone, several times as fast. It
is used for texts of PLAIN characters, which both libraries' patterns class alike, without an added token. Other
texts, and all texts of other files, go through `tokenizers`. A text is always encoded as a whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

#: Fixed value: the pattern of byte-level pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of characters whose class has not changed between versions of Unicode.
PLAIN = re.compile("[\t-\r -~ -ǿΑ-ΡΣ-ώЀ-ҁҊ-ӹא-תء-غف-يऄ-ह"
                   "‐-‧‰-›€、-〃ぁ-ゔァ-ヺ一-龥가-힣]*")


def bytes_of_letters() -> dict[str, int]:
    """The byte that a letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The ids by the tokens' bytes, if they are in the order of the merges and every merge makes a token of its own."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, before = held["model"], held.get("pre_tokenizer") or {}
    options = [held.get("normalizer"), before.get("add_prefix_space"), model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"),
               model.get("end_of_word_suffix"), model.get("ignore_merges"), model.get("byte_fallback")]
    if before.get("type") != "ByteLevel" or model.get("type", "BPE") != "BPE" or not before.get("use_regex", True) or any(options):
        return None
    letters = bytes_of_letters()
    added = {token["content"] for token in held["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    singles = {bytes([b]) for b in range(256)}
    in_order = all(x < y for x, y in zip(made, made[1:])) and (not made or made[0] > max(ranks[s] for s in singles))
    return ranks if singles <= ranks.keys() and in_order and len(made) + 256 == len(ranks) else None


class PackedEncoder:
    """Ids of texts, four little-endian bytes each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.plain = None
        if ranks is not None:
            import tiktoken

            self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for at, text in enumerate(texts):
            if self.plain is not None and PLAIN.fullmatch(text) and not any(token in text for token in self.added):
                out[at] = self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                rest.append(at)
        for at, coded in zip(rest, self.tokenizer.encode_batch_fast([texts[at] for at in rest], add_special_tokens=False)):
            out[at] = array("I", coded.ids).tobytes()
        return out


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> PackedEncoder:
    return PackedEncoder(path)
