"""Token counts and ids by public tokenizer files, shared by the counting and packing operators.

A file is read on the driver and sent to the workers as text (its size is checked), so executors need no file of their
own. Each worker keeps one tokenizer, and for counts a bounded two-generation cache, per broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import tiktoken
from tokenizers import Tokenizer

MAX_FILE = 64 << 20
#: Entries of one cache generation, and the longest piece in it.
CACHE, LONGEST = 300_000, 96


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE + 1)
    if len(text) > MAX_FILE:
        raise ValueError(f"{path} exceeds the bound for broadcasting")
    return text


class Generations(dict):
    """A cache of at most two generations of ``size`` entries each: what is not asked for in a generation goes."""

    def __init__(self, make: Callable, size: int = CACHE, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.size, self.fixed, self.old = make, size + len(fixed or {}), fixed or {}, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
                self.update(self.fixed)
            self[key] = got
        return got


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level BPE: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def drops_white_space(text: str) -> bool:
    """Whether a tokenizer gives every text the tokens of its words, without any for white space.

    Checked on its configuration (byte-pair merging inside pre-tokens, with a mark at word ends, so no token spans words) and on
    samples of white space of every kind.
    """
    head = json.loads(text)
    model = head["model"]
    if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout"):
        return False
    t, parts = Tokenizer.from_str(text), ["a", "bcd", "7", "!?", "é"]
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    alone = sum(map(n, parts))
    return all(n(x + x.join(parts) + x) == alone for x in (" ", "  ", "\t", "\n", "\r\n", " \n \t", "\x0b", "\x0c"))


def packed(lengths: dict[bytes, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table of lengths to broadcast: (joined words, end offsets, token counts)."""
    words = list(lengths)
    return b"".join(words), np.cumsum([len(w) for w in words], dtype=np.uint32), np.array([lengths[w] for w in words], np.uint32)


def unpack(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[bytes, int]:
    blob, ends, n = table
    out, at = {}, 0
    for e, k in zip(ends.tolist(), n.tolist(), strict=True):
        out[blob[at:e]] = k
        at = e
    return out


class WordCounter:
    """Token counts for tokenizers that drop white space, so that a text's count is the sum over its words."""

    def __init__(self, text: str, table):
        self.tokenizer = Tokenizer.from_str(text)
        self.cache = Generations(self.encode, fixed=unpack(table))

    def encode(self, word: bytes) -> int:
        return len(self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids)

    def count(self, data: bytes) -> int:
        return sum(map(self.cache.__getitem__, data.split()))


def byte_ranks(text: str) -> dict[bytes, int] | None:
    """byte string -> id of a byte-level BPE tokenizer if plain rank merging gives its ids, else None.

    Rank merging joins the neighbours whose joint string has the lowest id. It equals the tokenizer's merging if ids follow
    the order of the merges and every vocabulary entry is its own encoding: a pair that is joined to an entry by another
    split than the entry's own merge would show as an entry that is not its own encoding. Both are checked here.
    """
    head = json.loads(text)
    pre, model = head.get("pre_tokenizer") or {}, head["model"]
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or head.get("normalizer") or model["type"] != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token")):
        return None
    special, alphabet = {t["content"] for t in head.get("added_tokens", [])}, byte_alphabet()
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    if any(c not in alphabet for k in vocab for c in k):
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids, bpe = [vocab.get(m, -1) for m in merged], Tokenizer.from_str(text).model
    if len(vocab) != 256 + len(merged) or ids != list(range(256, 256 + len(merged))) or any([t.id for t in bpe.tokenize(k)] != [v] for k, v in vocab.items()):
        return None
    return {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}


#: The splitting pattern of byte-level BPE pre-tokenizers; a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteIds:
    """Token ids (little-endian unsigned 32-bit) as a tokenizer file gives them.

    Where ``byte_ranks`` allows it, the same vocabulary runs in the faster rank-merging library; texts with a special
    string, those whose runs are too long for that library's splitter, and all texts of other tokenizers go to the tokenizer itself.
    """

    def __init__(self, text: str, ranks: dict[bytes, int] | None):
        self.tokenizer = Tokenizer.from_str(text)
        self.special = [t["content"] for t in json.loads(text).get("added_tokens", [])]
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not self.fast or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its splitter keeps a stack of bounded size, which some hundred thousand blanks in a row exceed
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
