"""Byte-level BPE ids from a public vocabulary file, encoded in the tasks."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc


@lru_cache(maxsize=2)
def encoder(vocabulary: str, added: bool = False):
    """Encodes a text to ids; `vocabulary` names a file of public_tokenizers.

    The .json vocabulary is loaded through its .tiktoken twin where there is one: same ids, several times
    faster. added: the strings of its added tokens, as `<|endoftext|>`, become those tokens wherever they stand,
    as the vocabulary says; else they are ordinary text.
    """
    stem, _, kind = vocabulary.rpartition(".")
    if kind == "json" and stem == "byte_bpe_50k":
        import tiktoken

        with open(public_tokenizers.path(f"{stem}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            strings = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        fast = tiktoken.Encoding(stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=strings)
        return (lambda text: fast.encode(text, allowed_special="all")) if added else fast.encode_ordinary
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    slow.encode_special_tokens = not added
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def words_apart(vocabulary: str) -> bool:
    """Whether the ids of a text are those of its words, parted by ASCII white space, one after the other.

    So it is if the splitting pattern keeps no white space and the normalizers neither join nor see across it.
    """
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        told = json.load(file)
    normalizer, splitter = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    normalizers = normalizer.get("normalizers", [normalizer])
    local = all(n.get("type") in ("NFC", "Lowercase") or (n.get("type") == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normalizers)
    splits = [s for s in splitter.get("pretokenizers", [splitter]) if s.get("type") == "Split"]
    # An inverted split that removes what does not match keeps the matches; no alternative of this one matches white space.
    kept = any(s["behavior"] == "Removed" and s["invert"] and s["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") for s in splits)
    return local and kept and not told.get("post_processor")


#: After a Latin letter such a mark begins another piece in any text, so a blank may part them.
MARKED = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,;:!?])"


class WordEncoder:
    """Encodes texts with the tokenizers library, word by word where the vocabulary allows it.

    Words are parted, lower-cased (A-Z, which the vocabulary does too) and told apart for many texts at once; each
    different word is looked up once a call. A worker keeps the ids of the first `most_words` words that it meets, and
    encodes any other once a call: common words are met early.
    """

    def __init__(self, vocabulary: str, *, most_words: int = 500_000, most_letters: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.apart = words_apart(vocabulary)
        self.most_words, self.most_letters = most_words, most_letters
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1024, np.uint32), 0
        self.ends = np.zeros(1024, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in one array, and how many each has."""
        flat, sizes = [], np.zeros(len(words), np.int64)
        for at in range(0, len(words), 1024):
            for i, e in enumerate(self.tokenizer.encode_batch_fast(words[at : at + 1024], add_special_tokens=False), at):
                ids = e.ids
                sizes[i] = len(ids)
                flat += ids
        return np.array(flat, np.uint32), sizes

    def _learn(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        short = np.fromiter((len(w) <= self.most_letters for w in words), bool, len(words))
        short[np.cumsum(short) > self.most_words - len(self.known)] = False
        flat, sizes = flat[np.repeat(short, sizes)], sizes[short]
        n = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[n : n + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.known.update(zip((w for w, s in zip(words, short.tolist(), strict=True) if s), range(n, n + len(sizes)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has. Null texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.apart:
            return self._ids(texts.to_pylist())
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, pattern=MARKED, replacement=r"\1 \2"))
        per_text, words = pc.list_value_length(split).to_numpy(zero_copy_only=False), split.flatten()
        # An added token is read as it is written, so its look-alikes in capitals must stay what they are.
        words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        told = pc.dictionary_encode(words)
        different = told.dictionary.to_pylist()
        at = np.fromiter((self.known.get(w, -1) for w in different), np.int64, len(different))
        old, new = at >= 0, np.flatnonzero(at < 0)
        starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        stops = self.ends[at[old]]
        starts[old] = np.where(at[old] > 0, self.ends[at[old] - 1], 0)
        sizes[old] = stops - starts[old]
        fresh = [different[i] for i in new.tolist()]
        more, sizes[new] = self._ids(fresh)
        starts[new] = self.used + np.cumsum(sizes[new]) - sizes[new]
        flat = np.concatenate([self.flat[: self.used], more])
        self._learn(fresh, more, sizes[new])
        codes = told.indices.to_numpy(zero_copy_only=False)
        count = sizes[codes]
        after = np.cumsum(count)
        out = flat[np.repeat(starts[codes] - (after - count), count) + np.arange(int(after[-1]) if len(after) else 0)]
        last = np.cumsum(per_text)
        return out, np.diff(np.append(0, np.append(0, after)[last]))


@lru_cache(maxsize=2)
def word_encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder of a vocabulary; tasks that follow one another in a worker share what it knows."""
    return WordEncoder(vocabulary)
