"""Language identification by word-first backoff.

A model holds, for each language, log frequencies of the words and of the character n-grams of 4 to 1 letters that it
was seen with. A known word scores by its log frequency in each language. An unseen word falls back to the longest
n-grams of it that are known at all: first its 4-grams, else 3-grams, and so on down to letters; their mean log
frequency scores the word. A document's language has the highest mean over words. Words are runs of letters and of
the marks that combine with them.

Training reads whole documents, at most about `docs_per_lang` of a language, chosen by a hash of the id; that bounds
the model, and nothing that was learned is cut. The model is sparse: for each term, by its 64-bit hash, only the
languages that it was seen in. Prediction reads every whole text, one pass, no shuffle.

Cases: null text or a text without a letter is `und` with score 0; so is everything if nothing could be
learned; documents with null lang, null text or null doc_id are not learned from; equal scores go to the
first language by code point; repeated rows are scored alike; columns lang_pred and score are replaced, all other
extra columns stay untouched; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, materialize


def _word_pattern(last: int) -> re.Pattern[str]:
    """A letter and the letters and marks that follow, among the characters up to `last`."""

    def ranges(kinds: str) -> str:
        held = [i for i in range(last + 1) if unicodedata.category(chr(i))[0] in kinds]
        cuts = [i for i, (a, b) in enumerate(itertools.pairwise(held)) if b != a + 1]
        return "".join(f"\\U{held[a]:08x}-\\U{held[b]:08x}" for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(held) - 1], strict=True))

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


#: Patterns of few characters match faster: ASCII, Latin, the first plane. The whole one is built when it is first needed.
_ASCII, _LATIN, _PLANE = re.compile("[A-Za-z]+"), _word_pattern(0x24F), _word_pattern(0xFFFF)
_whole = cache(partial(_word_pattern, sys.maxunicode))
_BEYOND_LATIN, _BEYOND_PLANE = re.compile("[^\\u0000-\\u024f]"), re.compile("[^\\u0000-\\uffff]")


def find_words(text: str) -> list[str]:
    """The words of a text."""
    if text.isascii():
        return _ASCII.findall(text)
    if not _BEYOND_LATIN.search(text):
        return _LATIN.findall(text)
    return (_whole() if _BEYOND_PLANE.search(text) else _PLANE).findall(text)


ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Numbers in a worker's cache of word scores.
CACHE_NUMBERS = 4_000_000
#: Texts whose new words are looked up together.
SCORED_TEXTS = 64


def _hashes(terms: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms], np.uint64)


@dataclass
class Terms:
    """Terms of one kind: sorted hashes, and for each the languages seen with it and by how much they beat the unseen."""

    hashes: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    unseen: np.ndarray  # log frequency of a term not seen, by language

    @classmethod
    def of(cls, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> Terms:
        order = np.argsort(hashes, kind="stable")
        names, starts = np.unique(hashes[order], return_index=True)
        total = np.bincount(langs, weights=counts, minlength=n_langs) + 0.5 * len(names)
        gains = np.log((counts[order] + 0.5) / 0.5).astype(np.float32)
        return cls(names, np.append(starts, len(hashes)), langs[order], gains, np.log(0.5 / np.maximum(total, 0.5)))

    def rows(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of terms in every language, and which of the terms are known."""
        wanted = _hashes(terms)
        at = np.minimum(np.searchsorted(self.hashes, wanted), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == wanted if len(self.hashes) else np.zeros(len(terms), bool)
        out = np.broadcast_to(self.unseen, (len(terms), len(self.unseen))).copy()
        rows = np.flatnonzero(known)
        first = self.starts[at[rows]]
        count = self.starts[at[rows] + 1] - first
        flat = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out[np.repeat(rows, count), self.langs[flat]] += self.gains[flat]
        return out, known


@dataclass
class LanguageModel:
    langs: list[str]
    kinds: dict[int, Terms]  # 0: words, else the n of n-grams

    def backoff(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not known: each from its longest known n-grams."""
        out, todo, padded = np.zeros((len(words), len(self.langs))), range(len(words)), [f"<{w}>" for w in words]
        for n in ORDERS:
            grams = [(i, padded[i][j : j + n]) for i in todo for j in range(len(padded[i]) - n + 1)]
            if grams:
                rows, known = self.kinds[n].rows([g for _, g in grams])
                owner = np.array([i for i, _ in grams])[known]
                held, sums = np.bincount(owner, minlength=len(words)), np.zeros_like(out)
                np.add.at(sums, owner, rows[known])
                out[held > 0] = sums[held > 0] / held[held > 0, None]
                todo = [i for i in todo if not held[i]]
        return out

    def scorer(self):
        """A function from texts to (language, score), which remembers the scores of words."""
        langs = self.langs
        most = max(1_000, CACHE_NUMBERS // max(1, len(langs)))
        place: dict[str, int] = {}
        table = np.zeros((0, len(langs)))

        def learn(words: list[str]) -> None:
            nonlocal table
            if len(place) + len(words) > most:
                place.clear()
            rows, known = self.kinds[0].rows(words)
            unknown = np.flatnonzero(~known)
            rows[unknown] = self.backoff([words[i] for i in unknown])
            start = len(place)
            if start + len(words) > len(table):
                table = np.concatenate([table[:start], np.zeros((start + 2 * len(words) + len(table), len(langs)))])
            table[start : start + len(words)] = rows
            place.update(zip(words, range(start, start + len(words)), strict=True))

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            found = []
            counts = [Counter(find_words(t.lower())) if t and langs else {} for t in texts]
            fresh = list(dict.fromkeys(w for c in counts for w in c if w not in place))
            if fresh:
                if len(place) + len(fresh) > most:  # the cache is emptied, so all words of these texts are learned
                    fresh = list(dict.fromkeys(w for c in counts for w in c))
                learn(fresh)
            for c in counts:
                if not c:
                    found.append((UNKNOWN, 0.0))
                    continue
                n = np.fromiter(c.values(), np.float64, len(c))
                mean = n @ table[np.fromiter(map(place.__getitem__, c), np.int64, len(c))] / n.sum()
                odds = np.exp((mean - mean.max()) * min(n.sum(), 20.0))
                best = int(np.argmax(mean))
                found.append((langs[best], float(odds[best] / odds.sum())))
            return found

        return score


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, int, str]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in Counter(find_words(text.lower())).items():
                counts[lang, 0, word] += n
                padded = f"<{word}>"
                for order in ORDERS:
                    for i in range(len(padded) - order + 1):
                        counts[lang, order, padded[i : i + order]] += n
        keys = list(zip(*counts, strict=True)) if counts else [[], [], []]
        hashes = pa.array(_hashes(list(keys[2])).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), hashes, pa.array(list(counts.values()), pa.int64())], ["lang", "kind", "term", "n"])


def train(docs: DataFrame, *, docs_per_lang: int = 1_500, sample_bytes: int = 48 << 20) -> LanguageModel:
    """docs: doc_id, text, lang of the documents to learn from.

    About docs_per_lang documents a language are learned whole, and fewer where those of all languages would come to more
    than sample_bytes: each language then has an equal part of them. So what is learned, collected and broadcast is bounded
    in bytes, however many languages there are and however long their texts.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    sizes = materialize(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")), "language-sizes")
    part = sample_bytes / max(1, sizes.count())
    wanted = F.least(F.lit(1.0), docs_per_lang / F.col("n"), part / F.greatest("bytes", F.lit(1)))
    share = sizes.select("lang", (wanted * (1 << 20)).alias("share"))  # a row a language
    chosen = docs.join(share, "lang").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("learn")), F.lit(1 << 20)) < F.col("share"))
    counts = chosen.select("text", "lang").mapInArrow(_count_terms, "lang string, kind int, term long, n long").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    learned = counts.toArrow()  # 20 bytes or so for each term of at most about sample_bytes of text
    langs = sorted(learned.column("lang").unique().to_pylist())
    lang = np.searchsorted(np.array(langs), np.array(learned.column("lang").to_pylist())) if langs else np.zeros(0, np.int64)
    kind, term, n = (learned.column(c).to_numpy() for c in ("kind", "term", "n"))
    return LanguageModel(langs, {k: Terms.of(term[kind == k].view(np.uint64), lang[kind == k], n[kind == k].astype(np.float64), len(langs)) for k in (0, *ORDERS)})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score appended (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [x for at in range(0, len(texts), SCORED_TEXTS) for x in score(texts[at : at + SCORED_TEXTS])]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, extended(docs, lang_pred="string", score="double"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
