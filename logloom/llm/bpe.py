"""BPE encoding and decoding with forced boundaries.

A merge can only join two symbols that stand side by side inside some token of the vocabulary. Wherever two neighbouring
symbols of a word never do, every encoding has a cut. Words are split at these certain cuts, the fragments are encoded
each on its own and their ids are concatenated; the result is that of the whole word. Fragments are short, so even a
"word" of a megabyte is encoded in small pieces; what can't be cut is merged with a heap in n log n steps.

The vocabulary is a tokenizer file with byte-level symbols and word ends. Its path is a parameter; every executor reads
it itself, and nothing is trained.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered with their ids, besides those of the texts at hand.
REMEMBERED_WORDS = 400_000
#: Fragments of more symbols than this are merged with a heap.
LONG_FRAGMENT = 64
#: Texts whose words are encoded together.
TEXTS_AT_ONCE = 400


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Vocabulary:
    """Tokens, merges and the symbol pairs inside tokens, read from a tokenizer file; symbols are their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.n = len(ids)
        keys = np.array([ids[a] * self.n + ids[b] for a, b in model["merges"]])
        order = np.argsort(keys)
        # The last entry answers for every pair without a merge.
        self.keys, self.key_ranks = np.append(keys[order], -1), np.append(order, len(keys)).astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in model["merges"]] + [-1], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**ids, **self.specials}.items()}
        symbols = byte_symbols()
        self.inner, self.last = (np.array([ids[c + e] for c in symbols], np.int32) for e in ("", self.end))
        inside: set[int] = set()
        for token in ids:
            parts = [ids[c] for c in self._symbols(token)] if token not in self.specials else []
            inside.update(a * self.n + b for a, b in zip(parts, parts[1:]))
        self.inside = np.array(sorted(inside))

    def _symbols(self, token: str) -> list[str]:
        """A token's symbols; the word end belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; the number of merges where a pair has none."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.key_ranks[at], self.key_ranks[-1])

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. All words are cut at their forced boundaries; fragments of one length are merged together."""
        if not words:
            return []
        data = [w.encode("utf-8", "replace") for w in words]
        ends = np.cumsum([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        pair = symbols[:-1].astype(np.int64) * self.n + symbols[1:]
        at = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
        cut = self.inside[at] != pair
        cut[ends[:-1] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        lengths = np.diff(np.append(starts, len(symbols)))
        out = np.full(len(symbols), -1, np.int32)
        for n in np.unique(lengths).tolist():
            mine = starts[lengths == n]
            if n <= LONG_FRAGMENT:
                places = mine[:, None] + np.arange(n)
                out[places] = self._merge(symbols[places])
            else:
                for k in mine.tolist():
                    ids = self._merge_long(symbols[k : k + n].tolist())
                    out[k : k + len(ids)] = ids
        # What merges have freed is -1; a word's ids are what is left between its ends.
        taken = out >= 0
        flat, stops = out[taken].tolist(), np.cumsum(taken)[ends - 1].tolist()
        return [flat[i:j] for i, j in zip([0, *stops], stops)]

    def _merge(self, s: np.ndarray) -> np.ndarray:
        """Rows of symbols -> rows of ids, -1 behind them: each round merges every row's pair of lowest rank, the leftmost of equals."""
        out, rows, none = np.full_like(s, -1), np.arange(len(s)), self.key_ranks[-1]
        ranks = self._ranks(s[:, :-1], s[:, 1:])
        while True:
            going = ranks.min(1, initial=none) < none
            if not going.all():
                out[rows[~going], : s.shape[1]] = s[~going]
                s, ranks, rows = s[going], ranks[going], rows[going]
            if not len(rows):
                return out
            k, every = ranks.argmin(1), np.arange(len(rows))
            s[every, k] = self.merged[ranks[every, k]]
            # One place fewer: what stands right of the merged pair moves up.
            columns = np.arange(s.shape[1] - 1)
            moved = columns + (columns > k[:, None])
            s = np.take_along_axis(s, moved, 1)
            ranks = np.take_along_axis(ranks, moved[:, :-1], 1) if s.shape[1] > 1 else ranks[:, :0]
            for side in (k - 1, k):
                ok = (side >= 0) & (side < s.shape[1] - 1)
                at = side[ok]
                a, b = s[every[ok], at], s[every[ok], at + 1]
                ranks[every[ok], at] = np.where((a >= 0) & (b >= 0), self._ranks(a, b), none)

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same merges in n log n steps: a heap of pairs over a linked list of symbols."""
        none = int(self.key_ranks[-1])

        def ranked(at: int) -> tuple[int, int, int, int]:
            a, b = s[at], s[right[at]]
            return int(self._ranks(np.array([a]), np.array([b]))[0]), at, a, b

        right, left = [*range(1, len(s)), -1], [-1, *range(len(s) - 1)]
        heap = [(r, k, s[k], s[k + 1]) for k, r in enumerate(self._ranks(np.array(s[:-1]), np.array(s[1:])).tolist()) if r < none]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = right[k]
            if j < 0 or s[k] != a or s[j] != b:
                continue
            s[k], s[j], right[k] = int(self.merged[rank]), -1, right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for at in (left[k], k):
                if at >= 0 and right[at] >= 0 and (pair := ranked(at))[0] < none:
                    heapq.heappush(heap, pair)
        return [x for x in s if x >= 0]


class Encoder:
    """Text -> ids: special tokens, normal form, words, forced boundaries."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.specials, key=len, reverse=True))) or "(?!)")
        # Fixed values, given by the tokenizer file: what counts as white space, and what counts as a word.
        self.gap = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
        self.known: dict[str, tuple[int, ...]] = {}

    def _runs(self, text: str) -> list[str]:
        """What stands between gaps, in normal form and lower case."""
        # One character at a time: a capital sigma has one lower form, wherever it stands.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # split() also takes these four for white space, which the vocabulary's rule does not.
        return self.gap.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _pieces(self, text: str) -> list[str]:
        """Runs and special tokens; with an unused character before a special token, which no run holds."""
        if not self.special.search(text):
            return self._runs(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._runs(text[at : m.start()]), f" {m.group()}"]
            at = m.end()
        return out + self._runs(text[at:])

    def _words(self, run: str) -> list[str]:
        """A run's words; letters alone and letters with one mark behind need no pattern."""
        if run.isalpha():
            return [run]
        if run[:-1].isalpha() and not run[-1].isalnum():
            return [run[:-1], run[-1]]
        return self.words.findall(run)

    def _learn(self, runs: set[str]) -> None:
        """Remember the ids of new runs; their words are encoded together."""
        split = {run: self._words(run) for run in runs if run[:1] != " "}
        new = [*set(chain.from_iterable(split.values())).difference(self.known)]
        self.known.update(zip(new, map(tuple, self.vocabulary.words(new))))
        get = self.known.__getitem__
        self.known.update((run, tuple(chain.from_iterable(map(get, words)))) for run, words in split.items() if len(words) != 1)
        self.known.update((run, (self.vocabulary.specials[run[1:]],)) for run in runs if run[:1] == " ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self._pieces(t) for t in texts]
        asked = set().union(*pieces)
        if len(self.known) + 2 * len(asked) > REMEMBERED_WORDS:
            self.known.clear()
        self._learn(asked.difference(self.known))
        get = self.known.__getitem__
        return [[*chain.from_iterable(map(get, some))] for some in pieces]


def _encoded(path: str, decode: bool):
    """Texts -> ids, and their decoded text with ``decode``. Few texts leave at a time, so results stay small."""

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        decoder = Decoder(encoder.vocabulary)
        for texts in batches:
            for start in range(0, len(texts), TEXTS_AT_ONCE):
                ids = encoder.encode([t or "" for t in texts.slice(start, TEXTS_AT_ONCE).to_pylist()])
                ids = pa.array(ids, pa.list_(pa.int32()))
                yield pa.StructArray.from_arrays([ids, decoder.decode(ids)], ["ids", "decoded"]) if decode else ids

    return F.arrow_udf(encoded, "struct<ids:array<int>,decoded:string>" if decode else "array<int>")


class Decoder:
    """Ids -> their tokens with one space between."""

    def __init__(self, vocabulary: Vocabulary):
        names = vocabulary.tokens
        self.tokens = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    def decode(self, lists: pa.Array) -> pa.Array:
        ends = np.cumsum(np.append(0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.tokens.take(lists.flatten())), " ")
        return pc.if_else(lists.is_valid(), joined, None)


def _decoded(path: str):
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(Vocabulary(path))
        for lists in batches:
            for start in range(0, len(lists), TEXTS_AT_ONCE):
                yield decoder.decode(lists.slice(start, TEXTS_AT_ONCE))

    return F.arrow_udf(decoded, "string")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Documents with the ids of their whole text as array ``ids``. Null text counts as empty; empty text has no ids.

    Rows stay where they are: no shuffle, and one text at a time is encoded. A column named as ``ids`` is replaced.
    """
    return docs.withColumn(ids, _encoded(path, False)(F.col(f"`{text}`")))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Documents with ``decoded``: the tokens of ``ids``, special ones too, with one space between. Null ids give null."""
    return docs.withColumn(decoded, _decoded(path)(F.col(f"`{ids}`")))


def recode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Documents with ``ids`` and ``decoded``, as by ``encode`` and ``decode`` but in one pass; columns of these names are replaced."""
    both = docs.withColumn("__coded", _encoded(path, True)(F.col(f"`{text}`")))
    return both.withColumn("ids", F.col("__coded.ids")).withColumn("decoded", F.col("__coded.decoded")).drop("__coded")
