"""Operator 4: byte-pair encoding and decoding with a given vocabulary.

Texts are split by the vocabulary's pattern; each new word of a task is merged once. The symbols of many words lie in
one flat array. A round finds the rank of each changed neighbouring pair by binary search over the sorted pair keys,
takes each word's lowest rank, and merges all its places at once; words without a mergeable pair leave the array.
"""

import base64
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import tok
from terrafold.llm.base import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 300_000
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Arrays of a rank file: bytes of each token, and which token each pair of tokens makes."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    a, b = line.split()
                    ranks[base64.b64decode(a)] = int(b)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for t, r in ranks.items():
            by_id[r] = t
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token, and so the rank, that each pair makes."""
        k = (a.astype(np.int64) << 32) | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.made[i], _NONE)


def merge_words(vocab: Vocabulary, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words in one array, and how many each has. No word is empty."""
    lengths = np.array([len(p) for p in parts], np.int64)
    sym = vocab.of_byte[np.frombuffer(b"".join(parts), np.uint8)]
    word = np.repeat(np.arange(len(parts)), lengths)
    done_word, done_sym = [], []
    rank = np.full(len(sym), _NONE, np.int32)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = vocab.rank(sym[inside], sym[inside + 1])
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(starts, len(sym)))
        low = np.minimum.reduceat(rank, starts)
        over = np.repeat(low == _NONE, count)
        if over.any():
            done_word.append(word[over])
            done_sym.append(sym[over])
            stay = ~over
            sym, word, rank = sym[stay], word[stay], rank[stay]
            low, count = low[low != _NONE], count[low != _NONE]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, count))
        # of neighbouring places of one rank, as in aaa, every other one from the left
        run = np.append(True, np.diff(at) > 1)
        first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
        at = at[(at - first) % 2 == 0]
        sym[at] = rank[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep)[at] - 1
        sym, word, rank = sym[keep], word[keep], rank[keep]
        changed = np.concatenate([moved, moved[moved > 0] - 1])
        rank[changed] = _NONE
        changed = changed[changed + 1 < len(sym)]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed] = vocab.rank(sym[changed], sym[changed + 1])
    word, sym = np.concatenate(done_word), np.concatenate(done_sym)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(parts))


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of values, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(total)]


class Encoder:
    def __init__(self, vocab: Vocabulary, pattern: str = PATTERN):
        self.vocab, self.find = vocab, regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in one array, and how many each has."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        before, get, find = len(self.index), self.index.__getitem__, self.find
        ids, counts = [], []
        for t in texts:
            found = find(t)
            counts.append(len(found))
            ids.extend(map(get, found))
        if len(self.index) > before:
            fresh = [w.encode() for w in list(self.index)[before:]]
            tokens, lengths = merge_words(self.vocab, fresh)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, tokens])
        words = np.array(ids, np.int64)
        lengths = self.lengths[words]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts)).astype(np.int64)]
        return _gather(self.flat, self.starts[words], lengths), np.diff(ends)


def decode_bytes(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each begins and the last ends."""
    lengths = vocab.lengths[ids]
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts)).astype(np.int64)]
    return _gather(vocab.bytes, vocab.starts[ids], lengths), ends


def _encoded(batches, vocab: Vocabulary, pattern: str):
    enc = Encoder(vocab, pattern)
    for batch in batches:
        for at, part in tok.slices(batch.column(1)):
            valid = part.is_valid().to_numpy(zero_copy_only=False)
            texts = ["" if t is None else t for t in part.to_pylist()]
            ids, counts = enc.encode(texts)
            back, ends = decode_bytes(vocab, ids, counts)
            raw = "".join(texts).encode()
            sizes = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
            if np.array_equal(sizes, ends) and raw == back.tobytes():
                exact = np.ones(len(texts), bool)
            else:
                exact = np.array([raw[sizes[k] : sizes[k + 1]] == back[ends[k] : ends[k + 1]].tobytes() for k in range(len(texts))])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids), mask=pa.array(~valid))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), lists, pa.array(counts.astype(np.int64), mask=~valid), pa.array(exact, mask=~valid)], ["doc_id", "tokens", "n_tokens", "exact"]
            )


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for every row; exact says that the tokens decode to the very text.

    A null text has null in all three columns, an empty one no tokens. A null doc_id and repeated rows are kept as
    they are. Texts are encoded whole, single words of any length too. Further columns are left out, whatever their
    names. The driver reads the vocabulary; its arrays, of fixed size, go to the tasks.
    """
    small_batches(docs.sparkSession)
    vocab = Vocabulary(path)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lambda it: _encoded(it, vocab, pattern), "doc_id bigint, tokens array<int>, n_tokens bigint, exact boolean"
    )


def _decoded(batches, vocab: Vocabulary):
    for batch in batches:
        col = batch.column(1)
        counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(pc.list_flatten(col), -1).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(vocab.lengths))
        back, ends = decode_bytes(vocab, np.where(known, ids, 0), counts)
        valid = col.is_valid().to_pylist()
        if known.all():
            texts = [back[ends[k] : ends[k + 1]].tobytes().decode("utf-8", "replace") if ok else None for k, ok in enumerate(valid)]
        else:
            texts, at = [], 0
            for c, ok in zip(counts.tolist(), valid):
                one = b"".join(vocab.bytes[vocab.starts[i] : vocab.starts[i] + vocab.lengths[i]].tobytes() if k else "�".encode() for i, k in zip(ids[at : at + c].tolist(), known[at : at + c].tolist()))
                texts.append(one.decode("utf-8", "replace") if ok else None)
                at += c
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens). Null tokens give null, none the empty text; an id that the vocabulary lacks, or null, and bytes that are no UTF-8 become U+FFFD."""
    vocab = Vocabulary(path)
    return encoded.select("doc_id", "tokens").mapInArrow(lambda it: _decoded(it, vocab), "doc_id bigint, text string")
