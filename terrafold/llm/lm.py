"""Operator 7: language-model scores of documents, by a weighted backoff automaton over tokens.

Tokens are words (any script, lower case), single CJK and astral characters, and runs of other characters between
blanks. All pairs of consecutive tokens of all texts are counted, so the model grows with the corpus. A state is a
token that occurs (or a text's beginning), with how often tokens follow it and how many different ones; its arcs are
the pairs that occur, its failure arc leads to the root, whose arcs are the tokens. By Witten and Bell's method an arc
weighs log2((c + k * p1) / (t + k)), c being the pair's count, t and k the state's followers and different followers,
p1 the token's probability at the root; a missing arc is the same with c = 0, that is the failure arc's k / (t + k)
times p1. A document is scored in one traversal from the left that carries the state and adds up the weights.

Arcs keep c, so that no exchange is needed to bring p1 to them, and the weight is taken where it is used. Tasks count
pairs and send them to the part of their first token; a part's arcs and states are merged and sorted by one task, which
writes them to the shared folder. Nothing of the model passes through the driver but its two sums. Scoring tasks map
the files and look up each distinct pair of a slice once, in the files' order. Tokens are compared as 64-bit hashes,
pairs as 48 bits of hash beside 16 of the first token.
"""

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import tok
from terrafold.llm.base import own_folder, small_batches

#: Tokens that a task counts before it sends them.
HELD_TOKENS = 1 << 22
_BEGIN, _END = np.uint64(0x51ED270B7F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_K = np.uint64(tok.Q)


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of pairs: the first 16 bits of the first word's hash, which name the part, and 48 of the pair's."""
    return (u & np.uint64(0xFFFF << 48)) | (tok.mix(u * _K + w) >> np.uint64(16))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def _before(w: tok.Words) -> np.ndarray:
    """The token before each token, or the beginning."""
    u = np.append(_BEGIN, w.hash[:-1])[: len(w.hash)]
    u[w.first[:-1][w.counts() > 0]] = _BEGIN
    return u


def _counted(batches, parts: int, most: int):
    held, size = [], 0

    def sent():
        u, w = (np.concatenate(x) for x in zip(*held))
        g, at, n = np.unique(pair_keys(u, w), return_index=True, return_counts=True)
        order = np.lexsort((g, u[at]))
        u, g, n = u[at][order], g[order], n[order]
        bounds = np.searchsorted(_part(u, parts), np.arange(parts + 1))
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        rows = []
        for p in full:
            a, z = bounds[p], bounds[p + 1]
            us, ks = np.unique(u[a:z], return_counts=True)
            rows.append((us.tobytes(), ks.astype(np.uint32).tobytes(), g[a:z].tobytes(), n[a:z].astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in zip(*rows)]], ["part", "us", "ks", "gs", "ns"])

    for batch in batches:
        for _, part in tok.slices(batch.column(0), 1 << 21):
            w = tok.Words(part, every=True)
            if len(w.hash):
                last = w.hash[w.first[1:][w.counts() > 0] - 1]
                held.append((np.append(_before(w), last), np.append(w.hash, np.full(len(last), _END))))
                size += len(held[-1][0])
            if size >= most:
                yield from sent()
                held, size = [], 0
    if held:
        yield from sent()


def _save(folder: str, name: str, arr: np.ndarray) -> None:
    """Whole or not at all, also where a task runs twice."""
    own = os.path.join(folder, f".{uuid.uuid4().hex}.npy")
    np.save(own, arr)
    os.replace(own, os.path.join(folder, f"{name}.npy"))


def _merged(batches, folder: str):
    """Writes the arcs and states of each part; (tokens, kinds) of it."""
    by_part: dict[int, list] = {}
    for batch in batches:
        for p, *blobs in zip(*[c.to_pylist() for c in batch.columns]):
            by_part.setdefault(p, []).append(blobs)
    for p, rows in by_part.items():
        us, ks, gs, ns = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate((np.uint64, np.uint32, np.uint64, np.uint32)))
        g, at, where = np.unique(gs, return_index=True, return_inverse=True)
        n = np.bincount(where, ns, len(g)).astype(np.int64)
        u = np.repeat(us, ks)[at]
        state, of = np.unique(u, return_inverse=True)
        end = pair_keys(state, np.full(len(state), _END))
        i = np.minimum(np.searchsorted(g, end), len(g) - 1)
        ended = g[i] == end
        ends = np.where(ended, n[i], 0)
        seen = np.bincount(of, n, len(state)).astype(np.int64)
        followed, kinds = seen - ends, np.bincount(of, minlength=len(state)) - ended
        seen[state == _BEGIN] = 0
        _save(folder, f"{p}-arcs", g)
        _save(folder, f"{p}-counts", n.astype(np.uint32) if n.max() < 1 << 32 else n)
        _save(folder, f"{p}-states", state)
        _save(folder, f"{p}-sums", np.stack([seen, followed, kinds]))
        yield pa.RecordBatch.from_arrays([pa.array([int(seen.sum())]), pa.array([int((seen > 0).sum())])], ["tokens", "kinds"])


class Model:
    """The files of a folder, mapped when first used."""

    def __init__(self, folder: str, parts: int, tokens: int, kinds: int):
        self.folder, self.parts, self.tokens, self.kinds = folder, parts, tokens, kinds
        self.open: dict[str, np.ndarray | None] = {}

    def _file(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = os.path.join(self.folder, f"{name}.npy")
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def _found(self, keys: np.ndarray, names: str, values: str, out: np.ndarray) -> np.ndarray:
        """out with the values of those sorted keys that the files have."""
        bounds = np.searchsorted(_part(keys, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(bounds[1:] > bounds[:-1]):
            have = self._file(f"{p}-{names}")
            if have is None:
                continue
            a, z = bounds[p], bounds[p + 1]
            i = np.minimum(np.searchsorted(have, keys[a:z]), len(have) - 1)
            out[..., a:z] = np.where(have[i] == keys[a:z], self._file(f"{p}-{values}")[..., i], 0)
        return out

    def weights(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log2 of the probability of each token w after u. The tokens of the corpus and one class of all others sum to 1."""
        both, where = np.unique(np.concatenate([u, w]), return_inverse=True)
        seen, followed, kinds = self._found(both, "states", "sums", np.zeros((3, len(both)), np.int64))
        g, pair = np.unique(pair_keys(u, w), return_inverse=True)
        c = self._found(g, "arcs", "counts", np.zeros(len(g), np.int64))[pair]
        first, second = where[: len(u)], where[len(u) :]
        p1 = (seen[second] + self.kinds / (self.kinds + 1)) / (self.tokens + self.kinds) if self.tokens else np.ones(len(w))
        t, k = followed[first], kinds[first]
        return np.log2(np.where(t > 0, (c + k * p1) / np.maximum(t + k, 1), p1))


def score(model: Model, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the probability of each text's tokens, and how many they are."""
    w = tok.Words(part, every=True)
    counts = w.counts()
    return np.bincount(np.repeat(np.arange(len(counts)), counts), model.weights(_before(w), w.hash), len(counts)), counts


def train(corpus: DataFrame) -> Model:
    spark = corpus.sparkSession
    small_batches(spark)
    folder = own_folder(spark, "lm")
    most, parts = HELD_TOKENS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    pairs = corpus.filter(F.col("text").isNotNull()).select("text").mapInArrow(lambda it: _counted(it, parts, most), "part int, us binary, ks binary, gs binary, ns binary")
    sums = pairs.repartition(parts, "part").mapInArrow(lambda it: _merged(it, folder), "tokens bigint, kinds bigint").agg(F.sum("tokens"), F.sum("kinds")).first()
    return Model(folder, parts, sums[0] or 0, sums[1] or 0)


def _scored(batches, model: Model):
    for batch in batches:
        for at, part in tok.slices(batch.column(1)):
            none = part.is_null().to_numpy(zero_copy_only=False)
            total, counts = score(model, part)
            bits = np.where(counts > 0, -total / np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), pa.array(counts, mask=none), pa.array(total, mask=none), pa.array(bits, mask=none | (counts == 0))],
                ["doc_id", "n_tokens", "log2_prob", "bits_per_token"],
            )


def score_documents(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log2_prob, bits_per_token) for every row, by the model of `corpus`, or of docs themselves.

    Every text counts once for each row it stands in. A null text has null scores and isn't counted; an empty one, or
    one of blanks, has 0 tokens, log2_prob 0 and null bits. A null doc_id and repeated rows are kept as they are. Texts
    are scored whole. Further columns, whatever their names, are left out. With an empty corpus any token is certain
    to be an unknown one. The model's files stay until the driver's process ends, as the result reads them.
    """
    model = train(docs if corpus is None else corpus)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, model), "doc_id bigint, n_tokens bigint, log2_prob double, bits_per_token double")
