"""Operator 9: near-duplicate documents by circulant MinHash.

The items of a document are its runs of `SHINGLE` words, hashed to 32 bits for the signature. Two permutations of the
32-bit numbers make all coordinates: sigma scatters the items, and coordinate k is the minimum of pi, shifted
circularly by k, over them. Signatures are cut into bands; documents that agree in a band are candidates, and each
candidate pair's Jaccard similarity is then computed from the full sets of 64-bit shingles.

Documents of the same words are one candidate from the start. Within a band's bucket each document is compared with
the bucket's smallest id; one that fails there is compared with all others of the bucket that aren't already in its
group. So no pair is left out that could join two groups, and a bucket of thousands of copies costs as many
comparisons as it has documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm import tok
from terrafold.llm.base import cut, small_batches
from terrafold.llm.graph import components

SHINGLE = 3
BANDS = 24
ROWS = 4
THRESHOLD = 0.6
_C = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x7FEB352D, 0x846CA68B)]


def _permute(x: np.ndarray, c1: np.uint32, c2: np.uint32, tmp: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    for shift, c in ((16, c1), (13, c2)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, c, out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    return np.bitwise_xor(x, tmp, out=x)


def shingles(words: tok.Words) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of a slice and how many each document has; a document of fewer words than a shingle is one itself."""
    counts = words.counts()
    g = words.grams(SHINGLE)
    doc = np.repeat(np.arange(len(counts)), counts)
    last = words.first[1:][doc]
    at = np.arange(len(g))
    stay = at + SHINGLE <= last
    short = (counts > 0) & (counts < SHINGLE)
    if short.any():
        heads = words.first[:-1][short]
        g[heads] = words.whole(tok.Q)[short]
        stay[heads] = True
    return g[stay], np.where(short, 1, np.maximum(counts - SHINGLE + 1, 0))


def signature(items: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """size x documents: coordinate k is min over items of pi(sigma(item) - k); starts: the first item of each document, all of which have some."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    tmp, v = np.empty_like(x), np.empty_like(x)
    _permute(x, _C[0], _C[1], tmp)
    out = np.empty((size, len(starts)), np.uint32)
    for k in range(size):
        np.subtract(x, np.uint32(k), out=v)
        out[k] = np.minimum.reduceat(_permute(v, _C[2], _C[3], tmp), starts)
    return out


def _signed(batches):
    for batch in batches:
        for at, part in tok.slices(batch.column(1), 1 << 19):
            w = tok.Words(part)
            items, counts = shingles(w)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            starts = np.append(0, np.cumsum(counts[some])[:-1])
            sig = signature(items, starts, BANDS * ROWS).astype(np.uint64).reshape(BANDS, ROWS, -1)
            bands = np.zeros((BANDS, len(some)), np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]
            for r in range(ROWS):
                bands = tok.mix(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
            flat = pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), flat)
            keys = [pa.array(w.whole(m)[some].view(np.int64)) for m in (tok.Q, tok.P)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + at)), *keys, lists], ["doc_id", "k1", "k2", "bands"])


def _sets(batches):
    for batch in batches:
        for at, part in tok.slices(batch.column(1)):
            items, counts = shingles(tok.Words(part))
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((items, doc))
            items, doc = items[order], doc[order]
            new = np.append(True, (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])) if len(items) else np.zeros(0, bool)
            ends = np.searchsorted(doc[new], np.arange(len(counts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(items[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists], ["doc_id", "sh"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their Jaccard similarity j."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb")), "b")
    both = two.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.select("a", "b", (F.col("i") / (F.col("n") - F.col("i"))).alias("j"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id): a row for each document that goes, with the smallest id of its group, which stays.

    Groups are the connected components of the pairs with a similarity of `threshold` or more among the candidates.
    Rows with a null doc_id or text, and texts without a word, are in no group. Rows that share a doc_id are one
    document with several texts: they stay or go together. Texts are read whole. Other columns aren't looked at, so
    their names don't matter. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = cut(rows.mapInArrow(_signed, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    same = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    copies = signed.select("doc_id", "k1", "k2").join(same.filter("n > 1").select("k1", "k2", "rep"), ["k1", "k2"]).filter("doc_id <> rep")
    exact = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    entries = same.select("rep", F.explode("bands").alias("bucket"))
    led = cut(entries.select("bucket", "rep", F.min("rep").over(Window.partitionBy("bucket")).alias("leader")).filter("rep <> leader"))
    star = led.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    ids = star.select("a").unionAll(star.select("b")).distinct().withColumnRenamed("a", "doc_id")
    sets = cut(rows.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, sh array<bigint>"))
    checked = cut(_verified(star, sets))
    good = checked.filter(F.col("j") >= threshold).select("a", "b")
    edges = cut(exact.unionAll(good))
    labels = components(edges)
    failed = led.join(checked.groupBy("a", "b").agg(F.max("j").alias("j")).filter(F.col("j") < threshold), (led["leader"] == F.col("a")) & (led["rep"] == F.col("b"))).select("bucket", F.col("rep").alias("x"))
    rest = failed.join(led.select("bucket", F.col("rep").alias("y")), "bucket").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    apart = rest.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    more = cut(_verified(apart, sets).filter(F.col("j") >= threshold).select("a", "b"))
    # what the second comparisons found joins groups that are already whole
    groups = labels.select(F.col("label").alias("a"), F.col("id").alias("b"))
    final = components(groups.unionAll(more)) if not more.isEmpty() else labels
    return final.filter("id <> label").select(F.col("id").alias("doc_id"), F.col("label").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that `near_duplicates` says go; of rows with the same doc_id and text one stays, those with a null doc_id all do."""
    gone = near_duplicates(docs, threshold).select(F.col("doc_id").alias("gone_id"))
    named = docs.filter(docs["doc_id"].isNotNull()).dropDuplicates(["doc_id", "text"])
    return named.join(gone, named["doc_id"] == gone["gone_id"], "left_anti").unionByName(docs.filter(docs["doc_id"].isNull()))
