"""Operator 2: removal of benchmark passages.

The benchmark's runs of `NGRAM` normalised words (a shorter item is one run itself) are a broadcast hash set. All
windows of words of a document are hashed; hits are verified word by word, and the union of the hit windows goes, or
the whole document if that is `drop_share` of its words or more. The documents are read once, without a shuffle.

The set is flat arrays: sorted hashes, and for each a stretch of the items' normalised text, which verification compares; some
`SET_FACTOR` bytes for each byte of text. A benchmark whose set would be over `SET_BYTES` is cut into parts of at most that
size; the documents then pass one scan after another in the same stage, each with its own part, and what goes is
decided after the last.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import tok
from terrafold.llm.base import others, restored, small_batches

NGRAM = 13
MIN_ITEM = 5
DROP_SHARE = 0.5
SET_BYTES = 64 << 20
SET_FACTOR = 6


class Grams:
    """The runs of words of some items, by length: sorted hashes, and where each begins and ends in `text`."""

    def __init__(self, texts: list[str | None], n: int, min_item: int):
        found: dict[int, list] = {}
        parts, size = [], 0
        for _, part in tok.slices(pa.array(texts, pa.string())):
            w = tok.Words(part)
            lengths = w.end - w.start
            # all words, with a blank behind each
            ends = np.cumsum(lengths + 1)
            begin = ends - lengths - 1
            flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
            inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            flat[np.repeat(begin, lengths) + inside] = w.bytes[np.repeat(w.start, lengths) + inside]
            parts.append(flat)
            counts = w.counts()
            left = np.repeat(w.first[1:], counts) - np.arange(len(w.hash))  # words from here to the item's end
            own = np.repeat(np.minimum(counts, n), counts)
            for m in np.unique(own[own >= min_item]).tolist():
                at = np.flatnonzero((own == m) & (left >= m))
                both = [w.grams(m, q)[at] for q in (tok.Q, tok.P)]
                found.setdefault(m, []).append((*both, size + begin[at], size + ends[at + m - 1] - 1))
            size += len(flat)
        self.text = np.concatenate(parts).tobytes() if parts else b""
        self.tables = []
        for m, several in found.items():
            key, other, begin, end = (np.concatenate(x) for x in zip(*several))
            order = np.lexsort((other, key))
            new = np.append(True, (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]))
            self.tables.append((m, *(x[order][new] for x in (key, begin, end))))


def _bytes_of(w: tok.Words, k: int, n: int) -> bytes:
    return b" ".join(w.bytes[s:e].tobytes() for s, e in zip(w.start[k : k + n], w.end[k : k + n]))


def _hits(w: tok.Words, grams: Grams, bits: list[np.ndarray]) -> np.ndarray:
    """Which words lie in a verified window."""
    delta = np.zeros(len(w.hash) + 1, np.int64)
    limit = np.repeat(w.first[1:], w.counts())
    for (n, keys, begin, end), likely in zip(grams.tables, bits):
        g = w.grams(n)
        near = np.flatnonzero(likely[(g >> np.uint64(44)).astype(np.int64)])
        near = near[near + n <= limit[near]]
        if not len(near):
            continue
        first, behind = np.searchsorted(keys, g[near]), np.searchsorted(keys, g[near], "right")
        hit = behind > first
        for k, i, j in zip(near[hit].tolist(), first[hit].tolist(), behind[hit].tolist()):
            own = _bytes_of(w, k, n)
            if any(grams.text[begin[x] : end[x]] == own for x in range(i, j)):
                delta[k] += 1
                delta[k + n] -= 1
    return np.cumsum(delta)[:-1] > 0


def _likely(grams: Grams) -> list[np.ndarray]:
    """For each length which first 20 bits hashes of the set have."""
    out = []
    for _, keys, _, _ in grams.tables:
        bits = np.zeros(1 << 20, bool)
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        out.append(bits)
    return out


def _spans(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in tok.WORD.finditer(text)]
    out, done = [], 0
    for a, z in spans:
        out.append(text[done : at[a][0]])
        done = at[z - 1][1]
    return "".join([*out, text[done:]])


def _scan(batches, grams: Grams, final: bool, drop_share: float):
    """Of (text, marks, ...) with marks the spans found so far: the same with those found here added, or with the text cut if this is the last scan."""
    bits = _likely(grams)
    for batch in batches:
        texts, marks = batch.column(0), batch.column(1)
        spans: dict[int, list] = {}
        total: dict[int, int] = {}
        known = marks.is_valid().to_numpy(zero_copy_only=False)
        for at, part in tok.slices(texts):
            w = tok.Words(part)
            mark = _hits(w, grams, bits)
            counts = w.counts()
            doc = np.repeat(np.arange(len(counts)), counts)
            for d in np.union1d(np.unique(doc[mark]), np.flatnonzero(known[at : at + len(part)])).tolist():
                own = mark[w.first[d] : w.first[d + 1]]
                if known[at + d]:
                    for x in marks[at + d].as_py():
                        own[x["a"] : x["z"]] = True
                spans[at + d], total[at + d] = _spans(own), int(counts[d])
        n = len(texts)
        if not final:
            col = pa.array([[{"a": a, "z": z} for a, z in spans[k]] if k in spans else None for k in range(n)], marks.type)
            yield pa.RecordBatch.from_arrays([texts, col, *batch.columns[2:]], batch.schema.names)
            continue
        gone = np.zeros(n, np.int64)
        stay = np.ones(n, bool)
        if spans:
            new = texts.to_pylist()
            for k, s in spans.items():
                gone[k] = sum(z - a for a, z in s)
                stay[k] = gone[k] < drop_share * total[k]
                new[k] = without(new[k], s)
            texts = pa.array(new, pa.string())
        out = pa.RecordBatch.from_arrays([texts, pa.array(gone), *batch.columns[2:]], ["text", "words_removed", *batch.schema.names[2:]])
        yield out.filter(pa.array(stay)) if not stay.all() else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, min_item: int = MIN_ITEM, drop_share: float = DROP_SHARE, counted: str = "words_removed") -> DataFrame:
    """docs without the passages they share with the benchmark, and their number of words, in a column named by `counted`; documents of little else go.

    A passage is a run of `n` words or more that an item also has, whatever the case and punctuation; an item of fewer
    words, but at least `min_item`, counts as a whole, and one of less is no passage. Null and empty texts are kept as
    they are with 0 removed; null items match nothing. Repeated rows are treated alike, each for itself. Texts are
    scanned whole. Further columns are kept; a column of that name gives way to the operator's, and `n_chars`,
    if there, is computed anew. An empty benchmark leaves all as it is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size * SET_FACTOR / SET_BYTES))
    d = docs.select("text", F.lit(None).cast("array<struct<a:int,z:int>>").alias("marks"), "doc_id", others(docs, "doc_id", "text", counted))
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        grams = Grams([r[0] for r in part.toLocalIterator()], n, min_item)
        final = k == parts - 1
        schema = d.schema if not final else d.drop("marks").select("text", F.lit(0).cast("bigint").alias("words_removed"), "doc_id", "rest").schema
        d = d.mapInArrow(lambda it, g=grams, f=final: _scan(it, g, f, drop_share), schema)
    return restored(d.withColumnRenamed("words_removed", counted), docs, counted)


_W = "0-9A-Za-z_\\x{C0}-\\x{1FFF}\\x{2080}-\\x{2FFF}\\x{3040}-\\x{10FFFF}"
ORACLE = f"""
WITH parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_W}]+|[^{_W}]+')) AS p, generate_subscripts(regexp_extract_all(text, '[{_W}]+|[^{_W}]+'), 1) AS i FROM documents),
t AS (SELECT doc_id, i, p, regexp_matches(p, '^[{_W}]') AS is_word, lower(p) AS w FROM parts),
dw AS (SELECT doc_id, i, row_number() OVER d AS k, string_agg(w, ' ') OVER n AS g, count(*) OVER n AS c FROM t WHERE is_word
       WINDOW d AS (PARTITION BY doc_id ORDER BY i), n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {NGRAM - 1} FOLLOWING)),
bp AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[{_W}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[{_W}]+'), 1) AS i FROM benchmark),
bw AS (SELECT string_agg(w, ' ') OVER n AS g, count(*) OVER n AS c, count(*) OVER (PARTITION BY item_id) AS total, i FROM bp
       WINDOW n AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {NGRAM - 1} FOLLOWING)),
b AS (SELECT DISTINCT g FROM bw WHERE c = {NGRAM}),
h AS (SELECT dw.*, CASE WHEN dw.c = {NGRAM} AND b.g IS NOT NULL THEN 1 ELSE 0 END AS hit FROM dw LEFT JOIN b USING (g)),
m AS (SELECT doc_id, i, max(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {NGRAM - 1} PRECEDING AND CURRENT ROW) AS gone FROM h),
s AS (SELECT t.doc_id, t.i, t.p, t.is_word, coalesce(m.gone, least(lag(m.gone) OVER d, lead(m.gone) OVER d), 0) AS gone
      FROM t LEFT JOIN m ON m.doc_id = t.doc_id AND m.i = t.i WINDOW d AS (PARTITION BY t.doc_id ORDER BY t.i)),
r AS (SELECT doc_id, coalesce(string_agg(p, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS text, count(*) FILTER (WHERE gone = 1 AND is_word) AS words_removed,
             count(*) FILTER (WHERE is_word) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(r.words_removed, 0) = 0 THEN d.text ELSE r.text END AS text, coalesce(r.words_removed, 0) AS words_removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id WHERE coalesce(r.words_removed, 0) = 0 OR r.words_removed < {DROP_SHARE} * r.n
"""
