"""Operator 1: removal of repeated runs of lines, by winnowing over line hashes.

Each non-blank line is hashed; of every window of `window` consecutive line hashes the smallest (the last of equal
ones) is a fingerprint, so any run of `window` lines that two places share has the same fingerprint at the same place
in it. Of a run of fewer lines that has `long_words` words or more the window is the run itself, so a repeated long
paragraph is found wherever it stands. Occurrences of a fingerprint are joined with those of others; each match is
extended to the runs around it, by up to `window - 1` lines both ways, and longer matches are unions of these. Of places
with the same run the first by (doc_id, line) stays; the lines of later ones are deleted.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import tok
from terrafold.llm.base import cut, others, restored, small_batches

WINDOW = 3
#: Runs of fewer lines count if they have so many words.
LONG_WORDS = 50


def _lines(arr: pa.Array):
    """Non-blank lines of a slice: row, number in its text, words between blanks, two hashes of the line without outer blanks."""
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    b = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    nl = np.flatnonzero(b == 10)
    start = np.concatenate([off[:-1], nl + 1])
    row = np.concatenate([np.arange(len(arr)), np.searchsorted(off, nl, "right") - 1])
    order = np.lexsort((row, start))
    start, row = start[order], row[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    end = np.append(start[1:] - 1, len(b))
    last = np.append(row[1:] != row[:-1], True)
    end[last] = off[row[last] + 1]
    dark = (b != 32) & (b != 9) & (b != 13) & (b != 10)
    solid = np.flatnonzero(dark)
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    full = j >= i
    row, number = row[full], number[full]
    s, e = solid[i[full]], solid[j[full]] + 1
    begun = np.append(0, np.cumsum(dark & ~np.append(False, dark[:-1])))
    count = begun[e] - begun[s] + (s > 0) * dark[np.maximum(s - 1, 0)]
    hashes = []
    for base in (tok.P, tok.Q):
        pre = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(tok._R[b] * tok.powers(base, len(b)), out=pre[1:])
        hashes.append(tok.mix((pre[e] - pre[s]) * tok.powers(tok.inverse(base), len(b) + 1)[s] + (e - s).astype(np.uint64)))
    return row, number, count, *hashes


def _runs(row, number, count, h, g, w: int, least: int):
    """(chosen line, two keys, numbers of lines) of the runs of w lines with `least` words or more."""
    n = max(len(h) - w + 1, 0)
    t = np.flatnonzero(row[:n] == row[w - 1 :][:n])
    if least:
        words = np.append(0, np.cumsum(count))
        t = t[words[t + w] - words[t] >= least]
    parts = np.stack([h[t + o] for o in range(w)])
    chosen = t + (w - 1 - np.argmin(parts[::-1], axis=0))
    k1, k2 = np.full(len(t), w, np.uint64), np.full(len(t), w, np.uint64)
    for o in range(w):
        k1, k2 = tok.mix(k1 * np.uint64(31) + parts[o]), tok.mix(k2 * np.uint64(37) + g[t + o])
    return chosen, k1, k2, np.stack([number[t + o] for o in range(w)], axis=1).astype(np.int32).ravel(), np.full(len(t), w)


def _fingerprints(batches, w: int, least: int):
    """Of each batch of (doc_id, th, text): fp, doc_id, th and the runs in which it is the chosen one, that is its extension both ways."""
    for batch in batches:
        for at, part in tok.slices(batch.column(2)):
            row, number, count, h, g = _lines(part)
            if not len(h):
                continue
            chosen, k1, k2, numbers, size = (np.concatenate(x) for x in zip(*[_runs(row, number, count, h, g, k, least if k < w else 0) for k in range(1, w + 1)]))
            if not len(chosen):
                continue
            order = np.argsort(chosen, kind="stable")
            start = (np.cumsum(size) - size)[order]
            chosen, k1, k2, size = chosen[order], k1[order], k2[order], size[order]
            ends = np.cumsum(size)
            numbers = numbers[np.repeat(start - (ends - size), size) + np.arange(len(numbers))]
            new = np.append(True, chosen[1:] != chosen[:-1])
            at_rows = pa.array(row[chosen[new]] + at)
            runs = pa.StructArray.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(numbers))], ["k1", "k2", "ls"])
            bounds = np.append(np.flatnonzero(new), len(chosen)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[chosen[new]].view(np.int64)), batch.column(0).take(at_rows), batch.column(1).take(at_rows), pa.ListArray.from_arrays(pa.array(bounds), runs)], ["fp", "doc_id", "th", "runs"])


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, th, gone): numbers of the lines to delete, for rows that have any."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    occ = rows.mapInArrow(lambda it: _fingerprints(it, window, long_words), "fp bigint, doc_id bigint, th bigint, runs array<struct<k1:bigint,k2:bigint,ls:array<int>>>")
    occ = cut(occ)  # it is read twice
    often = occ.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    extended = occ.join(often, "fp", "left_semi").select("doc_id", "th", F.explode("runs").alias("r"))
    found = cut(extended.select("doc_id", "th", "r.k1", "r.k2", "r.ls"))
    place = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("th").alias("t"), F.expr("ls[0]").alias("l"))
    first = found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["k1", "k2"]).filter(place > F.col("first"))
    return later.select("doc_id", "th", F.explode("ls").alias("l")).groupBy("doc_id", "th").agg(F.collect_set("l").alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, counted: str = "lines_removed", long_words: int = LONG_WORDS) -> DataFrame:
    """docs with the lines of later repeated runs deleted; a further column, named by `counted`, counts them.

    A run is `window` or more consecutive non-blank lines, or fewer that have `long_words` words or more (as blanks part
    them), compared without outer blanks and tabs; blank lines are neither counted nor deleted. Null text stays null, and an empty one empty, with 0 removed. A null doc_id comes
    last in order. Rows equal in doc_id and text are one place: they get the same result, and don't count as copies of
    each other. Texts of any length are processed whole. Further columns are kept; of a column named like the
    operator's own, the operator's is kept, and `n_chars`, if there, is computed anew.
    """
    gone = repeated_lines(docs, window, long_words)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), others(docs, "doc_id", "text", counted))
    g = gone.select(F.col("doc_id").alias("gid"), F.col("th").alias("gth"), "gone")
    joined = d.join(g, d["doc_id"].eqNullSafe(g["gid"]) & (d["th"] == g["gth"]), "left")
    stay = "array_except(sequence(0, size(ls) - 1), gone)"
    joined = joined.withColumn("ls", F.when(F.col("gone").isNotNull(), F.expr(r"split(text, '\n', -1)")))
    kept = F.expr(f"array_join(transform({stay}, i -> ls[i]), '\\n')")
    out = joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), "rest", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(counted))
    out = out.withColumn(counted, F.greatest(F.col(counted), F.lit(0)))
    return restored(out, docs, counted)


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
q AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
s AS (SELECT doc_id, i, t, n, lead(i, 1) OVER d AS i1, lead(t, 1) OVER d AS t1, lead(n, 1) OVER d AS n1, lead(i, {WINDOW - 1}) OVER d AS i2, lead(t, {WINDOW - 1}) OVER d AS t2
      FROM (SELECT *, len(regexp_extract_all(t, '[^ \t\r]+')) AS n FROM q) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, [i] AS ls, t AS k FROM s WHERE n >= {LONG_WORDS} UNION ALL SELECT doc_id, i, [i, i1], t || chr(10) || t1 FROM s WHERE n + n1 >= {LONG_WORDS}
      UNION ALL SELECT doc_id, i, [i, i1, i2], t || chr(10) || t1 || chr(10) || t2 FROM s WHERE t2 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(ls) AS i FROM r WHERE n > 1),
kept AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS lines_removed
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, k.text, k.lines_removed FROM documents d JOIN kept k USING (doc_id)
"""
