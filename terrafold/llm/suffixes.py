"""Operator 8: passages of `MIN_WORDS` words or more that occur more than once, by sorted suffixes of shards.

Anchors bring equal passages into one shard: of each window of MIN_WORDS words the first smallest hash of a run of
`ANCHOR` words is one, so every passage long enough has the same anchors wherever it stands. A window around its
anchor holds the `HALF` words up to the anchor's end or the HALF from its start; anchors of which neither stands
twice are in no repeated window and go. For the others the words that such windows can reach, the neighbourhoods,
are collected by anchor, equal ones once; if all of an anchor's are equal, they are copies. Else a shard's
neighbourhoods make one text, whose suffix array and common-prefix lengths are computed by external induced sorting
(`induced`); suffixes that share MIN_WORDS words or more with a neighbour there begin repeated windows. Their unions,
put back into the documents, are the passages. A shard is streamed to files and stays there: what a task holds in
core is bound by `memory`, however often a passage, and so its anchor, occurs.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm import induced, tok
from terrafold.llm.base import cut, mounted_dir, small_batches
from terrafold.llm.urlfilter import BITS_PER_KEY, BROADCAST_BYTES, bloom, possible

MIN_WORDS = 50
ANCHOR = 8
HALF = (MIN_WORDS + 1) // 2
#: Words of a shard on average; one with a very frequent anchor can be far larger.
SHARD_WORDS = 1 << 19
_NUMBERS = ("anchor", "nb", "off", "often", "low_doc", "high_doc")
REACH = MIN_WORDS - ANCHOR  # words before and after an anchor that a window may have


def _first_smallest(g: np.ndarray, w: int) -> np.ndarray:
    """Of each window of w values the place of the first smallest."""
    value, at, s = g, np.arange(len(g)), 1
    while True:
        step = min(s, w - s)
        if step <= 0:
            return at
        right = value[step:] < value[: len(value) - step]
        value, at = np.where(right, value[step:], value[: len(value) - step]), np.where(right, at[step:], at[: len(at) - step])
        s += step


def _anchors(w: tok.Words):
    """(document, first, last, hash, hash of the half before, of the half after, of the neighbourhood, its lowest and highest word) of runs of neighbouring anchors alike."""
    t = len(w.hash)
    if t < MIN_WORDS:
        return None
    counts = w.counts()
    doc = np.repeat(np.arange(len(counts)), counts)
    first, last = w.first[:-1][doc], w.first[1:][doc]
    g = w.grams(ANCHOR)
    at = _first_smallest(g, REACH + 1)
    p = np.unique(at[np.arange(len(at)) + MIN_WORDS <= last[: len(at)]])
    if not len(p):
        return None
    half = w.grams(HALF)
    before = p - (HALF - ANCHOR)
    left = np.where(before >= first[p], half[np.maximum(before, 0)] | np.uint64(1), 0).astype(np.uint64)
    right = np.where(p + HALF <= last[p], half[p] | np.uint64(1), 0).astype(np.uint64)
    low, high = np.maximum(p - REACH, first[p]), np.minimum(p + MIN_WORDS, last[p])
    nb = np.zeros(len(p), np.uint64)
    for mult in (tok.Q, tok.P):
        pre = np.zeros(t + 1, np.uint64)
        np.cumsum(w.hash * tok.powers(mult, t), out=pre[1:])
        nb = tok.mix(nb + (pre[high] - pre[low]) * tok.powers(tok.inverse(mult), t + 1)[low] + ((high - low) * 1000 + p - low).astype(np.uint64))
    new = np.append(True, (p[1:] != p[:-1] + 1) | (nb[1:] != nb[:-1]) | (doc[p[1:]] != doc[p[:-1]]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:] - 1, len(p) - 1)
    q = p[heads]
    d = doc[q]
    at_doc = w.first[:-1][d]
    return d, q - at_doc, p[tails] - at_doc, g[q], left[heads], right[heads], nb[heads], low[heads] - at_doc, high[heads] - at_doc


_PLACES = "doc_id bigint, th bigint, p int, q int, before int, behind int, anchor bigint, lh bigint, rh bigint, nb bigint"
_NEAR = "anchor bigint, nb bigint, off bigint, often bigint, low_doc bigint, high_doc bigint, words array<bigint>"


def _places(batches):
    for batch in batches:
        for at, part in tok.slices(batch.column(2)):
            found = _anchors(tok.Words(part))
            if found is None:
                continue
            d, p, q, g, left, right, nb, low, high = found
            rows = pa.array(d + at)
            small = [pa.array(x.astype(np.int32)) for x in (p, q, p - low, high - p)]
            numbers = [pa.array(x.astype(np.uint64).view(np.int64)) for x in (g, left, right, nb)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *small, *numbers], ["doc_id", "th", "p", "q", "before", "behind", "anchor", "lh", "rh", "nb"])


def _neighbourhoods(batches):
    """Of (text, [(p, nb, anchor)]) the words of each neighbourhood."""
    for batch in batches:
        for at, part in tok.slices(batch.column(0)):
            w = tok.Words(part)
            wanted = batch.column(1).slice(at, len(part)).to_pylist()
            off, low, high, known = [], [], [], {k: [] for k in ("anchor", "nb", "often", "low_doc", "high_doc")}
            for d, places in enumerate(wanted):
                a, z = int(w.first[d]), int(w.first[d + 1])
                for x in places:
                    p = a + x["p"]
                    low.append(max(p - REACH, a))
                    high.append(min(p + MIN_WORDS, z))
                    off.append(p - low[-1])
                    for k, column in known.items():
                        column.append(x[k])
            low, high = np.array(low, np.int64), np.array(high, np.int64)
            size = high - low
            starts = np.cumsum(size) - size
            words = w.hash[np.repeat(low - starts, size) + np.arange(int(size.sum()))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, size.sum()).astype(np.int32)), pa.array(words.view(np.int64)))
            number = {"off": off, **known}
            names = ["anchor", "nb", "off", "often", "low_doc", "high_doc"]
            yield pa.RecordBatch.from_arrays([*[pa.array(number[k], pa.int64()) for k in names], lists], [*names, "words"])


def _columns(batches, s: induced.Scratch):
    """A shard as it arrives: its columns and words, in files beyond a block."""
    out = {k: induced.Growing(s) for k in ("size", *_NUMBERS)}
    words = induced.Growing(s)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("words"))
        for a in range(0, len(lists), 1024):
            part = lists.slice(a, 1024)
            out["size"].add(pc.list_value_length(part).to_numpy())
            words.add(part.flatten().to_numpy())
            for k in _NUMBERS:
                out[k].add(batch.column(batch.schema.get_field_index(k)).slice(a, 1024).to_numpy())
    return {k: v.done() for k, v in out.items()}, words.done()


def repeats(t: dict[str, np.ndarray], words: np.ndarray, block: int, s: induced.Scratch):
    """(neighbourhood, first, end, lowest and highest doc_id), by blocks, of stretches that stand more than once in a shard's neighbourhoods.

    A place of a document can be in several neighbourhoods, of other anchors or, in text that repeats itself, of the
    same; it must not count as its own copy. So a symbol is a word with its anchor and its distance from it: only
    what is aligned by a common anchor compares as equal, and two aligned occurrences are two places.
    """
    every = len(t["size"])
    # rows that repeat a doc_id and its text give a neighbourhood more than once
    fresh, at = s.array(every, bool), s.array(every)
    for a, z in s.blocks(every):
        at[a:z] = np.arange(a, z)
    before = None
    for nb, i, _ in induced.in_order(s.copy(t["nb"]), at, s):
        fresh[i] = np.append(before is None or nb[0] != before, nb[1:] != nb[:-1])
        before = nb[-1]
    # a row's words end, and in the text each row that counts ends with a symbol of its own
    ends, begin, row = s.array(every), s.array(every), 0
    total = end = 0
    for a, z in s.blocks(every):
        sizes, f = t["size"][a:z], fresh[a:z]
        ends[a:z] = end + np.cumsum(sizes)
        taken = np.where(f, sizes + 1, 0)
        begin[a:z] = total + np.cumsum(taken) - taken
        end, total, row = int(ends[z - 1]), total + int(taken.sum()), row + int(f.sum())

    def rows():
        """Runs of rows of about a block of words."""
        a = 0
        while a < every:
            limit = (int(ends[a - 1]) if a else 0) + s.block
            z = every if s.root is None else max(a + 1, int(np.searchsorted(ends, limit, "right")))
            yield a, z
            a = z

    text, key, where = s.array(total, np.int32 if total < 2**31 else np.int64), s.array(total - row), s.array(total - row)
    n = k = 0
    for a, z in rows():
        f, sizes = np.flatnonzero(fresh[a:z]) + a, t["size"][a:z]
        own, first = np.repeat(np.arange(a, z), sizes), np.repeat(ends[a:z] - sizes, sizes)
        word = np.arange(int(ends[a - 1]) if a else 0, int(ends[z - 1]))
        stay = fresh[own]
        own, distance = own[stay], (word - first)[stay]
        h = tok.mix(t["anchor"][own].view(np.uint64)) + (distance - t["off"][own]).astype(np.uint64)
        key[n : n + len(own)] = tok.mix(words[word[stay]].view(np.uint64) + tok.mix(h)).view(np.int64)
        where[n : n + len(own)] = begin[own] + distance
        text[begin[f] + t["size"][f]] = np.arange(k + 1, k + len(f) + 1)
        n, k = n + len(own), k + len(f)
    text[total - 1] = 0
    before, rank = None, k - 1
    for h, i, _ in induced.in_order(key, where, s):
        new = np.append(before is None or h[0] != before, h[1:] != h[:-1])
        text[i] = rank + np.cumsum(new)
        rank, before = rank + int(new.sum()), h[-1]
    del key, where
    sa, lcp = induced.sort(text, block, s)
    # suffixes with a long common prefix, one after another, are a group; its documents go to the places of all
    mark, low, high = s.array(total, bool), s.array(total), s.array(total)

    def members():
        group = -1
        for a, z in s.blocks(total):
            here = lcp[a:z] >= MIN_WORDS
            behind = np.append(lcp[a + 1 : z + 1] >= MIN_WORDS, False)[: z - a]
            g = group + np.cumsum(behind & ~here)
            group = int(g[-1])
            m = here | behind
            yield sa[a:z][m], g[m]

    groups = 1 + max((int(g[-1]) for _, g in members() if len(g)), default=-1)
    g_low, g_high, counted = s.array(groups), s.array(groups), -1
    for pos, g in members():
        if not len(pos):
            continue
        own = np.searchsorted(begin, pos, "right") - 1
        heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        lo, hi = np.minimum.reduceat(t["low_doc"][own], heads), np.maximum.reduceat(t["high_doc"][own], heads)
        old = g[heads] <= counted
        g_low[g[heads]] = np.where(old, np.minimum(lo, g_low[g[heads]]), lo)
        g_high[g[heads]] = np.where(old, np.maximum(hi, g_high[g[heads]]), hi)
        counted = int(g[-1])
    for pos, g in members():
        mark[pos], low[pos], high[pos] = True, g_low[g], g_high[g]
    for a, z in rows():
        f = np.flatnonzero(fresh[a:z]) + a
        if not len(f):
            continue
        sizes = t["size"][f]
        own = np.repeat(f, sizes)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        p = begin[own] + offset
        whole = (t["often"][own] > 1) & (offset <= t["size"][own] - MIN_WORDS)
        found, lo, hi = mark[p], low[p], high[p]
        lo = np.where(whole, np.where(found, np.minimum(lo, t["low_doc"][own]), t["low_doc"][own]), lo)
        hi = np.where(whole, np.where(found, np.maximum(hi, t["high_doc"][own]), t["high_doc"][own]), hi)
        stay = found | whole
        own, offset, lo, hi = own[stay], offset[stay], lo[stay], hi[stay]
        if not len(own):
            continue
        new = np.append(True, (own[1:] != own[:-1]) | (offset[1:] > offset[:-1] + MIN_WORDS))
        heads = np.flatnonzero(new)
        lasts = np.append(heads[1:], len(own)) - 1
        yield own[heads], offset[heads], offset[lasts] + MIN_WORDS, np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads)


def _repeated(batches, block: int, memory: int, folder: str):
    s = induced.Scratch(folder, memory)
    t, words = _columns(batches, s)
    if not len(words):
        return
    for own, a, z, lo, hi in repeats(t, words, block, s):
        off = t["off"][own]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t["nb"][own], t["anchor"][own], a - off, z - off, lo, hi)], ["nb", "anchor", "a", "z", "lo", "hi"])


def repeated_passages(docs: DataFrame, block: int = induced.BLOCK, memory: int = induced.MEMORY) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, other_doc_id): stretches of a document all of whose words lie in runs of MIN_WORDS words that stand somewhere else too.

    Words are counted from 0, whatever their case and the punctuation between them; end_word is the one behind. Every occurrence is
    given, the first too. other_doc_id is a document that shares a run of the stretch, the document itself if it
    repeats only within itself. Rows with a null doc_id or text are left out; rows that repeat a doc_id and its text
    are occurrences of their own, and give the same row once. Texts are read whole. Further columns don't matter. Tables without
    repeats, or empty, give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = mounted_dir(spark)
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange by anchor serves the counts of both halves
    places = rows.mapInArrow(_places, _PLACES).repartition(parts, "anchor")
    n = F.sum(F.col("q") - F.col("p") + 1)
    counted = places.withColumn("ln", n.over(Window.partitionBy("anchor", "lh"))).withColumn("rn", n.over(Window.partitionBy("anchor", "rh")))
    alive = cut(counted.filter("lh <> 0 and ln > 1 or rh <> 0 and rn > 1").select("doc_id", "th", "p", "q", "before", "behind", "anchor", "nb"))
    kinds = alive.groupBy("anchor", "nb").agg(F.min(F.struct("doc_id", "th", "p")).alias("at"), n.alias("often"), F.min("doc_id").alias("low_doc"), F.max("doc_id").alias("high_doc"))
    # of an anchor with equal neighbourhoods only, no more is to be found; those of the others are compared
    kinds = cut(kinds.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor"))))
    wanted = kinds.filter("kinds > 1").groupBy(F.col("at.doc_id").alias("wid"), F.col("at.th").alias("wth")).agg(F.collect_list(F.struct("at.p", "nb", "anchor", "often", "low_doc", "high_doc")).alias("places"))
    wanted = cut(wanted)
    texts = rows.withColumn("key", F.concat_ws("/", "doc_id", "th"))
    blocks = max(1, math.ceil(wanted.count() * BITS_PER_KEY / 512))
    if blocks * 80 <= BROADCAST_BYTES:
        # the texts that have nothing to compare mostly needn't be exchanged; what passes in error falls out of the join
        texts = possible(texts, bloom(wanted.select(F.concat_ws("/", "wid", "wth").alias("key")), blocks), blocks)
    found = texts.join(wanted, (F.col("doc_id") == F.col("wid")) & (F.col("th") == F.col("wth"))).select("text", "places").mapInArrow(_neighbourhoods, _NEAR)
    near = kinds.filter("kinds > 1").count()
    shards = max(parts, math.ceil(near * (REACH + MIN_WORDS) / SHARD_WORDS))
    spans = found.repartition(shards, "anchor").mapInArrow(lambda it: _repeated(it, block, memory, folder), "nb bigint, anchor bigint, a bigint, z bigint, lo bigint, hi bigint")
    back = alive.join(spans, ["anchor", "nb"]).select("doc_id", "th", (F.col("p") + F.col("a")).alias("a"), (F.col("q") + F.col("z")).alias("z"), "lo", "hi")
    alike = kinds.filter("kinds = 1 and often > 1").select("anchor", "nb", F.col("low_doc").alias("lo"), F.col("high_doc").alias("hi"))
    same = alive.join(alike, ["anchor", "nb"]).filter(F.col("before") + F.col("behind") >= MIN_WORDS).select("doc_id", "th", (F.col("p") - F.col("before")).cast("bigint").alias("a"), (F.col("q") + F.col("behind")).cast("bigint").alias("z"), "lo", "hi")
    back = back.unionAll(same)
    w = Window.partitionBy("doc_id", "th").orderBy("a", "z")
    far = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = back.withColumn("new", F.when(far.isNull() | (F.col("a") > far), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("doc_id", "th", "run").agg(F.min("a").alias("first_word"), F.max("z").alias("end_word"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    other = F.when(F.col("lo") != F.col("doc_id"), F.col("lo")).otherwise(F.col("hi"))
    return out.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), other.alias("other_doc_id"))


_W = "0-9A-Za-z_\\x{C0}-\\x{1FFF}\\x{2080}-\\x{2FFF}\\x{3040}-\\x{10FFFF}"
ORACLE = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{_W}]+')) AS w, unnest(range(len(regexp_extract_all(lower(text), '[{_W}]+')))) AS k FROM documents),
g AS (SELECT doc_id, k, md5(string_agg(w, ' ') OVER f) AS g, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
r AS (SELECT g, min(doc_id) AS lo, max(doc_id) AS hi FROM g WHERE n = {MIN_WORDS} GROUP BY g HAVING count(*) > 1),
h AS (SELECT doc_id, k, lo, hi, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > {MIN_WORDS}, true) AS new FROM g JOIN r USING (g) WHERE n = {MIN_WORDS}),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM h)
SELECT doc_id, min(k) AS first_word, max(k) + {MIN_WORDS} AS end_word, max(k) + {MIN_WORDS} - min(k) AS n_words, CASE WHEN min(lo) <> doc_id THEN min(lo) ELSE max(hi) END AS other_doc_id FROM s GROUP BY doc_id, run
"""
