"""Operator 5: quality rules with risk-controlled cutoffs.

Rules reject a document whose score is above a cutoff: the share of symbols among its characters, of words equal to
the word before, of capitals among its letters, and of words of a lexicon of toxic words learned from labels.
Cutoffs are chosen for each stratum (language) along a fixed path from mild to strict settings of all rules. A step is
certified if, with its count k of rejected documents among the n good ones of a labelled holdout, the exact binomial
tail P(Bin(n, alpha) <= k) is at most delta / strata: then its rate of false rejection is at most alpha. Steps are
tested in order up to the first that fails (fixed-sequence testing, which needs no correction along the path), with
Bonferroni's correction over the strata, so all statements hold at once with probability 1 - delta. Of the certified
steps the one that rejects most bad documents less `PRICE` times the good ones is used; a stratum with no certified
step, as one without enough labels, rejects nothing. Of equally good steps the mildest is used.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import tok
from terrafold.llm.base import cut, small_batches

ALPHA = 0.02
DELTA = 0.05
PRICE = 20
#: Labelled documents of which the lexicon is learned, at most; cutoffs are set on all others.
TRAIN_ROWS = 20_000
RULES = ("symbols", "repeats", "capitals", "toxic")
PATH = (
    (0.30, 0.80, 0.90, 0.050),
    (0.20, 0.60, 0.80, 0.020),
    (0.10, 0.50, 0.70, 0.010),
    (0.05, 0.40, 0.60, 0.005),
    (0.04, 0.30, 0.55, 0.002),
    (0.03, 0.20, 0.50, 0.001),
    (0.02, 0.10, 0.40, 0.0),
)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#$%&*|!<>{}[]=+~^@\\"]] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = 1
_LETTER[0xC3:0xF5] = 1  # the first byte of a character beyond ASCII


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[ends])


def scores(arr: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """rows x rules; a text without characters, letters or words has 0 in what is a share of them."""
    raw = pc.fill_null(arr, "").cast(pa.large_string())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    b = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    chars = _sums((b & 0xC0) != 0x80, off)
    w = tok.Words(arr)
    doc_start = np.zeros(len(w.hash), bool)
    doc_start[w.first[:-1][w.counts() > 0]] = True
    same = np.append(False, w.hash[1:] == w.hash[:-1]) if len(w.hash) else np.zeros(0, bool)
    hit = np.zeros(len(w.hash), bool)
    if len(lexicon):
        i = np.minimum(np.searchsorted(lexicon, w.hash), len(lexicon) - 1)
        hit = lexicon[i] == w.hash
    words = np.maximum(w.counts(), 1)
    return np.stack(
        [_sums(_SYMBOL[b], off) / np.maximum(chars, 1), _sums(same & ~doc_start, w.first) / words, _sums(_CAPITAL[b], off) / np.maximum(_sums(_LETTER[b], off), 1), _sums(hit, w.first) / words], axis=1
    )


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose(counts: dict[str, tuple[int, list[int], list[int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """stratum -> step of the path, from stratum -> (good documents, rejected good and rejected bad ones by step)."""
    out = {}
    for stratum, (n, good, bad) in counts.items():
        certified = []
        for step, k in enumerate(good):
            if n == 0 or tail(n, k, alpha) > delta / len(counts):
                break
            certified.append(step)
        if certified:
            out[stratum] = max(certified, key=lambda s: (bad[s] - PRICE * good[s], -s))
    return out


def _labelled(labels: DataFrame) -> DataFrame:
    """One row of each labelled doc_id, the worst of its labels: whether it is fine and vile, and its part of the split, which an id keeps."""
    one = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("lid")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return one.filter("q is not null").select("lid", (F.col("q") == 1).alias("fine"), (F.col("t") == 1).alias("vile"), F.xxhash64("lid").alias("order"), (F.pmod(F.xxhash64("lid"), F.lit(4)) == 0).alias("train"))


def _word_rows(batches):
    """(word, doc, toxic) once for each word of a document."""
    for batch in batches:
        for at, part in tok.slices(batch.column(0)):
            w = tok.Words(part)
            doc = np.repeat(np.arange(len(part)), w.counts())
            order = np.lexsort((w.hash, doc))
            h, doc = w.hash[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
            rows = pa.array(doc[new] + at)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows)], ["word", "lid", "toxic"])


def _taken(labels: DataFrame, train_rows: int) -> DataFrame:
    """The labelled ids of which the lexicon is learned: (lid, toxic)."""
    return _labelled(labels).filter("train").orderBy("order", "lid").limit(train_rows).select("lid", F.col("vile").alias("toxic"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Sorted hashes of words that tell toxic documents: chosen one after another, each for the most toxic documents that no earlier one is in, at 95 % precision or more."""
    spark = docs.sparkSession
    chosen = _taken(labels, train_rows).toArrow()
    sample = spark.createDataFrame(chosen.to_pandas(), "lid bigint, toxic boolean")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("lid")).select("text", "lid", "toxic")
    words = cut(texts.mapInArrow(_word_rows, "word bigint, lid bigint, toxic boolean"))
    n_toxic = int(np.sum(chosen.column("toxic").to_numpy(zero_copy_only=False)))
    support = max(3, math.ceil(0.01 * n_toxic))
    telling = words.groupBy("word").agg(F.count_if("toxic").alias("n"), F.count("*").alias("all")).filter((F.col("n") >= support) & (F.col("n") >= 0.95 * F.col("all"))).select("word")
    pairs = words.filter("toxic").join(telling, "word").select("word", "lid").distinct().toArrow().to_pandas().sort_values(["word", "lid"])
    found: list[int] = []
    while len(pairs):
        gain = pairs.groupby("word").size()
        if gain.max() < support:
            break
        best = gain.index[gain.to_numpy().argmax()]
        found.append(best)
        pairs = pairs[~pairs.lid.isin(pairs.lid[pairs.word == best])]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _scored(batches, lexicon: np.ndarray):
    for batch in batches:
        for at, part in tok.slices(batch.column(0)):
            s = scores(part, lexicon)
            yield pa.RecordBatch.from_arrays([*[pa.array(s[:, r]) for r in range(len(RULES))], *[c.slice(at, len(part)) for c in batch.columns[1:]]], [*RULES, *batch.schema.names[1:]])


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"{r} double" for r in RULES) + ", doc_id bigint, lang string"


def fit(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, train_rows: int = TRAIN_ROWS):
    """(lexicon, stratum -> cutoffs, scores of all documents)."""
    small_batches(docs.sparkSession)
    lexicon = learn_lexicon(docs, labels, train_rows)
    scored = cut(docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(lambda it: _scored(it, lexicon), _schema(docs)))
    # order is a hash, so the same ids are taken each time
    held = _labelled(labels).join(F.broadcast(_taken(labels, train_rows).select("lid")), "lid", "left_anti")
    known = scored.join(held, F.col("doc_id") == F.col("lid"))
    good = F.col("fine") & ~F.col("vile")
    above = [F.greatest(*[F.col(r) > c for r, c in zip(RULES, step)]) for step in PATH]
    sums = [F.count_if(good & a).alias(f"g{k}") for k, a in enumerate(above)] + [F.count_if(~good & a).alias(f"b{k}") for k, a in enumerate(above)]
    counts = {r["lang"]: (r["n"], [r[f"g{k}"] for k in range(len(PATH))], [r[f"b{k}"] for k in range(len(PATH))]) for r in known.groupBy("lang").agg(F.count_if(good).alias("n"), *sums).collect()}
    return lexicon, {s: PATH[k] for s, k in sorted(choose(counts, alpha, delta).items())}, scored


def _passes(cutoffs: dict[str, tuple[float, ...]]):
    """Whether the scores of a row stay within its stratum's cutoffs."""
    ok = F.lit(True)
    for stratum, c in cutoffs.items():
        within = F.lit(True)
        for rule, x in zip(RULES, c):
            within = within & (F.col(rule) <= x)
        ok = ok & ((F.col("lang") != stratum) | within)
    return ok


def keep_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, lang, symbols, repeats, capitals, toxic) of the documents that the rules keep.

    A null lang is a stratum of its own, written as the empty string. Null and empty texts have scores of 0 and stay. A null doc_id
    stays without label; rows that repeat an id are judged each by its own text. Labels with a null id or quality
    aren't used, a null toxic counts as 0, and of several labels of one id the worst counts. Without labels all stay.
    Texts are read whole; further columns are left out, whatever their names.
    """
    _, cutoffs, scored = fit(docs, labels, **how)
    return scored.filter(_passes(cutoffs)).select("doc_id", "lang", *RULES)


def _kept(batches, lexicon: np.ndarray, cutoffs: dict[str, tuple[float, ...]]):
    """Rows of (text, lang, ...) within the cutoffs."""
    limits = {s: np.array(c) for s, c in cutoffs.items()}
    for batch in batches:
        for at, part in tok.slices(batch.column(0)):
            rows = batch.slice(at, len(part))
            s = scores(part, lexicon)
            langs = pc.fill_null(rows.column(1), "").to_pylist()
            most = np.stack([limits.get(x, np.full(len(RULES), np.inf)) for x in langs])
            yield rows.filter(pa.array((s <= most).all(axis=1)))


def keep_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the rules keep, with all columns as they are; cases as in `keep_scores`."""
    lexicon, cutoffs, _ = fit(docs, labels, **how)
    packed = docs.select("text", F.col("lang").alias("stratum"), F.struct("*").alias("row"))
    return packed.mapInArrow(lambda it: _kept(it, lexicon, cutoffs), packed.schema).select("row.*")
