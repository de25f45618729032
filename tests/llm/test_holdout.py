"""op5_quality: what cutoffs are set on, what they guarantee, and the query against brute force."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from terrafold.llm import quality, tok


def test_spare_training_ids_are_held_out(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words of text {k}", "en") for k in range(400)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "choose", lambda counts, *_: seen.append(counts) or {})
    for rows in (10, 400):
        quality.fit(docs, labels, train_rows=rows)
    train = quality._labelled(labels).filter("train").count()
    assert train > 10 and [c["en"][0] for c in seen] == [390, 400 - train]


def test_no_stratum_passes_the_limit():
    """In few runs does any of several strata get a step whose true rate is over alpha, rates rising along the path."""
    rng = random.Random(5)
    broken = certified = 0
    for _ in range(400):
        counts, rates = {}, {}
        for stratum in "abcd":
            n = rng.choice([150, 300, 600, 1200])
            # each good document is rejected from some step on; the rate passes alpha at a step of its own
            true = np.cumsum([rng.choice([0.0, 0.004, 0.012, 0.02]) for _ in quality.PATH])
            level = np.array([rng.random() for _ in range(n)])
            counts[stratum] = (n, [int((level < r).sum()) for r in true], [10 * (k + 1) for k in range(len(true))])
            rates[stratum] = true
        chosen = quality.choose(counts)
        certified += len(chosen)
        broken += any(rates[s][k] > quality.ALPHA for s, k in chosen.items())
    assert broken / 400 <= quality.DELTA and certified > 400


def test_mildest_of_equals():
    assert quality.choose({"x": (1000, [0, 0, 0, 0, 30, 0, 0], [3, 7, 7, 7, 9, 9, 9])}) == {"x": 1}


def test_query_brute_force(spark):
    r = random.Random(11)
    words = ["".join(r.choices("abdehilnorst", k=r.randint(2, 8))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(2600):
        t = " ".join(r.choices(words, k=r.randint(20, 70))).capitalize() + "."
        kind = r.randrange(10)
        t = t.upper() if kind == 0 else t + " scum" if kind == 1 else t[:40] + " vile fool " + t[40:] if kind == 2 else t + " # % & * | ! < >" * 3 if kind == 3 else t
        rows.append((i if i % 50 else None, t if i % 71 else None, r.choice(["en", "de", None]), "x"))
        if r.random() < 0.8:
            labels.append((i, r.choice([int(kind not in (0, 3))] * 30 + [None]), r.choice([int(kind in (1, 2))] * 30 + [None])))
    labels += labels[:40]
    docs = spark.createDataFrame(rows + rows[5:9], "doc_id bigint, text string, lang string, symbols string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["lang"], *(round(x[k], 9) for k in quality.RULES)) for x in quality.keep_scores(docs, lab, train_rows=300).collect()))

    one = {}
    for i, q, t in labels:
        a, b = one.get(i, (None, 0))
        one[i] = (q if a is None else a if q is None else min(a, q), max(b, t or 0))
    one = {i: v for i, v in one.items() if v[0] is not None}
    take = {x["lid"] for x in quality._taken(lab, 300).collect()}
    assert len(take) == 300 and take <= set(one)
    everything = rows + rows[5:9]
    texts = collections.defaultdict(list)
    for i, t, *_ in everything:
        if i in take:
            texts[i].append(tok.words(t))
    vile = {i for i in take if one[i][1] == 1}
    held_by = collections.defaultdict(collections.Counter)
    for i, several in texts.items():
        for t in several:
            for w in set(t):
                held_by[w][i] += 1
    support = max(3, math.ceil(0.01 * len(vile)))
    sums = {w: (sum(n for i, n in c.items() if i in vile), sum(c.values())) for w, c in held_by.items()}
    telling = {w: {i for i in held_by[w] if i in vile} for w, (n, every) in sums.items() if n >= support and n >= 0.95 * every}
    key = lambda w: int(tok.Words(pa.array([w])).hash.view(np.int64)[0])
    lexicon = set()
    while telling:
        best = min(telling, key=lambda w: (-len(telling[w]), key(w)))
        if len(telling[best]) < support:
            break
        lexicon.add(best)
        gone = telling.pop(best)
        telling = {w: s - gone for w, s in telling.items() if s - gone}
    assert {"scum", "vile"} & lexicon
    assert set(quality.learn_lexicon(docs, lab, 300).view(np.int64).tolist()) == {key(w) for w in lexicon}

    def score(t):
        t = t or ""
        w = tok.words(t)
        letters = sum(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in t)
        return [sum(c in "#$%&*|!<>{}[]=+~^@\\" for c in t) / max(len(t), 1), sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1), sum("A" <= c <= "Z" for c in t) / max(letters, 1), sum(x in lexicon for x in w) / max(len(w), 1)]

    scored = [(i, lang or "", score(t)) for i, t, lang, _ in everything]
    limits = {}
    strata = {lang for i, lang, _ in scored if i in one and i not in take}
    for stratum in strata:
        held = [(s, one[i][0] == 1 and one[i][1] != 1) for i, lang, s in scored if lang == stratum and i in one and i not in take]
        n, certified = sum(g for _, g in held), []
        for k, step in enumerate(quality.PATH):
            out = [(any(x > c for x, c in zip(s, step)), g) for s, g in held]
            bad, good = sum(o and not g for o, g in out), sum(o and g for o, g in out)
            tail = sum(math.comb(n, j) * quality.ALPHA**j * (1 - quality.ALPHA) ** (n - j) for j in range(good + 1))
            if not n or tail > quality.DELTA / len(strata):
                break
            certified.append((bad - quality.PRICE * good, -k))
        if certified:
            limits[stratum] = quality.PATH[-max(certified)[1]]
    assert limits
    want = sorted((i is None, i or 0, lang, *(round(x, 9) for x in s)) for i, lang, s in scored if all(x <= c for x, c in zip(s, limits.get(lang, [9] * 4))))
    assert got == want and 0 < len(want) < len(scored)
