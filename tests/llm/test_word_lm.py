"""op7_lm_score against brute force."""

import collections
import math
import random
import re

import pyarrow as pa
import pytest

from terrafold.llm import lm, tok


SINGLE = "\u3040-\u9fff\U00010000-\U0010ffff"
TOKEN = re.compile(f"[{SINGLE}]|(?:(?![{SINGLE}])[{tok.WORD_CLASS}])+|[^{tok.WORD_CLASS} \t\n\v\f\r]+")


def tokens(text):
    return TOKEN.findall(text.lower())


def test_tokens_agree(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [*texts, "", "日本、語!? мир🙂🙂x", "", "--a--b", "end\u3000語", "x", "x\x0by", "…"]
    w = tok.Words(pa.array(texts), every=True)
    for k, t in enumerate(texts):
        assert [w.bytes[a:z].tobytes().decode() for a, z in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])] == tokens(t)


def brute(corpus, texts):
    count, after, kinds, seen = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for t in map(tokens, corpus):
        for u, w in zip([None, *t], t):
            count[u, w] += 1
            after[u] += 1
            kinds[u].add(w)
            seen[w] += 1
    n, v = sum(seen.values()), len(seen)

    def p(u, w):
        p1 = (seen[w] + v / (v + 1)) / (n + v)
        return (count[u, w] + len(kinds[u]) * p1) / (after[u] + len(kinds[u])) if after[u] else p1

    return [sum(math.log2(p(u, w)) for u, w in zip([None, *t], t)) for t in map(tokens, texts)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("held", [1 << 22, 10])
def test_words_brute_force(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_TOKENS", held)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    corpus = sorted(texts, key=len)[:40] + ["мир и война", "我们 喜欢，学习 机器", "end only", "", "x"]
    scored = [*corpus[:10], "an unknown zqxj 9!", "мир и война", "война и мир", "学习，我们", "機器 🙂", "only then", "", "word " * 400]
    got = {r["doc_id"]: r for r in lm.score_documents(frame(spark, scored), frame(spark, corpus)).collect()}
    for k, want in enumerate(brute(corpus, scored)):
        assert got[k]["n_tokens"] == len(tokens(scored[k])) and math.isclose(got[k]["log2_prob"], want, rel_tol=1e-9, abs_tol=1e-9)


def test_order_of_words_counts(spark):
    r = random.Random(5)
    follow = {f"w{i}": [f"w{r.randrange(300)}" for _ in range(3)] for i in range(300)}
    texts = []
    for _ in range(200):
        w = ["w0"]
        while len(w) < 80:
            w.append(r.choice(follow[w[-1]]))
        texts.append(" ".join(w))
    nonsense = [" ".join(r.sample(t.split(), 80)) for t in texts[:20]]
    got = {x["doc_id"]: x["bits_per_token"] for x in lm.score_documents(frame(spark, texts[:20] + nonsense), frame(spark, texts)).collect()}
    assert max(got[k] for k in range(20)) + 2 < min(got[k] for k in range(20, 40))
