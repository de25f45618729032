"""Operator 3: scan for secrets, with a random forest that removes false positives.

Candidates are runs of 12 characters or more of letters, digits and `+/_-` with what `=` pads base64 behind them, three
such runs joined by dots that begin as JSON Web Tokens do, and whatever stands behind a key word: a value in quotes, of
any characters, or one up to a blank, both of any length. Features are the length, the entropy, shares of character kinds,
transitions between characters (how often the kind changes, and the mean log-probability of the letter pairs, learned
from the vocabulary's words), the share covered by words of a dictionary (words of 4 letters or more of the vocabulary),
and words: for those of the path, before, just before, behind and inside the candidate how much more often they stand at
secrets than at others, as log-odds learned from the labelled findings (for training rows from the other half of these).
The forest is trained on labelled findings, (before, value, after, path, secret), at most `limit` of them, evenly taken.
The tables of this project have none, so unless others are given, `labelled_findings` makes lines and takes their
candidates: keys and passwords of usual kinds in usual places against identifiers, numbers, checksums, commit ids,
placeholders and words.
"""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.base import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FINDINGS = 10_000
TREES = 60
DEPTH = 12
NEAR = 40
#: Words that stand at fewer findings tell nothing.
OFTEN = 30
CUTOFF = 0.5
CANDIDATE = re.compile(r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|[A-Za-z0-9+/_\-]{12,}")
_PADDING = re.compile(r"={1,2}(?![A-Za-z0-9+/_=\-])")
_VALUE = r"""(?:(?P<quote>["'`])(?P<inside>[^\n]*?)(?P=quote)|(?P<bare>(?:(?!&[\w.\-]+=)[^\s"'`])+))"""
_ASSIGNED = re.compile(r"""(?i)(?:token|secret|passw|passphrase|passe|pwd|credential|bearer|auth|key|signature|kennwort|geheim|schlüssel|contraseña|clave|jeton)[\w.\-]{0,100}+["'`\]]{0,2}[ \t]*(?:=>|:=|==?|:)[ \t]*(?:(?:bearer|basic|token)[ \t]+)?""" + _VALUE)
_BEHIND = re.compile(r"(?i)(?<![a-z])(?:tokens?|secret|password|passwd|passphrase|mot de passe|passwort|kennwort|contraseña|pwd|credentials?|bearer|auth|(?:(?:api|access|private|client)[_ \-]?)?key|signature)[ \t]+(?:is[ \t]+)?" + _VALUE)
_NAMED = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_KIND = {**{c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 2 for c in "0123456789"}}
PLACES = ("last", "before", "after", "path", "inside")
FEATURES = ("length", "entropy", "digits", "capitals", "other", "changes", "pairs", "longest_same_kind", "dictionary", "hex_only", "assigned", "quoted", *(f"words_{p}" for p in PLACES))


def _values(text: str, pattern: re.Pattern):
    """(start, end) of what stands behind key words, also of key words inside of such values."""
    at = 0
    while m := pattern.search(text, at):
        a, z = m.span("inside" if m["bare"] is None else "bare")
        at = max(a, m.start() + 1)
        if m["bare"] is not None:
            z = a + len(text[a:z].rstrip(",;" if pattern is _ASSIGNED else ".,;:)]}>"))
        if z > a:
            yield a, z


def candidates(text: str):
    """(start, value, text before, text after), by start; a part of a value without blanks is none of its own unless it is a value itself."""
    spans = {*_values(text, _ASSIGNED), *_values(text, _BEHIND)}
    solid, far = [], 0
    for a, z in sorted(spans):
        if z > far and not re.search(r"\s", text[a:z]):
            solid.append((a, z))
            far = z
    k = 0
    for m in CANDIDATE.finditer(text):
        a, z = m.span()
        if (p := _PADDING.match(text, z)) and (p.end() - a) % 4 == 0:
            z = p.end()
        while k < len(solid) and solid[k][1] <= a:
            k += 1
        if k == len(solid) or not solid[k][0] <= a < z <= solid[k][1]:
            spans.add((a, z))
    for a, z in sorted(spans):
        yield a, text[a:z], text[max(0, a - NEAR) : a], text[z : z + NEAR]


def dictionary(path: str) -> frozenset[str]:
    out = set()
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                w = base64.b64decode(line.split()[0]).strip().decode("utf-8", "ignore").lower()
                if len(w) >= 4 and w.isascii() and w.isalpha():
                    out.add(w)
    return frozenset(out)


def letter_pairs(words: frozenset[str]) -> dict[str, float]:
    pairs = Counter(a + b for w in words for a, b in zip(w, w[1:]))
    total = Counter()
    for p, n in pairs.items():
        total[p[0]] += n
    return {a + b: math.log((pairs.get(a + b, 0) + 0.5) / (total[a] + 13)) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}


def covered(value: str, words: frozenset[str], longest: int | None = None) -> float:
    """Share of the characters in dictionary words, the longest first from the left; longest: of the words."""
    low, at, inside = value.lower(), 0, 0
    longest = longest or max(map(len, words), default=0)
    while at < len(low) - 3:
        for n in range(min(longest, len(low) - at), 3, -1):
            if low[at : at + n] in words:
                inside += n
                at += n
                break
        else:
            at += 1
    return inside / len(value)


def neighbours(before: str, value: str, after: str, path: str | None) -> list[list[str]]:
    """Words at each of PLACES, each once; parts of names are words of their own."""
    named = [[w.lower() for w in _NAMED.findall(x) if len(w) >= least] for x, least in ((before, 2), (after, 2), (path or "", 2), (value, 4))]
    return [named[0][-1:], *[sorted(set(x)) for x in named]]


def odds(rows) -> list[dict[str, float]]:
    """For each of PLACES the log-odds of its words, from findings."""
    seen: list[dict[bool, Counter]] = [{True: Counter(), False: Counter()} for _ in PLACES]
    total = Counter(bool(r[4]) for r in rows)
    for r in rows:
        for place, some in zip(seen, neighbours(*r[:4])):
            place[bool(r[4])].update(some)
    out = []
    for place in seen:
        often = [w for w in {*place[True], *place[False]} if place[True][w] + place[False][w] >= OFTEN]
        out.append({w: math.log((place[True][w] + 2) / (total[True] + 4)) - math.log((place[False][w] + 2) / (total[False] + 4)) for w in often})
    return out


def features(before: str, value: str, after: str, path: str | None, words: frozenset[str], pairs: dict[str, float], weights: list[dict[str, float]], longest: int | None = None) -> list[float]:
    kinds = [_KIND.get(c, 3) for c in value]
    n = len(value)
    change = sum(a != b for a, b in zip(kinds, kinds[1:]))
    run = most = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        most = max(most, run)
    low = value.lower()
    lp = [pairs.get(low[i : i + 2], -6.0) for i in range(n - 1)]
    tail = before.rstrip(" \t\"'`")
    return [
        float(n), -sum(c / n * math.log2(c / n) for c in Counter(value).values()), kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n, change / max(n - 1, 1), sum(lp) / max(len(lp), 1), most / n,
        covered(value, words, longest), float(all(c in "0123456789abcdefABCDEF" for c in value)), float(tail[-1:] in ("=", ":")), float(before[-1:] in "\"'`" and before[-1:] == after[:1] and before != ""),
        *[sum(known.get(w, 0.0) for w in some) for known, some in zip(weights, neighbours(before, value, after, path))],
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 17, path: str = VOCABULARY) -> list[tuple[str, str, str, str, bool]]:
    """n findings (before, value, after, path, secret) of made lines, the same for the same arguments: all candidates that the scan has there."""
    r = random.Random(seed)
    words = sorted(dictionary(path))
    b64, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    nice = [w for w in words if len(w) <= 9]
    small = ("of", "the", "and", "in", "to", "a", "is", "it", "on", "at", "or", "de", "la", "le", "et", "un", "der", "die", "und", "zu", "ein", "el", "y", "que", "en")
    places = ("app", "web", "ops", "docs", "config", "conf", "deploy", "src", "lib", "scripts", "data", "auth")
    ends = ("py", "js", "go", "sh", "txt", "md", "json", "yml", "yaml", "env", "html", "ts", "java", "ini", "http", "log")
    chain: dict[str, list[str]] = {}
    for w in nice:
        for a, b in zip(w, w[1:]):
            chain.setdefault(a, []).append(b)

    def invented(k: int) -> str:
        s = r.choice("abcdefghilmnoprstu")
        while len(s) < k:
            s += r.choice(chain.get(s[-1], ["e"]))
        return s

    def prose(k: int) -> str:
        return " ".join(r.choice(small) if (x := r.random()) < 0.3 else r.choice(nice) if x < 0.6 else invented(r.randint(2, 9)) for _ in range(k))

    def known() -> str:
        """A key of a form that tells it wherever it stands."""
        jwt = lambda: ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"' + pick(b64[:62], r.randint(4, 120)).encode() + b'"}', r.randbytes(32)))
        return r.choice((lambda: "AKIA" + pick(b64[:26] + "234567", 16), lambda: "AKIA" + pick(b64[:26] + b64[52:62], 16), lambda: "ghp_" + pick(b64[:62], 36), lambda: "sk_live_" + pick(b64[:62], 24), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(b64[:62], 24), jwt))()

    def secret() -> str:
        return r.choice((lambda: pick(hexa, r.choice((18, 20, 32, 40, 40, 64))), lambda: pick(hexa, 40).upper(), lambda: pick(b64, r.choice((24, 40, 44, 64))), lambda: pick("0123456789", 10) + ":" + pick(b64[:62], 35), known))()

    def password() -> str:
        return r.choice((lambda: pick(b64[:62] + "!@#$%^*?.-_+~", r.randint(7, 16)), lambda: pick(b64[:62], r.randint(8, 16)), lambda: pick(b64[:52], r.randint(10, 19)), lambda: base64.b64encode(r.randbytes(r.choice((16, 20, 32)))).decode()))()

    def harmless() -> str:
        return r.choice(
            (
                lambda: invented(r.randint(12, 28)), lambda: invented(r.randint(12, 28)).upper(), lambda: pick("0123456789", r.randint(12, 20)), lambda: "_".join(r.choice(nice) for _ in range(3)) + str(r.randint(1, 99)),
                lambda: "".join(r.choice(nice).title() for _ in range(3)) + str(r.randint(1, 9)), lambda: "/".join(r.choice(nice) for _ in range(4)) + "-" + str(r.randint(1, 2024)), lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
                lambda: r.choice(("your_api_key_here_123", "XXXXXXXXXXXXXXXXXXXX1", "0000000000000000000000", "changeme_changeme_1", "abcdef1234567890abcdef1234567890", "1234567890123456")), lambda: "-".join(r.choice(nice) for _ in range(4)) + str(r.randint(0, 9)),
                lambda: "-" * r.randint(20, 60), lambda: invented(6) + str(r.randint(10000, 99999)) + invented(6),
            )
        )()

    key = ("token", "TOKEN", "api_key", "secret", "password", "passwd", "pwd", "access_key", "auth token", "client_secret", "Authorization: Bearer", "private_key", "key", "apiKey", "SECRET_KEY", "mot de passe", "Passwort", "contraseña")
    out = []

    def line(before: str, value: str, after: str, where: str, is_secret: bool) -> None:
        for start, v, near, behind in candidates(before + value + after):
            mine = start < len(before) + len(value) and start + len(v) > len(before)
            if not is_secret or not mine or (start, v) == (len(before), value):
                out.append((near, v, behind, where, is_secret and mine))

    k = 0
    while len(out) < n:
        k += 1
        head, end, where = prose(6), " " + prose(6), r.choice(("", f"src{r.randint(0, 40)}", f"{r.choice(places)}/{r.choice(nice)}.{r.choice(ends)}", f"{r.choice(nice)}.{r.choice(ends)}"))
        if k % 2:
            name = r.choice(key)
            form = r.choice((f'{name} = "', f"{name}: ", f"{name}=", f"{name}='", f'{name} = "', f'"{name}": "', f"{name} ", f"{r.choice(nice)}_{name}=", f"?{r.choice(nice)}={r.choice(nice)}&{name}="))
            if (bare := r.random()) < 0.2:
                form = ""
            elif bare < 0.3:
                form = f"{name} is "
            close = "" if not form else form[-1] if form[-1] in "\"'" else ""
            value = known() if not form else password() if form.endswith((" is ", ": ")) or form[-1] != " " and r.random() < 0.4 else secret()
            line(f"{head} {form}", value, close + (f"&{r.choice(nice)}=1" if "&" in form else "") + end, where, True)
        elif (kind := r.random()) < 0.4:
            q = r.choice(("", "", "", '"'))
            form = r.choice((" ", " ", " ", f" {r.choice(nice)} = ", f" {r.choice(nice)}: ", f" {r.choice(nice)}=", " token of ", " key "))
            line(head + form + q, harmless(), q + end, where, False)
        elif kind < 0.55:
            name, q = r.choice(key), r.choice(("", '"'))
            idle = r.choice((lambda: r.choice(nice), lambda: invented(r.randint(2, 11)), lambda: prose(r.randint(2, 6)), lambda: str(r.randint(0, 9999)), lambda: r.choice(("None", "null", "true", "false", "changeme", "your_password", f"<{r.choice(('your-', '', 'the ', 'my-'))}{r.choice((*key, r.choice(nice)))}>", f"${{{r.choice(nice).upper()}_{r.choice(('TOKEN', 'PASSWORD', 'KEY'))}}}", f"${r.choice(nice).upper()}", "xxxxxxxx", "********", "os.environ", "getpass()"))))()
            line(f"{head} {name}{r.choice((' = ', ': ', '=', ' '))}{q}", idle, q + end, where, False)
        elif kind < 0.7:
            line(f"{head} {r.choice(('commit', 'sha256:', 'checksum', 'md5', 'revision', 'build id', 'digest =', 'etag:'))} ", pick(hexa, r.choice((32, 40, 64))), end, where, False)
        elif kind < 0.75:
            line(f"{head} {r.choice(('hash', 'checksum', 'sum', 'integrity'))}{r.choice((': ', '=', chr(34) + ': ' + chr(34)))}{r.choice(('sha1-', 'sha256-', 'sha384-', 'sha512-', 'h1:', ''))}", base64.b64encode(r.randbytes(r.choice((20, 32, 48, 64)))).decode(), end, where, False)
        elif kind < 0.85:
            line(f'{head} {r.choice(key)} = "', harmless(), '"' + end, where, False)
        else:
            q = '"'
            fake = f"{head} {r.choice(('example', 'dummy', 'fake', 'sample', 'test', 'placeholder'))} {r.choice(key)} = {q}"
            line(fake, secret(), q + end, f"{r.choice(('tests', 'examples', 'fixtures', 'test', 'docs/examples', 'testdata', 'samples'))}/{r.choice((r.choice(nice), 'example', 'sample', 'mock'))}.{r.choice(ends)}", False)
    return out[:n]


class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left, right, share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        if not len(y):
            x, y = np.zeros((1, x.shape[1])), np.zeros(1, bool)
        tries = max(1, int(math.sqrt(x.shape[1])))
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list] = []
            self._grow(x, y, rows, depth, tries, rng, nodes)
            f, t, left, right, v = map(np.array, zip(*nodes))
            self.trees.append((f.astype(np.int64), t.astype(np.float64), left.astype(np.int64), right.astype(np.int64), v.astype(np.float64)))

    def _grow(self, x, y, rows, depth, tries, rng, nodes) -> int:
        me, yes = len(nodes), float(y[rows].mean()) if len(rows) else 0.0
        nodes.append([-1, 0.0, 0, 0, yes])
        if depth == 0 or len(rows) < 6 or yes in (0.0, 1.0):
            return me
        best = (1e9, -1, 0.0)
        for f in rng.choice(x.shape[1], tries + 1, replace=False):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            v, t = v[order], y[rows][order].astype(np.float64)
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left, n = np.cumsum(t)[cut], cut + 1.0
            right, m = t.sum() - left, len(v) - n
            gini = left * (n - left) / n + right * (m - right) / m
            k = int(np.argmin(gini))
            if gini[k] < best[0]:
                best = (gini[k], int(f), (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] < 0:
            return me
        low = x[rows, best[1]] <= best[2]
        nodes[me][:2] = best[1:]
        nodes[me][2] = self._grow(x, y, rows[low], depth - 1, tries, rng, nodes)
        nodes[me][3] = self._grow(x, y, rows[~low], depth - 1, tries, rng, nodes)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, left, right, v in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(f[at] >= 0)
                if not len(inner):
                    break
                n = at[inner]
                at[inner] = np.where(x[inner, f[n]] <= t[n], left[n], right[n])
            total += v[at]
        return total / len(self.trees)


class Scanner:
    def __init__(self, findings=None, path: str = VOCABULARY, limit: int = FINDINGS):
        self.words = dictionary(path)
        self.longest = max(map(len, self.words), default=0)
        self.pairs = letter_pairs(self.words)
        rows = list(findings if findings is not None else labelled_findings(limit, path=path))
        rows = rows[:: max(1, math.ceil(len(rows) / limit))]
        halves = [odds(rows[1::2]), odds(rows[::2])]  # those of the other half, by the row's place
        x = np.array([self._row(r, halves[k % 2]) for k, r in enumerate(rows)]).reshape(-1, len(FEATURES))
        self.weights = odds(rows)
        self.forest = Forest(x, np.array([bool(r[4]) for r in rows]))

    def _row(self, finding, weights) -> list[float]:
        return features(*finding[:4], self.words, self.pairs, weights, self.longest)

    def scan(self, texts: list[str | None], paths: list[str | None]):
        """(row, start, value, score) of every candidate."""
        found, x = [], []
        for k, (text, path) in enumerate(zip(texts, paths)):
            for start, value, before, after in candidates(text or ""):
                found.append((k, start, value))
                x.append(self._row((before, value, after, path), self.weights))
        score = self.forest.predict(np.array(x)) if x else np.zeros(0)
        return found, score


def _scanned(batches, scanner: Scanner, cutoff: float):
    for batch in batches:
        found, score = scanner.scan(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        hit = [(k, s, v, round(float(p), 6)) for (k, s, v), p in zip(found, score) if p >= cutoff]
        rows = pa.array([h[0] for h in hit], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows), pa.array([h[1] for h in hit], pa.int64()), pa.array([len(h[2]) for h in hit], pa.int64()),
                pa.array([h[2][: min(4, len(h[2]) // 3)] + "..." for h in hit], pa.string()), pa.array([hashlib.sha256(h[2].encode()).hexdigest() for h in hit], pa.string()), pa.array([h[3] for h in hit], pa.float64()),
            ],
            ["doc_id", "start", "length", "shown", "sha256", "score"],
        )


def find_secrets(docs: DataFrame, findings=None, path: str = VOCABULARY, cutoff: float = CUTOFF, limit: int = FINDINGS) -> DataFrame:
    """(doc_id, start, length, shown, sha256, score): the candidates that the forest takes for secrets, with a score of `cutoff` or more.

    start counts characters from 0; shown has the first four, of short values the first third, sha256 stands for the value. `docs` has doc_id, text and
    source, which is the path. Null and empty texts have no findings, a null source no path; a null doc_id and repeated rows give findings of
    their own. Texts are scanned whole, values of any length looked at whole. Further columns are left out. Of `findings` at
    most `limit` rows, evenly taken, train the forest; without any all is taken for harmless.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(findings, path, limit)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").mapInArrow(
        lambda it: _scanned(it, scanner, cutoff), "doc_id bigint, start bigint, length bigint, shown string, sha256 string, score double"
    )
