"""Operator 6: pages on a list of URLs, by a blocked Bloom filter and an exact hash join.

A listed URL, a listed host, or a listed parent domain of the host matches a page. The filter's blocks of 512 bits
are rows of a table, one row with eight 64-bit words for each block, made by `bit_or`; a key sets, and a probe tests,
seven bits of a single block. Keys that the filter lets through are joined with the list itself.
The table is broadcast up to `BROADCAST_BYTES`; beyond that the probes are joined with it by block number.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
HASHES = 7
BROADCAST_BYTES = 32 << 20
#: Query parameters that don't tell pages apart.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"


def canonical(url: Column) -> Column:
    """host/path?sorted parameters: without scheme, user, default port, `www.`, fragment, tracking parameters and final slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "#[^\n]*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"\.?(:80|:443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def keys(canon: Column) -> Column:
    """The URL itself, its host and each parent domain of two labels or more."""
    labels = F.split(F.regexp_extract(canon, r"^([^/?]*)", 1), r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.filter(F.array_distinct(F.concat(F.array(canon), up)), lambda k: k != "")


def _bits(key: Column, blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """The key's block, and word and place of each of its bits."""
    h = F.xxhash64(key, F.lit(1))
    nine = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(HASHES)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [(F.shiftright(b, 6).cast("int"), b.bitwiseAND(F.lit(63)).cast("int")) for b in nine]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the keys in column `key`."""
    block, bits = _bits(F.col("key"), blocks)
    marked = listed.select(block.alias("block"), F.array(*[F.struct(w.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias("m")) for w, b in bits]).alias("b"))
    words = [reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col("b")[i]["w"] == w, F.col("b")[i]["m"]).otherwise(F.lit(0).cast("bigint")) for i in range(HASHES)]) for w in range(8)]
    return marked.groupBy("block").agg(*[F.bit_or(x).alias(f"w{w}") for w, x in enumerate(words)])


def possible(probes: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """The probes, with column `key`, that the filter lets through."""
    block, at = _bits(F.col("key"), blocks)
    filter_bytes = blocks * 80
    side = F.broadcast(bits) if filter_bytes <= BROADCAST_BYTES else bits
    words = F.array(*[f"w{w}" for w in range(8)])
    passed = reduce(lambda x, y: x & y, [F.call_function("shiftrightunsigned", words[w], b).bitwiseAND(F.lit(1).cast("bigint")) == 1 for w, b in at])
    return probes.withColumn("block", block).join(side, "block").filter(passed).select(*probes.columns)


def filter_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, url, canonical, matched, blocked) for every page; `listed` has a column url.

    matched is the smallest listed key that the page has, null where blocked is false. A listed URL without a path
    blocks its host and all below it. Null URLs, on either side, and empty ones match nothing; a null page_id and
    repeated rows are kept as they are. Further columns, whatever their names, are left out. An empty list blocks
    nothing.
    """
    block_list = listed.select(canonical(F.col("url")).alias("key")).filter("key <> ''").distinct()
    blocks = max(1, math.ceil(block_list.count() * BITS_PER_KEY / 512))
    own = pages.select("page_id", "url", canonical(F.col("url")).alias("canonical"))
    probes = own.select("canonical").filter(F.col("canonical").isNotNull()).distinct().select("canonical", F.explode(keys(F.col("canonical"))).alias("key"))
    hits = possible(probes, bloom(block_list, blocks), blocks).join(block_list, "key", "left_semi").groupBy("canonical").agg(F.min("key").alias("matched"))
    return own.join(hits, "canonical", "left").select("page_id", "url", "canonical", "matched", F.col("matched").isNotNull().alias("blocked"))


_CANON = r"""
  SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '#[^\n]*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM {0}"""
_CANON2 = r"""
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), '\.?(:80|:443)?$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$'))) AS params FROM {0}"""
ORACLE = f"""
WITH l0 AS (SELECT url FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT unnest(['http://casino-win.example.com/', 'free-bets.example.com'])),
p1 AS ({_CANON.format("pages")}), p2 AS ({_CANON2.format("p1")}), l1 AS ({_CANON.format("l0")}), l2 AS ({_CANON2.format("l1")}),
p AS (SELECT page_id, url, host, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM p2),
l AS (SELECT DISTINCT host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key FROM l2),
k AS (SELECT DISTINCT canonical, canonical AS key FROM p UNION SELECT DISTINCT canonical, array_to_string(string_split(host, '.')[i:], '.') FROM p, range(1, 20) r(i)
      WHERE i < len(string_split(host, '.')) OR i = 1),
m AS (SELECT canonical, min(key) AS matched FROM k JOIN l USING (key) WHERE key <> '' GROUP BY canonical)
SELECT page_id, url, p.canonical, matched, matched IS NOT NULL AS blocked FROM p LEFT JOIN m ON m.canonical = p.canonical
"""
