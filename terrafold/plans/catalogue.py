"""Queries over the driver's tables, with the DuckDB SQL of each.

documents stand for files (rel_path source/lang/doc_id, package the source, language the lang), pages for paths of a source tree,
events and conversations for session logs, labels for outcomes. The saved state is documents without every seventh,
every fifth with another hash, and some rows of files that are gone.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import classify, textops
from terrafold.operators import benchmarks, hashing, packages, sessions, state
from terrafold.plans.render import hash_of_line, paths_lines, table_rows

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as files

FILES = "f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS rel_path, source, lang, text, sha256(text) AS content_hash, length(text) AS size, doc_id * 1000 AS mtime_ns FROM documents)"
SAVED = """p AS (SELECT rel_path, CASE WHEN doc_id % 5 = 0 THEN 'x' || content_hash ELSE content_hash END AS content_hash, size, CASE WHEN doc_id % 5 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns, source, lang
  FROM f WHERE doc_id % 7 <> 0 UNION ALL SELECT source || '/' || lang || '/' || (doc_id + 1000000000), content_hash, size, mtime_ns, source, lang FROM f WHERE doc_id % 11 = 0)"""


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("rel_path"), "source", "lang", "text", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("bigint").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns")
    )


def saved(spark, sf_dir) -> DataFrame:
    f, fifth = files(spark, sf_dir), F.col("doc_id") % 5 == 0
    here = f.filter("doc_id % 7 <> 0").select("rel_path", F.when(fifth, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"), "size", F.when(fifth, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "source", "lang")
    gone = f.filter("doc_id % 11 = 0").select(F.concat_ws("/", "source", "lang", F.col("doc_id") + 1000000000).alias("rel_path"), "content_hash", "size", "mtime_ns", "source", "lang")
    return here.unionAll(gone)


_WHITE = r"[\x{09}-\x{0D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}|{_WHITE}$', '', 'g')"


_T = _trimmed("text")
_HEAD = f"regexp_extract({_T}, '^[^.\\n]*[.\\n]', 0)"
#: The sentence's bytes in hexadecimal digits, as a cut may go through a character.
SENTENCE = f"CASE WHEN {_HEAD} <> '' THEN hex(encode({_trimmed(_HEAD)})) WHEN strlen({_T}) > 100 THEN hex(encode({_T}))[:200] || '2E2E2E' ELSE hex(encode({_T})) END"


def in_hex(c):
    return F.hex(c.cast("binary"))


LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END"
SCORE = "(CASE WHEN lang = 'en' THEN 50 ELSE 0 END + CASE WHEN length(text) > 1000 THEN 20 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END)"
ROLLED = f"""{FILES}, g AS (SELECT *, CASE WHEN lang = 'en' THEN 'go' ELSE lang END AS language, {LINES} AS n, {SENTENCE} AS s, {SCORE} AS score, doc_id % 40 = 3 AS doc, 'T' || doc_id % 13 AS t FROM f),
  i AS (SELECT language, source, w, row_number() OVER (PARTITION BY language, source ORDER BY rel_path, k) AS place FROM (SELECT language, source, rel_path, unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,5}}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{{3,5}}'), 1) AS k FROM g)),
  d AS (SELECT language, source, w, min(place) AS place FROM i GROUP BY ALL),
  m AS (SELECT language, source, string_agg(w, ',' ORDER BY CASE WHEN language = 'go' THEN place END, w) AS imports, count(*) AS n_imports FROM d GROUP BY ALL)"""


def rolled(spark, sf_dir, large: int = 10) -> DataFrame:
    """Packages (lang, source) of documents by the library's rollup, `en` standing for the language that keeps its order."""
    f = files(spark, sf_dir)
    score = F.when(F.col("lang") == "en", 50).otherwise(0) + F.when(F.col("size") > 1000, 20).otherwise(0) + F.when(F.col("doc_id") % 3 == 0, 10).otherwise(0)
    t = F.concat(F.lit("T"), (F.col("doc_id") % 13).cast("string"))
    per_file = f.select(
        F.when(F.col("lang") == "en", "go").otherwise(F.col("lang")).alias("language"), F.col("source").alias("pkg_root"), F.col("rel_path").alias("name"), textops.line_count(F.col("text")).alias("line_count"), textops.first_sentence(F.col("text")).alias("purpose"),
        F.array(F.struct(t.alias("name"), F.lit("type").alias("kind"), F.lit("").alias("comment"))).alias("types"), F.array(t).alias("key_types"), F.array().cast("array<string>").alias("key_funcs"),
        F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,5})"), 1).alias("imports"), score.alias("score"), (F.col("doc_id") % 40 == 3).alias("doc_file"),
    )
    return packages.rollup(per_file, large)


@query(f"""WITH {ROLLED} SELECT g.language, g.source AS package, count(*) AS file_count, CAST(sum(n) AS BIGINT) AS line_count, coalesce(first(s ORDER BY NOT doc, rel_path) FILTER (WHERE s <> ''), '') AS purpose,
  first(rel_path ORDER BY score DESC, rel_path) AS entry_point, string_agg(t, ',' ORDER BY CASE WHEN g.language = 'go' THEN rel_path ELSE t END) AS types, coalesce(any_value(m.imports), '') AS imports
  FROM g LEFT JOIN m ON m.language = g.language AND m.source = g.source GROUP BY ALL""")
def package_rollup(spark, sf_dir):
    r = rolled(spark, sf_dir)
    return r.select("language", F.col("pkg_root").alias("package"), "file_count", "line_count", in_hex(F.col("purpose")).alias("purpose"), "entry_point", F.array_join(F.transform("exported_types", lambda t: t["name"]), ",").alias("types"), F.array_join("imports", ",").alias("imports"))


@query(f"WITH {FILES} SELECT source AS package, sha256(string_agg(rel_path || chr(0) || content_hash || chr(0), '' ORDER BY rel_path)) AS fingerprint FROM f GROUP BY source")
def package_fingerprint(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.col("source").alias("package")).agg(hashing.fingerprint().alias("fingerprint"))


# a file whose name goes on where a directory's ends comes before it by string and behind it in a walk
WALKED = "k AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN source || '/' || lang || '.go' || doc_id ELSE rel_path END AS rel_path, content_hash FROM f)"


def walked(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).select("source", F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("/"), "lang", F.lit(".go"), F.col("doc_id").cast("string"))).otherwise(F.col("rel_path")).alias("rel_path"), "content_hash")


@query(f"""WITH {FILES}, {WALKED} SELECT sha256(string_agg(rel_path || chr(0) || content_hash || chr(0), '' ORDER BY string_split(rel_path, '/'))) AS aggregate_hash,
  sha256(string_agg(rel_path || chr(0) || content_hash || chr(0), '' ORDER BY rel_path)) AS by_string FROM k""")
def aggregate_hash_walk_order(spark, sf_dir):
    f = walked(spark, sf_dir)
    return hashing.aggregate_hash(f).crossJoin(f.agg(hashing.fingerprint().alias("by_string")))


@query(f"WITH {FILES}, {WALKED} SELECT source, sha256(string_agg(rel_path || chr(0) || content_hash || chr(0), '' ORDER BY string_split(rel_path, '/'))) AS aggregate_hash FROM k GROUP BY source")
def aggregate_hash_by_source(spark, sf_dir):
    return hashing.aggregate_hash(walked(spark, sf_dir), "source")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "content_hash")


@query(f"""WITH {FILES}, {SAVED} SELECT rel_path, CASE WHEN p.content_hash IS NULL THEN 'added' WHEN f.content_hash IS NULL THEN 'deleted' WHEN f.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM f FULL JOIN p USING (rel_path)""")
def state_diff(spark, sf_dir):
    return state.diff(files(spark, sf_dir), saved(spark, sf_dir))


@query(f"WITH {FILES}, {SAVED} SELECT f.rel_path, f.size, f.mtime_ns, CASE WHEN f.size = p.size AND f.mtime_ns = p.mtime_ns AND p.content_hash <> '' THEN p.content_hash END AS content_hash FROM f LEFT JOIN p USING (rel_path)")
def hash_reuse(spark, sf_dir):
    return state.reuse_hashes(files(spark, sf_dir).select("rel_path", "size", "mtime_ns"), saved(spark, sf_dir))


_SAME = "SELECT '{0}' AS case_name, coalesce(bool_and(coalesce(x.size = y.size AND x.mtime_ns = y.mtime_ns, false)), true) AS matches FROM {1} x FULL JOIN {2} y USING (rel_path)"


@query(f"WITH {FILES}, {SAVED}, less AS (SELECT * FROM f WHERE doc_id > 0), none AS (SELECT * FROM f WHERE false) {_SAME.format('saved', 'f', 'p')} UNION ALL {_SAME.format('same', 'f', 'f')} UNION ALL {_SAME.format('one less', 'less', 'f')} UNION ALL {_SAME.format('one more', 'f', 'less')} UNION ALL {_SAME.format('empty', 'none', 'none')}")
def state_matches(spark, sf_dir):
    f, less = files(spark, sf_dir), files(spark, sf_dir).filter("doc_id > 0")
    cases = {"saved": (saved(spark, sf_dir), f), "same": (f, f), "one less": (f, less), "one more": (less, f), "empty": (f.limit(0), f.limit(0))}
    out = [state.matches(a, b, "rel_path", "size", "mtime_ns").select(F.lit(name).alias("case_name"), "matches") for name, (a, b) in cases.items()]
    return reduce(DataFrame.unionAll, out)


@query(f"WITH {FILES}, {SAVED} SELECT bool_and(f.rel_path IS NOT NULL) AS valid, bool_and(coalesce(f.size = p.size AND f.mtime_ns = p.mtime_ns, false)) AS unchanged FROM p LEFT JOIN f USING (rel_path)")
def state_rebuild(spark, sf_dir):
    return state.rebuilt(saved(spark, sf_dir), files(spark, sf_dir))


@query(f"""WITH {FILES}, a AS (SELECT doc_id AS pos, rel_path, size, mtime_ns FROM f), b AS (SELECT doc_id AS pos, rel_path, size, mtime_ns FROM f WHERE doc_id % 97 <> 5), eq AS (SELECT pos, coalesce(a.rel_path = b.rel_path AND a.size = b.size AND a.mtime_ns = b.mtime_ns, false) AS e FROM a FULL JOIN b USING (pos))
SELECT 'holes' AS case_name, bool_and(e) AS same FROM eq UNION ALL SELECT 'equal', bool_and(e) FROM eq WHERE pos % 97 <> 5""")
def positional_equality(spark, sf_dir):
    a = files(spark, sf_dir).select(F.col("doc_id").alias("pos"), "rel_path", "size", "mtime_ns")
    b = a.filter("pos % 97 <> 5")
    return state.same_sequence(a, b).select(F.lit("holes").alias("case_name"), "same").unionAll(state.same_sequence(b, b).select(F.lit("equal").alias("case_name"), "same"))


_PLANS = "SELECT lang AS language, source AS pkg_root, CASE WHEN bool_or({h} = '') THEN '' ELSE sha256(string_agg(rel_path || chr(0) || {h} || chr(0), '' ORDER BY rel_path)) END AS fingerprint FROM {t} GROUP BY ALL"


def _plans(spark, sf_dir):
    cur = files(spark, sf_dir).select(F.col("lang").alias("language"), F.col("source").alias("pkg_root"), "rel_path", "content_hash", "doc_id")
    old = cur.withColumn("content_hash", F.when((F.col("pkg_root").isin("src1", "src2", "src3")) & (F.col("doc_id") % 3 == 0), "x").otherwise(F.col("content_hash")))
    return packages.plans(cur), packages.plans(old)


_OLD = "o AS (SELECT * REPLACE (CASE WHEN source IN ('src1', 'src2', 'src3') AND doc_id % 3 = 0 THEN 'x' ELSE content_hash END AS content_hash) FROM f)"


@query(f"WITH {FILES}, {_OLD}, n AS ({_PLANS.format(h='content_hash', t='f')}), c AS ({_PLANS.format(h='content_hash', t='o')}) SELECT language, pkg_root, fingerprint FROM n ANTI JOIN c USING (language, pkg_root, fingerprint)")
def stale_packages(spark, sf_dir):
    return packages.stale_plans(*_plans(spark, sf_dir)).select("language", "pkg_root", "fingerprint")


@query(f"WITH {FILES}, {_OLD}, n AS ({_PLANS.format(h='content_hash', t='f')}), c AS ({_PLANS.format(h='content_hash', t='o')}) SELECT language, pkg_root, fingerprint FROM n SEMI JOIN c USING (language, pkg_root, fingerprint)")
def reused_packages(spark, sf_dir):
    return packages.reused_plans(*_plans(spark, sf_dir)).select("language", "pkg_root", "fingerprint")


@query(f"WITH {FILES} {_PLANS.format(h=chr(40) + 'CASE WHEN doc_id % 101 = 0 THEN ' + chr(39) * 2 + ' ELSE content_hash END)', t='f')}")
def fingerprint_missing_guard(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("content_hash", F.when(F.col("doc_id") % 101 == 0, "").otherwise(F.col("content_hash")))
    return f.groupBy(F.col("lang").alias("language"), F.col("source").alias("pkg_root")).agg(hashing.fingerprint().alias("fingerprint"))


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(arg_min(lang, (1000000000 - n) || lang), 'go') AS language FROM (SELECT lang, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang)")
def dominant_language(spark, sf_dir):
    return packages.dominant_language(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")), "go")


@query("SELECT language FROM (VALUES ('en'), ('fr'), ('it'), ('de')) r(language) SEMI JOIN (SELECT DISTINCT lang AS language FROM documents) d USING (language)")
def analyzer_languages(spark, sf_dir):
    registered = spark.createDataFrame([("en",), ("fr",), ("it",), ("de",)], "language string")
    return registered.join(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")).distinct(), "language", "left_semi")


@query(f"SELECT doc_id, {SENTENCE} AS sentence FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", in_hex(textops.first_sentence(F.col("text"))).alias("sentence"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 60 THEN hex(encode(text))[:114] || '2E2E2E' ELSE hex(encode(text)) END AS purpose FROM documents")
def truncate_purpose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", in_hex(textops.truncate(F.col("text"), 60)).alias("purpose"))


@query(f"SELECT doc_id, {LINES} AS lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textops.line_count(F.col("text")).alias("lines"))


@query(f"""WITH {ROLLED}, p AS (SELECT source AS relative_path, language AS import_path, first(rel_path ORDER BY score DESC, rel_path) AS entry_point, count(*) AS file_count, CASE WHEN count(*) >= 12 THEN string_agg(rel_path || ':' || n, ',' ORDER BY rel_path) END AS detail FROM g GROUP BY ALL)
SELECT * FROM p ORDER BY relative_path, import_path, entry_point LIMIT 25""")
def sort_packages_top(spark, sf_dir):
    r = rolled(spark, sf_dir, 12).withColumns({"relative_path": F.col("pkg_root"), "import_path": F.col("language")})
    detail = F.array_join(F.transform("files", lambda f: F.concat(f["name"], F.lit(":"), f["line_count"].cast("string"))), ",")
    return packages.sorted_packages(r).limit(25).select("relative_path", "import_path", "entry_point", "file_count", detail.alias("detail"))


@query(f"""WITH {FILES}, {_OLD}, n AS ({_PLANS.format(h='content_hash', t='f')}), c AS ({_PLANS.format(h='content_hash', t='o')})
SELECT language, pkg_root, 'reused' AS origin FROM n SEMI JOIN c USING (language, pkg_root, fingerprint) UNION ALL SELECT language, pkg_root, 'fresh' FROM n ANTI JOIN c USING (language, pkg_root, fingerprint)""")
def package_union(spark, sf_dir):
    plan, cache = _plans(spark, sf_dir)
    kept = packages.reused_plans(plan, cache).select("language", "pkg_root", F.lit("reused").alias("origin"))
    return kept.unionByName(packages.stale_plans(plan, cache).select("language", "pkg_root", F.lit("fresh").alias("origin")))


@query(f"WITH {ROLLED} SELECT language, source, imports, n_imports AS n FROM m")
def import_set(spark, sf_dir):
    return rolled(spark, sf_dir).filter(F.size("imports") > 0).select("language", F.col("pkg_root").alias("source"), F.array_join("imports", ",").alias("imports"), F.size("imports").cast("bigint").alias("n"))


@query("SELECT DISTINCT source AS name FROM documents EXCEPT SELECT unnest(['src1', 'src3', 'ATLAS.md'])")
def root_entry_diff(spark, sf_dir):
    own = spark.createDataFrame([("src1",), ("src3",), ("ATLAS.md",)], "name string")
    return state.missing_from(table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct(), own, "name")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN doc_id || '.py' ELSE source || '/' || doc_id || '.py' END AS entry_path FROM documents""")
def entry_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    entry = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".py")))
    return d.select("doc_id", textops.entry_path(F.when(F.col("doc_id") % 5 == 0, ".").otherwise(F.col("source")), entry).alias("entry_path"))


_CUT = "CASE WHEN length(s) > 2 * {0} THEN s[:2 * {0} - 6] || '2E2E2E' ELSE s END"
_LISTED = f"g AS (SELECT source, min(rel_path) AS e, coalesce(arg_min(s, rel_path) FILTER (WHERE s <> ''), '') AS s FROM (SELECT *, {SENTENCE} AS s FROM f) GROUP BY source)"


def listed(spark, sf_dir) -> DataFrame:
    g = files(spark, sf_dir).select("source", "rel_path", textops.first_sentence(F.col("text")).alias("s")).groupBy(F.col("source").alias("relative_path"))
    return g.agg(F.min("rel_path").alias("entry_point"), F.coalesce(F.min_by("s", F.when(F.col("s") != "", F.col("rel_path"))), F.lit("")).alias("purpose"))


@query(f"""WITH {FILES}, {_LISTED} SELECT hex(encode(source || chr(9) || source || '/' || e)) || CASE WHEN s = '' THEN '' ELSE '09' || {_CUT.format(80)} END AS line FROM g""")
def render_paths_lines(spark, sf_dir):
    return paths_lines(listed(spark, sf_dir)).select(in_hex(F.col("line")).alias("line"))


@query(f"""WITH {FILES}, {_LISTED} SELECT hex(encode('| ' || source || ' | ' || source || '/' || e || ' | ')) || {_CUT.format(60)} || hex(encode(' |')) AS line FROM g""")
def render_table_rows(spark, sf_dir):
    return table_rows(listed(spark, sf_dir)).select(in_hex(F.col("line")).alias("line"))


# --- pages as paths of a source tree

PATHS = """t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) || '/' || (['src', 'tests', 'cmd', 'internal/scripts', 'bin', 'pkg/src/util', '__tests__', 'docs'])[1 + page_id % 8] || '/' ||
  (['main', 'config', 'error_x', 'cli_tool', 'test_a', 'helper_test', 'index.spec', 'util'])[1 + (page_id // 8) % 8] || (['.go', '.py', '.rs', '.sh', '.bash', '.bats', '.ts', '.tsx', '.mts', '.cts', ''])[1 + page_id % 11] AS rel_path FROM pages)"""


def paths(spark, sf_dir) -> DataFrame:
    i = F.col("page_id").cast("int")
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k)
    name = at(["main", "config", "error_x", "cli_tool", "test_a", "helper_test", "index.spec", "util"], F.floor(i / 8).cast("int") % 8)
    folder = at(["src", "tests", "cmd", "internal/scripts", "bin", "pkg/src/util", "__tests__", "docs"], i % 8)
    suffix = at([".go", ".py", ".rs", ".sh", ".bash", ".bats", ".ts", ".tsx", ".mts", ".cts", ""], i % 11)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1), F.lit("/"), folder, F.lit("/"), name, suffix).alias("rel_path"))


CONCERNS = [("Errors", ["**/error*.go", "**/*error*.py", "**/*error*.ts", "**/*error*.tsx"]), ("Commands", ["en/cmd/**/*.go", "**/cli_*.go", "**/cli*.py", "**/cli*.sh"]), ("Settings", ["**/config*.go", "**/*config*.py", "a/**/b/**"]), ("Nothing", ["nowhere/**/*.x"])]
#: The same by hand, so that the oracle doesn't rest on the engine's own patterns.
_C = r"""(0, 'Errors', '^(.*/)?(error[^/]*\.go|[^/]*error[^/]*\.(py|ts|tsx))$'), (1, 'Commands', '^(en/cmd/(.*/)?[^/]*\.go|(.*/)?(cli_[^/]*\.go|cli[^/]*\.(py|sh)))$'),
  (2, 'Settings', '^((.*/)?(config[^/]*\.go|[^/]*config[^/]*\.py)|a/(.*/)?b/.*)$'), (3, 'Nothing', '^nowhere/(.*/)?[^/]*\.x$')"""


@query(f"WITH {PATHS}, d(place, concern, rx) AS (VALUES {_C}) SELECT CAST(place AS BIGINT) AS place, concern, count(DISTINCT rel_path) AS total_files FROM t JOIN d ON regexp_matches(rel_path, rx) GROUP BY ALL")
def concern_counts(spark, sf_dir):
    return packages.concerns(paths(spark, sf_dir), CONCERNS).drop("files")


@query(f"""WITH {PATHS}, d(place, concern, rx) AS (VALUES {_C}), h AS (SELECT DISTINCT concern, rel_path FROM t JOIN d ON regexp_matches(rel_path, rx)),
r AS (SELECT *, row_number() OVER (PARTITION BY concern ORDER BY rel_path) AS n FROM h) SELECT concern, string_agg(rel_path, ',' ORDER BY rel_path) AS files FROM r WHERE n <= 3 GROUP BY concern""")
def concern_examples(spark, sf_dir):
    return packages.concerns(paths(spark, sf_dir), CONCERNS, 3).select("concern", F.array_join("files", ",").alias("files"))


@query(f"WITH {PATHS} SELECT page_id, rel_path FROM t WHERE regexp_matches(rel_path, '^([^/]*/)*error[^/]*\\.go$')")
def pattern_match(spark, sf_dir):
    return packages.matching(paths(spark, sf_dir), "**/error*.go")


@query(f"""WITH {PATHS}, d AS (SELECT DISTINCT regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS dir FROM t), m AS (SELECT dir FROM d WHERE dir LIKE '%src' OR dir LIKE '%bin' UNION SELECT 'de' UNION SELECT 'en/pkg'),
x AS (SELECT dir, array_to_string(string_split(dir, '/')[:n], '/') AS a, n FROM d, range(1, 10) r(n) WHERE n <= len(string_split(dir, '/')))
SELECT d.dir, coalesce(f.root, '.') AS root FROM d LEFT JOIN (SELECT x.dir, arg_max(a, n) AS root FROM x JOIN m ON m.dir = a GROUP BY x.dir) f ON f.dir = d.dir""")
def nearest_ancestor(spark, sf_dir):
    dirs = packages.file_dirs(paths(spark, sf_dir)).distinct()
    own = dirs.filter(F.col("dir").endswith("src") | F.col("dir").endswith("bin")).unionAll(spark.createDataFrame([("de",), ("en/pkg",)], "dir string"))
    return packages.nearest_ancestor(dirs, own)


_BASE = "lower(regexp_extract(rel_path, '([^/]*)$', 1))"
_LANG = f"""CASE WHEN regexp_matches({_BASE}, '\\.go$') THEN 'go' WHEN regexp_matches({_BASE}, '\\.py$') THEN 'python' WHEN regexp_matches({_BASE}, '\\.rs$') THEN 'rust' WHEN regexp_matches({_BASE}, '\\.(sh|bash|bats)$') THEN 'shell'
  WHEN regexp_matches({_BASE}, '\\.(ts|tsx|mts|cts)$') THEN 'typescript' END"""


@query(f"""WITH {PATHS}, l AS (SELECT *, {_LANG} AS language, {_BASE} AS b FROM t) SELECT page_id, rel_path, language, coalesce(CASE language WHEN 'go' THEN b LIKE '%\\_test.go' ESCAPE '\\' WHEN 'rust' THEN regexp_matches(b, '(_test|\\.test|\\.spec)\\.rs$') OR regexp_matches(rel_path, '(^|/)tests/')
  WHEN 'python' THEN regexp_matches(b, '(_test|\\.test|\\.spec)\\.py$|^test_.*\\.py$') OR regexp_matches(rel_path, '(^|/)tests?/') WHEN 'shell' THEN regexp_matches(b, '(_test|\\.test|\\.spec)\\.(sh|bash)$|^test_.*\\.(sh|bash)$|\\.bats$') OR regexp_matches(rel_path, '(^|/)tests?/')
  WHEN 'typescript' THEN regexp_matches(b, '\\.(test|spec)\\.(ts|tsx|mts|cts)$') OR regexp_matches(rel_path, '(^|/)__tests__/') END, false) AS is_test FROM l""")
def classify_lang_test(spark, sf_dir):
    t = paths(spark, sf_dir).withColumn("language", classify.language(F.col("rel_path")))
    return t.withColumn("is_test", classify.is_test_path(F.col("rel_path"), F.col("language")))


def _guess(segments) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN starts_with(rel_path, '{s}/') THEN '.' WHEN regexp_matches(rel_path, '^.+?/{s}/') THEN regexp_extract(rel_path, '^(.+?)/{s}/', 1) END" for s in segments) + ")"


@query(f"""WITH {PATHS} SELECT page_id, {_guess(("src", "tests", "test"))} AS python_root, CASE WHEN {_guess(classify.SHELL_SEGMENTS)} IS NOT NULL AND regexp_matches(rel_path, '(^|/)(scripts|bin)/') THEN {_guess(classify.SHELL_SEGMENTS)}
  ELSE regexp_extract(rel_path, '^(.*)/[^/]*$', 1) END AS shell_root FROM t""")
def package_root_guess(spark, sf_dir):
    p = F.col("rel_path")
    return paths(spark, sf_dir).select("page_id", classify.root_guess(p, classify.ROOT_SEGMENTS["python"]).alias("python_root"), classify.shell_root(p).alias("shell_root"))


@query(f"""WITH {PATHS}, w AS (SELECT page_id, lower(regexp_replace(rel_path, '^[a-z]+/', '')) AS p, {_LANG} AS l FROM t) SELECT page_id, CAST(CASE l
  WHEN 'python' THEN CASE WHEN p IN ('src/main.py', 'main.py') THEN 120 ELSE 0 END + CASE WHEN regexp_matches(p, '(^|/)bin/') THEN 100 ELSE 0 END + CASE WHEN regexp_matches(p, '(^|/)scripts/') THEN 90 ELSE 0 END + 25
  WHEN 'shell' THEN CASE WHEN p IN ('scripts/main.sh', 'scripts/main.bash') THEN 140 WHEN p IN ('main.sh', 'main.bash') THEN 130 WHEN regexp_matches(p, '/main\\.(sh|bash)$') THEN 110 ELSE 0 END + CASE WHEN regexp_matches(p, '(^|/)bin/') THEN 120 ELSE 0 END
    + CASE WHEN regexp_matches(p, '(^|/)scripts/') THEN 100 ELSE 0 END + 20 + 5 + 10
  WHEN 'rust' THEN CASE WHEN p = 'src/main.rs' THEN 120 ELSE 0 END + 5 + 10
  WHEN 'typescript' THEN CASE WHEN p IN ('src/main.ts', 'src/main.tsx') THEN 100 ELSE 0 END + 10
  WHEN 'go' THEN CASE WHEN regexp_matches(p, '(^|/)main\\.go$') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(p, '(^|/)util\\.go$') THEN 100 ELSE 0 END + 30 ELSE 0 END AS BIGINT) AS score FROM w""")
def entry_score(spark, sf_dir):
    types, funcs = F.array(F.lit("Util")), F.array(F.lit("main"), F.lit("run_all"))
    t = paths(spark, sf_dir).withColumn("language", classify.language(F.col("rel_path")))
    return t.select("page_id", classify.entry_score(F.col("language"), F.regexp_replace("rel_path", "^[a-z]+/", ""), F.lit("util"), types, funcs).alias("score"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '00ff' || page_id WHEN 1 THEN 'ab' || page_id WHEN 2 THEN 'c' || page_id ELSE '' END AS hash FROM pages""")
def hash_line_parse(spark, sf_dir):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    line = F.when(k == 0, F.concat(F.lit("<!-- atlas-hash: 00ff"), i, F.lit(" -->"))).when(k == 1, F.concat(F.lit("# atlas-hash: ab"), i)).when(k == 2, F.concat(F.lit(" atlas-hash: c"), i, F.lit(" more"))).when(k == 3, "# atlas-hash: INVALID").otherwise("text")
    return table(spark, sf_dir, "pages").select("page_id", hash_of_line(line).alias("hash"))


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS name FROM pages), n AS (SELECT page_id, name, regexp_extract(replace(name, '-', '_'), '^([^.]+)', 1) AS p FROM x)
SELECT page_id, CASE WHEN regexp_matches(p, '^[A-Za-z_][A-Za-z0-9_]*$') THEN p ELSE '' END AS prefix, (p || '.core') LIKE (p || '.%') AS internal FROM n""")
def import_rules(spark, sf_dir):
    x = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("name")).withColumn("prefix", classify.import_prefix(F.col("name"), F.lit(".")))
    return x.select("page_id", "prefix", classify.internal_import(F.concat("prefix", F.lit(".core")), F.col("prefix"), ".").alias("internal"))


# --- events and conversations as session logs


def event_actions(spark, sf_dir) -> DataFrame:
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("ord"), F.to_date("ts").alias("day"),
        (t == "view").alias("touch"), (t == "purchase").alias("edit"), F.when(t == "click", F.col("props")).alias("read_path"), (t == "signup").alias("run"), (t == "error").alias("commit"), "event_id", "ts", "props", "user_id",
    )


ACTIONS = """a AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, CAST(user_id AS VARCHAR) AS session_id, event_id, ts, event_type AS t, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT *, min(CASE WHEN t = 'purchase' THEN i END) OVER (PARTITION BY session_id) AS ei FROM a),
s AS (SELECT source, session_id, count(*) AS action_count, min(CAST(ts AS DATE)) AS first_day, min(CASE WHEN t = 'view' THEN i END) AS first_touch, min(ei) AS first_edit, count(DISTINCT CASE WHEN t = 'click' AND (ei IS NULL OR i <= ei) THEN props END) AS reads_before_edit,
  bool_or(t = 'signup') AS has_run, bool_or(t = 'error') AS has_commit FROM e GROUP BY source, session_id)"""


@query(f"WITH {ACTIONS} SELECT source, session_id, action_count, first_day, first_touch, first_edit, first_edit - 1 AS before_edit, coalesce(first_touch <= 3, false) AS touched_early, has_run, has_commit FROM s")
def session_first_index(spark, sf_dir):
    return sessions.fold(event_actions(spark, sf_dir)).select("source", "session_id", "action_count", "first_day", "first_touch", "first_edit", "before_edit", "touched_early", "has_run", "has_commit")


@query(f"WITH {ACTIONS} SELECT session_id, reads_before_edit FROM s WHERE first_edit IS NOT NULL")
def session_reads_before_edit(spark, sf_dir):
    return sessions.fold(event_actions(spark, sf_dir)).filter("first_edit is not null").select("session_id", "reads_before_edit")


_EARLY = "coalesce(first_touch <= 3, false)"


@query(f"""WITH {ACTIONS} SELECT {_EARLY} AS early, count(*) AS sessions, median(first_edit - 1) AS median_before_edit, median(reads_before_edit) AS median_reads, count(*) FILTER (WHERE has_commit) * 100.0 / count(*) AS commit_pct
FROM s WHERE first_edit IS NOT NULL GROUP BY 1""")
def session_medians_by_early(spark, sf_dir):
    s = sessions.fold(event_actions(spark, sf_dir)).filter("first_edit is not null")
    return s.groupBy(F.col("touched_early").alias("early")).agg(
        F.count("*").alias("sessions"), F.median("before_edit").alias("median_before_edit"), F.median("reads_before_edit").alias("median_reads"), sessions.pct(F.count_if("has_commit"), F.count("*")).alias("commit_pct"))


def _median(name, value, known="true"):
    out = []
    for tail, cond in (("", "true"), ("_early", _EARLY), ("_not_early", f"NOT {_EARLY}")):
        out.append(f"CASE WHEN {known} THEN median({value}) FILTER (WHERE first_edit IS NOT NULL AND {cond}) END AS median_{name}{tail}")
    return ", ".join(out)


@query(f"""WITH {ACTIONS} SELECT source, count(*) AS sessions, count(*) FILTER (WHERE first_touch IS NOT NULL) AS touching, count(*) FILTER (WHERE {_EARLY}) AS touching_early, count(*) FILTER (WHERE first_edit IS NOT NULL) AS with_edit,
  count(*) FILTER (WHERE has_run) AS with_run, count(*) FILTER (WHERE has_commit) AS with_commit, {_median("before_edit", "first_edit - 1")}, {_median("reads", "reads_before_edit", "source = 'b'")},
  count(*) FILTER (WHERE first_touch IS NOT NULL) * 100.0 / count(*) AS touching_pct, count(*) FILTER (WHERE {_EARLY}) * 100.0 / count(*) AS touching_early_pct FROM s GROUP BY GROUPING SETS ((source), ())""")
def session_grains(spark, sf_dir):
    return sessions.report(sessions.fold(event_actions(spark, sf_dir)))


@query("""SELECT user_id, count(*) AS actions FROM events, (SELECT min(CAST(ts AS DATE)) + 2 AS a, min(CAST(ts AS DATE)) + 9 AS z FROM events) w WHERE CAST(ts AS DATE) BETWEEN a AND z GROUP BY user_id""")
def session_window(spark, sf_dir):
    acts = event_actions(spark, sf_dir).withColumn("day", sessions.day_of(F.col("ts").cast("string")))
    low = acts.agg(F.date_add(F.min("day"), 2).cast("string").alias("a"), F.date_add(F.min("day"), 9).cast("string").alias("z")).first()
    return acts.filter(sessions.in_window(F.col("day"), low["a"], low["z"])).groupBy("user_id").agg(F.count("*").alias("actions"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 OR coalesce(props, '') = ''""")
def tool_dedupe(spark, sf_dir):
    return sessions.first_of_id(event_actions(spark, sf_dir), "props").select("event_id", "user_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_props(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").filter(v.isNotNull()).select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query(r"""WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, regexp_matches(text, '\b[Tt]he\b') AS touch, role = 'assistant' AS edit, CASE WHEN role = 'user' THEN regexp_extract(text, '^(\S+)', 1) END AS r FROM conversations),
e AS (SELECT *, min(CASE WHEN edit THEN i END) OVER (PARTITION BY conv_id) AS ei FROM a)
SELECT conv_id, count(*) AS action_count, min(CASE WHEN touch THEN i END) AS first_touch, min(ei) AS first_edit, count(DISTINCT CASE WHEN ei IS NULL OR i <= ei THEN r END) AS reads_before_edit FROM e GROUP BY conv_id""")
def conversation_actions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    acts = c.select(
        F.lit("b").alias("source"), F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), F.lit(None).cast("date").alias("day"), F.col("text").rlike(r"\b[Tt]he\b").alias("touch"), (F.col("role") == "assistant").alias("edit"),
        F.when(F.col("role") == "user", F.regexp_extract("text", r"^(\S+)", 1)).alias("read_path"), F.lit(False).alias("run"), F.lit(False).alias("commit"),
    )
    return sessions.fold(acts).select(F.col("session_id").alias("conv_id"), "action_count", "first_touch", "first_edit", "reads_before_edit")


_LABELS = """l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, CASE doc_id % 3 WHEN 0 THEN 's' || doc_id WHEN 1 THEN 'f' || doc_id ELSE '/logs/f' || doc_id || '.jsonl' END AS key, quality = 1 AS success FROM labels),
d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, 's' || doc_id AS session_id, 'f' || doc_id AS stem, '/logs/f' || doc_id || '.jsonl' AS path, doc_id % 4 < 2 AS touched FROM documents),
m AS (SELECT d.source, d.session_id, touched, coalesce(x.success, y.success, z.success) AS success FROM d LEFT JOIN l x ON x.source = d.source AND x.key = d.session_id LEFT JOIN l y ON y.source = d.source AND y.key = stem LEFT JOIN l z ON z.source = d.source AND z.key = path
  WHERE coalesce(x.success, y.success, z.success) IS NOT NULL)"""


def _matched(spark, sf_dir):
    side, i = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("doc_id").cast("string")
    path = F.concat(F.lit("/logs/f"), i, F.lit(".jsonl"))
    s = table(spark, sf_dir, "documents").select(side, F.concat(F.lit("s"), i).alias("session_id"), path.alias("session_file"), (F.col("doc_id") % 4 < 2).alias("touched"))
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s"), i)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("f"), i)).otherwise(path)
    lab = table(spark, sf_dir, "labels").select(side, key.alias("session_id"), (F.col("quality") == 1).alias("success"))
    return sessions.labelled(s, lab)


@query(f"WITH {_LABELS} SELECT source, session_id, touched, success FROM m")
def label_join(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f"""WITH {_LABELS} SELECT count(*) AS labelled_sessions, count(*) FILTER (WHERE touched) AS touching, count(*) FILTER (WHERE NOT touched) AS not_touching,
  count(*) FILTER (WHERE touched AND success) * 100.0 / count(*) FILTER (WHERE touched) AS success_rate_touching, count(*) FILTER (WHERE NOT touched AND success) * 100.0 / count(*) FILTER (WHERE NOT touched) AS success_rate_not_touching FROM m""")
def success_rate(spark, sf_dir):
    return sessions.success_rates(_matched(spark, sf_dir))


@query("""WITH r AS (SELECT CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE ' A ' END AS source, CAST(doc_id % 50 AS VARCHAR) || ' ' AS session_id, (['1', 'TRUE ', 'yes', '0', 'False', ' no', 'maybe', ''])[1 + doc_id % 8] AS success, doc_id AS line_no FROM labels),
u AS (SELECT lower(trim(source)) AS source, trim(session_id) AS session_id, CASE WHEN lower(trim(success)) IN ('1', 'true', 'yes') THEN true WHEN lower(trim(success)) IN ('0', 'false', 'no') THEN false END AS success, line_no FROM r)
SELECT source, session_id, arg_max(success, line_no) AS success FROM u WHERE source <> '' AND session_id <> '' AND success IS NOT NULL GROUP BY source, session_id""")
def csv_label_normalise(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("1", "TRUE ", "yes", "0", "False", " no", "maybe", "")]), (F.col("doc_id") % 8).cast("int"))
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 13 == 0, " ").otherwise(" A ").alias("source"), F.concat((F.col("doc_id") % 50).cast("string"), F.lit(" ")).alias("session_id"), raw.alias("success"), F.col("doc_id").alias("line_no"))
    return sessions.clean_labels(rows)


# --- events as benchmark history

HISTORY = """h AS (SELECT 'BenchAtlas' || (['', 'Python', 'Rust', 'Shell', 'TypeScript'])[1 + user_id % 5] || (['StaleWarm', 'EnsureWarm', 'EnsureChange'])[1 + (user_id // 5) % 3] AS benchmark, CAST(ts AS DATE) AS sample, event_id AS line_no,
  CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS ns_per_op, user_id AS bytes_per_op, event_id % 7 AS allocs_per_op FROM events)"""


def history(spark, sf_dir) -> DataFrame:
    i = F.col("user_id").cast("int")
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k)
    name = F.concat(F.lit("BenchAtlas"), at(["", "Python", "Rust", "Shell", "TypeScript"], i % 5), at(["StaleWarm", "EnsureWarm", "EnsureChange"], F.floor(i / 5).cast("int") % 3))
    return table(spark, sf_dir, "events").select(
        name.alias("benchmark"), F.to_date("ts").alias("sample"), F.col("event_id").alias("line_no"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint").alias("ns_per_op"), F.col("user_id").alias("bytes_per_op"), (F.col("event_id") % 7).alias("allocs_per_op"))


_LATEST = """r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY line_no DESC) AS n FROM {t}),
b AS (SELECT benchmark, max(CASE WHEN n = 1 THEN ns_per_op END) AS latest_ns, max(CASE WHEN n = 2 THEN ns_per_op END) AS prev_ns, max(CASE WHEN n = 1 THEN bytes_per_op END) AS latest_bytes, max(CASE WHEN n = 1 THEN allocs_per_op END) AS latest_allocs FROM r WHERE n <= 2 GROUP BY benchmark)"""
_DELTA = "CASE WHEN prev_ns IS NULL OR prev_ns <= 0 THEN 'n/a' ELSE printf('%+.2f%%', (latest_ns - prev_ns) / CAST(prev_ns AS DOUBLE) * 100.0) END AS delta"


@query(f"WITH {HISTORY}, {_LATEST.format(t='h')} SELECT benchmark, latest_ns, prev_ns, latest_bytes, latest_allocs FROM b")
def bench_latest_prev(spark, sf_dir):
    return benchmarks.latest_previous(history(spark, sf_dir)).drop("delta")


@query(f"WITH {HISTORY}, q AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY benchmark, sample ORDER BY line_no DESC) = 1), {_LATEST.format(t='q')} SELECT benchmark, latest_ns, prev_ns, {_DELTA} FROM b")
def bench_delta(spark, sf_dir):
    return benchmarks.latest_previous(history(spark, sf_dir), "sample").select("benchmark", "latest_ns", "prev_ns", "delta")


_NS = ", ".join(f"max(CASE WHEN g = '{g}' THEN latest_ns END) AS {g.lower()}_ns" for g in benchmarks.GROUPS)
_RATIO = ", ".join(f"CASE WHEN {g.lower()}_ns IS NULL OR go_ns IS NULL OR go_ns <= 0 THEN 'n/a' ELSE printf('%.2fx', {g.lower()}_ns / CAST(go_ns AS DOUBLE)) END AS {g.lower()}_ratio" for g in benchmarks.GROUPS[1:])


@query(f"""WITH {HISTORY}, {_LATEST.format(t='h')}, x AS (SELECT CASE WHEN regexp_extract(benchmark, '^BenchAtlas(Python|Rust|Shell|TypeScript)', 1) = '' THEN 'Go' ELSE regexp_extract(benchmark, '^BenchAtlas(Python|Rust|Shell|TypeScript)', 1) END AS g,
  regexp_replace(benchmark, '^BenchAtlas(Python|Rust|Shell|TypeScript)?', '') AS scenario, latest_ns FROM b), w AS (SELECT scenario, {_NS} FROM x GROUP BY scenario) SELECT *, {_RATIO} FROM w""")
def bench_pivot_ratio(spark, sf_dir):
    return benchmarks.by_group(benchmarks.latest_previous(history(spark, sf_dir)), "BenchAtlas")


@query(f"WITH {HISTORY} SELECT line_no, benchmark, row_number() OVER (PARTITION BY sample, benchmark ORDER BY line_no) AS run FROM h")
def run_index(spark, sf_dir):
    return benchmarks.run_numbers(history(spark, sf_dir)).select("line_no", "benchmark", "run")


@query(f"""WITH {HISTORY} SELECT line_no, benchmark, CAST(ns_per_op AS VARCHAR) AS ns_per_op, CASE WHEN line_no % 3 = 0 THEN '0' ELSE CAST(bytes_per_op AS VARCHAR) END AS bytes_per_op FROM h WHERE line_no % 5 <> 0""")
def bench_text_parse(spark, sf_dir):
    h = history(spark, sf_dir)
    bytes_ = F.when(F.col("line_no") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("bytes_per_op").cast("string"), F.lit(" B/op")))
    line = F.concat("benchmark", F.lit("-8  "), F.when(F.col("line_no") % 5 == 0, "bad").otherwise("406"), F.lit("\t"), F.col("ns_per_op").cast("string"), F.lit(" ns/op "), bytes_)
    return benchmarks.parse(h.select("line_no", "sample", line.alias("line")), "BenchAtlas").select("line_no", "benchmark", "ns_per_op", "bytes_per_op")
