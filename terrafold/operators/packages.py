"""Files to packages: plans, reuse, rollup, concerns, nearest manifests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.globs import any_of
from terrafold.functions.textops import dirname
from terrafold.operators.hashing import fingerprint


def plans(files: DataFrame) -> DataFrame:
    """(language, pkg_root, fingerprint, file_rel_paths) from language, pkg_root, rel_path, content_hash."""
    return files.groupBy("language", "pkg_root").agg(fingerprint().alias("fingerprint"), F.sort_array(F.collect_list("rel_path")).alias("file_rel_paths"))


def _same_plan(plan: DataFrame, cache: DataFrame):
    return [plan["language"] == cache["language"], plan["pkg_root"] == cache["pkg_root"], plan["fingerprint"] == cache["fingerprint"], plan["fingerprint"] != ""]


def stale_plans(plan: DataFrame, cache: DataFrame) -> DataFrame:
    """Plans that the cache has no package of the same, known fingerprint for."""
    return plan.join(cache, _same_plan(plan, cache), "left_anti")


def reused_plans(plan: DataFrame, cache: DataFrame) -> DataFrame:
    return plan.join(cache, _same_plan(plan, cache), "left_semi")


def rollup(files: DataFrame, large: int = 10) -> DataFrame:
    """A row for each (language, pkg_root) from one row for each file.

    files: language, pkg_root, name (inside the package), line_count, purpose, types array<struct<name,kind,comment>>,
    key_types, key_funcs, imports, score, doc_file (its purpose goes before all others). The first purpose in order of name, the entry of
    the highest score (of equal ones the first name), types by name except for Go, where they stay in order.
    """
    order = F.struct((~F.col("doc_file")).alias("d"), F.col("name"))
    types = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", "types"))), lambda s: s["types"]))
    imports = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", "imports"))), lambda s: s["imports"]))
    detail = F.array_sort(F.collect_list(F.struct("name", "line_count", "purpose", "key_types", "key_funcs")))
    out = files.groupBy("language", "pkg_root").agg(
        F.count("*").alias("file_count"),
        F.sum("line_count").cast("bigint").alias("line_count"),
        F.coalesce(F.min_by("purpose", F.when(F.col("purpose") != "", order)), F.lit("")).alias("purpose"),
        F.min_by("name", F.struct((-F.col("score")).alias("s"), F.col("name"))).alias("entry_point"),
        types.alias("types"),
        F.array_distinct(imports).alias("found"),
        F.when(F.count("*") >= large, detail).alias("files"),
    )
    go = F.col("language") == "go"
    return out.withColumns({"exported_types": F.when(go, F.col("types")).otherwise(F.array_sort("types")), "imports": F.when(go, F.col("found")).otherwise(F.sort_array("found"))}).drop("types", "found")


def concerns(files: DataFrame, defs: list[tuple[str, list[str]]], examples: int = 0) -> DataFrame:
    """(place, concern, total_files, files) of the concerns that any rel_path meets,; place is the number in defs.

    Each concern's patterns are one expression, so there is no join; files holds the first `examples` paths.
    """
    known = [(k, name, rx) for k, (name, patterns) in enumerate(defs) if (rx := any_of(patterns))]
    if not known:
        return files.sparkSession.createDataFrame([], "place bigint, concern string, total_files bigint, files array<string>")
    met = F.array_compact(F.array(*[F.when(F.col("rel_path").rlike(rx), F.struct(F.lit(k).cast("bigint").alias("place"), F.lit(name).alias("concern"))) for k, name, rx in known]))
    hits = files.select("rel_path").distinct().select("rel_path", F.explode(met).alias("c"))
    hits = hits.select("c.place", "c.concern", "rel_path")
    counts = hits.groupBy("place", "concern").agg(F.count("*").alias("total_files"))
    if not examples:
        return counts.withColumn("files", F.lit(None).cast("array<string>"))
    # a window whose rank is limited drops rows before they are exchanged
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("place", "concern").orderBy("rel_path"))).filter(F.col("rank") <= examples)
    some = first.groupBy("place", "concern").agg(F.sort_array(F.collect_list("rel_path")).alias("files"))
    return counts.join(some, ["place", "concern"])


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose path meets one pattern; an unsupported one is an error."""
    rx = any_of([pattern])
    if rx is None:
        raise ValueError(f"unsupported pattern: {pattern}")
    return files.filter(F.col("rel_path").rlike(rx))


def nearest_ancestor(dirs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(dir, root): of each distinct dir the nearest one at or above it that is in manifests(dir), `.` if none is.

    Each dir is expanded into its ancestors, which meet the manifests in an equi-join.
    """
    one = dirs.select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.when(F.col("dir") == ".", F.array(F.struct(F.lit(".").alias("a"), F.lit(0).alias("n")))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("a"), n.alias("n"))), F.array(F.struct(F.lit(".").alias("a"), F.lit(0).alias("n"))))
    )
    expanded = one.select("dir", F.explode(up).alias("u")).select("dir", F.col("u.a").alias("a"), F.col("u.n").alias("n"))
    found = expanded.join(manifests.select(F.col("dir").alias("a")).distinct(), "a").groupBy("dir").agg(F.max_by("a", "n").alias("root"))
    return one.join(found, "dir", "left").select("dir", F.coalesce("root", F.lit(".")).alias("root"))


def file_dirs(files: DataFrame) -> DataFrame:
    return files.select(dirname(F.col("rel_path")).alias("dir"))


def dominant_language(files: DataFrame, fallback: str) -> DataFrame:
    """One row (language): the most frequent one, of equal ones the first; the fallback if no file has one."""
    counts = files.filter(F.col("language") != "").groupBy("language").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.min_by("language", F.struct((-F.col("n")).alias("n"), F.col("language"))), F.lit(fallback)).alias("language"))


def sorted_packages(packages: DataFrame) -> DataFrame:
    return packages.orderBy("relative_path", "import_path", "entry_point", "purpose")
