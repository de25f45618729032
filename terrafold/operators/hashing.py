"""Hashes over ordered lists of files."""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def walk_key(path: Column) -> Column:
    """Sorts paths as a depth-first walk by name meets them: foo/x.go before foo.go."""
    return F.split(path, "/")


def _digest(rows: Column) -> Column:
    pairs = F.transform(rows, lambda r: F.concat(r["p"], F.lit("\0"), r["h"], F.lit("\0")))
    return F.sha2(F.array_join(pairs, ""), 256)


def _streamed(batches, names: list[str], schema: pa.Schema):
    """A digest of each run of rows (p, h, by...) that agree in `by`."""
    now, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([*[pa.array([v], schema.field(n).type) for n, v in zip(names, now)], pa.array([digest.hexdigest()])], [*names, "aggregate_hash"])

    for batch in batches:
        path, content, *by = [c.to_pylist() for c in batch.columns]
        for k, (p, h) in enumerate(zip(path, content)):
            key = tuple(c[k] for c in by)
            if digest is None or key != now:
                if digest is not None:
                    yield row()
                now, digest = key, hashlib.sha256()
            if p is not None and h is not None:
                digest.update(f"{p}\0{h}\0".encode())
    if digest is not None:
        yield row()


def aggregate_hash(files: DataFrame, *by: str) -> DataFrame:
    """(by..., aggregate_hash): SHA-256 over `path NUL hash NUL` of all files in walk order, from rel_path and content_hash.

    The digest goes on from file to file, so each group is one task's, which reads its sorted rows as a stream and holds
    none. Rows with a null path or hash don't count; an empty table gives no row.
    """
    parted = files.repartition(*by) if by else files.repartition(1)
    ordered = parted.select(F.col("rel_path").alias("p"), F.col("content_hash").alias("h"), *by, walk_key(F.col("rel_path")).alias("k")).sortWithinPartitions(*by, "k").drop("k")
    out = files.select(*by).schema.add("aggregate_hash", "string")
    arrow = to_arrow_schema(out)
    return ordered.mapInArrow(lambda it: _streamed(it, list(by), arrow), out)


def fingerprint() -> Column:
    """Aggregate: the same over a package's files in string order; empty if any file lacks its hash. A package is a directory or so: its files' hashes fit in a row."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rel_path").alias("p"), F.coalesce("content_hash", F.lit("")).alias("h"))))
    return F.when(F.bool_or(F.coalesce("content_hash", F.lit("")) == ""), "").otherwise(_digest(rows))
