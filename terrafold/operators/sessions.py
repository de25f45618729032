"""Session metrics from streams of actions.

An action has source, session_id, ord (sorts a session's actions), day, touch (refers to the watched artifact),
edit, read_path, run (runs the tool) and commit.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARLY = 3


def in_window(day, since: str | None, until: str | None):
    """Day within both bounds, each inclusive and optional; a null day isn't."""
    ok = day.isNotNull()
    if since:
        ok = ok & (day >= F.lit(since).cast("date"))
    if until:
        ok = ok & (day <= F.lit(until).cast("date"))
    return ok


def day_of(ts):
    """The date that a text begins with; null if it doesn't."""
    return F.try_to_date(F.substring(ts, 1, 10), "yyyy-MM-dd")


def first_of_id(actions: DataFrame, id_col: str) -> DataFrame:
    """The first action of each id in a session; actions without an id all stay."""
    w = Window.partitionBy("source", "session_id", id_col).orderBy("ord")
    has_id = F.coalesce(F.col(id_col), F.lit("")) != ""
    return actions.withColumn("rn", F.row_number().over(w)).filter(~has_id | (F.col("rn") == 1)).drop("rn")


def numbered(actions: DataFrame) -> DataFrame:
    """With i, the number of the action in its session from 1."""
    return actions.withColumn("i", F.row_number().over(Window.partitionBy("source", "session_id").orderBy("ord")).cast("bigint"))


def fold(actions: DataFrame) -> DataFrame:
    """A row for each session: counts, first places, distinct reads before the first edit, flags."""
    w = Window.partitionBy("source", "session_id")
    n = numbered(actions).withColumn("edit_i", F.min(F.when(F.col("edit"), F.col("i"))).over(w))
    s = n.groupBy("source", "session_id").agg(
        F.count("*").alias("action_count"),
        F.min("day").alias("first_day"),
        F.min(F.when(F.col("touch"), F.col("i"))).alias("first_touch"),
        F.first("edit_i").alias("first_edit"),
        F.count_distinct(F.when(F.col("edit_i").isNull() | (F.col("i") <= F.col("edit_i")), F.col("read_path"))).alias("reads_before_edit"),
        F.bool_or("run").alias("has_run"),
        F.bool_or("commit").alias("has_commit"),
    )
    return s.withColumns({"touched": F.col("first_touch").isNotNull(), "touched_early": F.coalesce(F.col("first_touch") <= EARLY, F.lit(False)), "before_edit": F.col("first_edit") - 1})


def pct(num, den):
    return F.when(den != 0, num * 100.0 / den)


def summary(with_reads: bool = True):
    """Aggregates over sessions: counts, and medians over those with an edit."""
    edited, early = F.col("first_edit").isNotNull(), F.col("touched_early")

    def medians(name, value):
        return [F.median(F.when(edited & cond, value)).alias(f"median_{name}{tail}") for tail, cond in (("", F.lit(True)), ("_early", early), ("_not_early", ~early))]

    reads = F.col("reads_before_edit") if with_reads else F.lit(None).cast("bigint")
    counts = {"sessions": F.lit(True), "touching": F.col("touched"), "touching_early": early, "with_edit": edited, "with_run": F.col("has_run"), "with_commit": F.col("has_commit")}
    return [F.count_if(c).alias(k) for k, c in counts.items()] + medians("before_edit", F.col("before_edit")) + medians("reads", reads)


def report(sessions: DataFrame, read_sources: tuple[str, ...] = ("b",)) -> DataFrame:
    """A row for each source and one for all (source null); the medians of reads only for sources that log reads."""
    base = sessions.groupingSets([["source"], []], "source").agg(*summary())
    known = F.col("source").isin(*read_sources)
    out = base.withColumns({c: F.when(known, F.col(c)) for c in base.columns if c.startswith("median_reads")})
    return out.withColumns({"touching_pct": pct(F.col("touching"), F.col("sessions")), "touching_early_pct": pct(F.col("touching_early"), F.col("sessions"))})


def clean_labels(rows: DataFrame) -> DataFrame:
    """(source, session_id, success) from text columns of those names and line_no: unusable rows go, the last row of a key wins."""
    source, sid, raw = F.lower(F.trim("source")), F.trim("session_id"), F.lower(F.trim("success"))
    ok = F.when(raw.isin("1", "true", "yes"), True).when(raw.isin("0", "false", "no"), False)
    usable = rows.select(source.alias("source"), sid.alias("session_id"), ok.alias("success"), "line_no").filter("source <> '' and session_id <> '' and success is not null")
    return usable.groupBy("source", "session_id").agg(F.max_by("success", "line_no").alias("success"))


def labelled(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """sessions (with session_file) that a label fits, by id, else the file's stem, else its path."""
    stem = F.regexp_replace(F.substring_index("session_file", "/", -1), r"^([\x00-\x{10FFFF}]+)\.[^.]*$", "$1")
    keys = F.array(*[F.struct(F.lit(k).alias("prio"), c.alias("key")) for k, c in enumerate((F.col("session_id"), stem, F.col("session_file")))])
    tried = sessions.withColumn("try", F.explode(keys))
    lab = labels.select(F.col("source").alias("ls"), F.col("session_id").alias("lk"), "success")
    j = tried.join(lab, (F.col("source") == F.col("ls")) & (F.col("try.key") == F.col("lk")))
    return j.groupBy("source", "session_id", "touched").agg(F.min_by("success", "try.prio").alias("success"))


def success_rates(matched: DataFrame) -> DataFrame:
    t = F.col("touched")
    return matched.agg(
        F.count("*").alias("labelled_sessions"),
        F.count_if(t).alias("touching"),
        F.count_if(~t).alias("not_touching"),
        pct(F.count_if(t & F.col("success")), F.count_if(t)).alias("success_rate_touching"),
        pct(F.count_if(~t & F.col("success")), F.count_if(~t)).alias("success_rate_not_touching"),
    )
