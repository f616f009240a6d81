"""Rename plans: targets from a template, collisions, existing files; for local and remote listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.operators.ordering import global_rank
from fotolake.plans import template as t
from fotolake.runtime import skew_join

OK, ERROR, COLLISION, EXISTS, DONE, FAILED = "ok", "error", "collision", "exists", "done", "failed"


def plan(files: DataFrame, template: str, *, append_ext: bool = True, output_root: str = "", existing: DataFrame | None = None) -> DataFrame:
    """files(path, name, ext, parent, size, ...) to n, src, rel_target, status, detail.

    `{n}` counts files in path order. A row is an error if a field has no value, else a collision
    if another row renders the same target, else `exists` if the target stands in
    `existing(path)` and is no file of the plan, else ok.
    """
    tokens = t.parse(template)
    numbered = global_rank(files, [m.path_order()], "n")
    text, error = t.render(tokens, files.columns)
    rows = numbered.select("n", F.col("path").alias("src"), "ext", text.alias("_t"), error.alias("_e"))
    if append_ext:
        suffix = F.concat(F.lit("."), F.lower("ext"))
        add = (F.col("ext") != "") & ~F.endswith(F.lower("_t"), suffix)
        rows = rows.withColumn("_t", F.when(add, F.concat("_t", F.lit("."), "ext")).otherwise(F.col("_t")))
    rows = rows.select("n", "src", F.when(F.col("_e").isNull(), F.col("_t")).otherwise("").alias("rel_target"), F.col("_e").alias("detail"))
    # counted per target first: a template without fields gives all rows one target
    twice = rows.where("detail is null").groupBy("rel_target").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("rel_target", F.lit(True).alias("_twice"))
    rows = skew_join(rows, twice, "rel_target", "left")
    prefix = output_root.rstrip("/") + "/" if output_root else ""
    rows = rows.withColumn("_abs", F.concat(F.lit(prefix), "rel_target"))
    if existing is not None:
        blocked = existing.select(F.col("path").alias("_abs")).distinct().join(files.select(F.col("path").alias("_abs")), "_abs", "left_anti")
        rows = skew_join(rows, blocked.withColumn("_there", F.lit(True)), "_abs", "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("boolean"))
    status = F.when(F.col("detail").isNotNull(), ERROR).when(F.col("_twice"), COLLISION).when(F.col("_there"), EXISTS).otherwise(OK)
    return rows.select("n", "src", "rel_target", status.alias("status"), "detail")


def counts(planned: DataFrame) -> DataFrame:
    """ok and problem counts; rows done are neither."""
    return planned.agg(F.count(F.when(F.col("status") == OK, 1)).alias("ok"), F.count(F.when(~F.col("status").isin(OK, DONE), 1)).alias("problems"))


def display(planned: DataFrame) -> DataFrame:
    return planned.select(m.file_name("src").alias("name"), "rel_target", "status")


def labelled(planned: DataFrame) -> DataFrame:
    """The plan with a word for each status, and the reason of an error."""
    text = F.when(F.col("status") == ERROR, F.concat(F.lit("error: "), "detail")).otherwise(F.col("status"))
    return planned.select("src", "rel_target", text.alias("label"))


def undo_order(moves: DataFrame) -> DataFrame:
    """Moves back, last first: of `moves(seq, src, dst)` step, src (where the file is now), dst (where it was)."""
    return global_rank(moves, [F.col("seq").desc()], "step").select("step", F.col("dst").alias("src"), F.col("src").alias("dst"))


def emptied_folders(moves: DataFrame) -> DataFrame:
    """Folders that may be empty once `moves(dst)` are undone, deepest first (then by name): step, folder."""
    folder = F.expr("left(dst, char_length(dst) - char_length(substring_index(dst, '/', -1)) - 1)")
    folders = moves.select(folder.alias("folder")).where("folder <> ''").distinct()
    return global_rank(folders, [F.size(F.split("folder", "/")).desc(), F.col("folder")], "step").select("step", "folder")


def remote_plan(files: DataFrame, template: str, *, append_ext: bool = True) -> DataFrame:
    """Plan for a flattened remote listing (see sources.remote); existing targets are not asked for."""
    return plan(files, template, append_ext=append_ext)


def moves(planned: DataFrame, output_root: str) -> DataFrame:
    """src and dst of the rows that can go ahead."""
    root = output_root.rstrip("/") + "/"
    return planned.where(F.col("status") == OK).select("src", F.concat(F.lit(root), "rel_target").alias("dst"))


def removal_plan(selection: DataFrame, vault: str, batch: int, existing: DataFrame) -> DataFrame:
    """Where files taken away go: their absolute path mirrored below `vault/batch-NNNN`, never onto another file."""
    from fotolake.operators.catalog import unique_targets

    root = f"{vault.rstrip('/')}/batch-{batch:04d}/"
    rows = selection.select("path", F.concat(F.lit(root), F.regexp_replace("path", "^/+", "")).alias("target"))
    return unique_targets(rows, "target", existing).select("path", "dest")
