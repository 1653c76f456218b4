"""Areas of a tree of weighted files: folders that fit a budget, others cut into their loose files and folders (WIN10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.folds import pack_in_order


def areas(files: DataFrame, budget: int) -> DataFrame:
    """``repo, path, area``: the area of each of ``files(repo, path, lines)``, named by its first path (WIN10).

    Weights are rolled up to all folders at once. A folder within the budget whose parents all exceed it is one part of its parent; files of a
    folder that exceeds it are packed in path order within the budget, one larger than that by itself. Parts of one parent, by their first paths, are merged in
    order while they fit together and no folder that was cut lies between. No level waits for another: a file's part follows from the weights of
    its own folders. The two packings are folds over the parts of one folder, a few numbers each. Paths of a repository are different; null paths are left out.
    """
    f = files.where("path is not null").select("repo", "path", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("folder")))
    each = f.select("repo", "path", "lines", F.inline(above))
    weights = each.groupBy("repo", "folder").agg(F.sum("lines").alias("weight"), F.min("path").alias("first"))
    judged = each.join(weights, ["repo", "folder"])
    fits = F.col("weight") <= budget
    unit = judged.groupBy("repo", "path").agg(F.first("lines").alias("lines"), F.min(F.when(fits, F.struct("depth", "folder"))).alias("unit"), F.max(F.struct("depth", "folder"))["folder"].alias("own"))
    # loose files, packed within their folder
    loose = unit.where("unit is null").select("repo", F.col("own").alias("parent"), "path", "lines")
    packed = pack_in_order(loose.withColumn("_key", F.to_json(F.struct("repo", "parent"))), "_key", "path", "lines", budget)
    packs = packed.groupBy("repo", "parent", "pack_no").agg(F.min("path").alias("first"), F.sum("lines").alias("lines"))
    of_pack = packed.join(packs.select("repo", "parent", "pack_no", "first"), ["repo", "parent", "pack_no"]).select("repo", "path", "parent", "first")
    parent = F.when(F.col("unit.depth") > 0, F.regexp_replace("unit.folder", "/?[^/]*$", ""))
    whole = unit.where("unit is not null").select("repo", "path", F.col("unit.folder").alias("folder"), parent.alias("parent"))
    whole = whole.join(weights.select("repo", "folder", "weight", "first"), ["repo", "folder"])
    folders = whole.select("repo", "parent", "first", F.col("weight").alias("lines")).distinct()
    # folders that are cut stand between their siblings
    cut_ = weights.where((F.col("weight") > budget) & (F.col("folder") != "")).select("repo", F.regexp_replace("folder", "/?[^/]*$", "").alias("parent"), "first", F.lit(None).cast("long").alias("lines"))
    parts = packs.select("repo", "parent", "first", "lines").union(folders).union(cut_)
    order = Window.partitionBy("repo", "parent").orderBy("first", F.col("lines").isNotNull())
    runs = parts.withColumn("run", F.sum(F.when(F.col("lines").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("lines is not null")
    merged = pack_in_order(runs.withColumn("_key", F.to_json(F.struct("repo", "parent", "run"))), "_key", "first", "lines", budget)
    named = merged.groupBy("_key", "pack_no").agg(F.min("first").alias("area"))
    area = merged.join(named, ["_key", "pack_no"]).select("repo", F.coalesce("parent", F.lit("/")).alias("parent"), "first", "area")
    placed = of_pack.union(whole.select("repo", "path", "parent", "first")).withColumn("parent", F.coalesce("parent", F.lit("/")))
    return placed.join(area, ["repo", "parent", "first"]).select("repo", "path", "area")
