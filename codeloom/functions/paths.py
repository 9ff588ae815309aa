"""Module roots and package paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.spread import joined


def package_path(path: Column, modules: dict) -> Column:
    """The module of the longest root around a file, and the rest of its folder; the folder itself without one.

    modules is a project's handful of {root: module}; '.' or '' is the project's own root.
    """
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")
    out = folder
    for root, module in sorted(modules.items(), key=lambda x: len(x[0].strip("."))):
        root = root.strip("./")
        if root:
            out = F.when((folder == root) | folder.startswith(root + "/"), F.concat(F.lit(module), F.substring(folder, F.lit(len(root) + 1), F.length(folder)))).otherwise(out)
        else:
            out = F.when(folder == "", F.lit(module)).otherwise(F.concat(F.lit(module + "/"), folder))
    return out


def package_paths(files, roots):
    """path, package for files(path) and any number of roots(root, module): the module of the longest root around a file, and the rest of its folder.

    Every folder around a file is a row, and roots are met by an equi-join, so a plan doesn't grow with the number of roots; '' or '.' is the
    project's own root. A root around any share of the files meets them in many parts. Of a root that is named twice the least module counts. Without a root the package is the folder.
    """
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    files = files.select("path").distinct().select("path", folder.alias("folder"))
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    around = files.select("path", "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    own = roots.select(F.regexp_replace("root", r"^(\./|/)+|^\.$|/+$", "").alias("root"), "module").groupBy("root").agg(F.min("module").alias("module"))
    found = joined(around, own, ["root"], ["path"]).groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "module")).alias("m"))
    rest = F.substring("folder", F.when(F.col("m.n") > 0, F.col("m.n") + 2).otherwise(1), F.length("folder"))
    package = F.when(F.col("m").isNull(), F.col("folder")).when(rest == "", F.col("m.module")).otherwise(F.concat("m.module", F.lit("/"), rest))
    return files.join(found, "path", "left").select("path", package.alias("package"))
