"""The module graph: the names by which a file can be imported, and what an imported name stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def module_paths(files: DataFrame) -> DataFrame:
    """(file_path, module) for each name of each file (file_path): the path itself and, by its extension, what
    its language's imports say; a leading "src/" and the names of folder files (__init__, index, mod) fall away."""
    path = F.col("file_path")
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    bare = F.regexp_replace(path, "^src/", "")
    stem = F.regexp_replace(bare, r"\.[^./]+$", "")
    home = lambda word: F.regexp_replace(stem, f"/{word}$", "")
    python, script, rust = home("__init__"), home("index"), home("mod")
    names = F.when(ext == "py", F.array(F.replace(python, F.lit("/"), F.lit(".")), python, bare))
    names = names.when(ext.isin("ts", "tsx", "js", "jsx"), F.array(F.concat(F.lit("./"), script), script, bare))
    names = names.when(ext == "rs", F.array(rust, F.concat(F.lit("crate::"), F.replace(rust, F.lit("/"), F.lit("::")))))
    return files.select("file_path").distinct().select("file_path", F.explode(F.array_distinct(F.concat(F.array(path), names.otherwise(F.array(stem))))).alias("module"))


def exported(symbols: DataFrame) -> DataFrame:
    """(module, name, uid): the last symbol (by file, line, uid) that a module's name and a symbol's lead to."""
    rows = module_paths(symbols).join(symbols.select("file_path", "name", "start_line", "uid"), "file_path")
    return rows.groupBy("module", "name").agg(F.max(F.struct("file_path", "start_line", "uid")).alias("x")).select("module", "name", F.col("x.uid").alias("uid"))


def resolved_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, module, name, local, uid) of imports (file_path, module, name, alias): local is the name that the
    file uses. A module is looked up as it stands, then with slashes, then with dots; uid is null if none has the name."""
    slashed = F.translate(F.regexp_replace("module", r"^\./", ""), ".", "/")
    forms = F.array_distinct(F.array("module", slashed, F.translate(slashed, "/", ".")))
    wanted = imports.select("file_path", "module", "name", F.coalesce("alias", "name").alias("local")).distinct()
    tried = wanted.select("module", "name").distinct().select(F.col("module").alias("asked"), "name", F.posexplode(forms).alias("place", "module"))
    found = tried.join(exported(symbols), ["module", "name"]).groupBy("asked", "name").agg(F.min_by("uid", "place").alias("uid"))
    return wanted.join(found.withColumnRenamed("asked", "module"), ["module", "name"], "left").select("file_path", "module", "name", "local", "uid")
