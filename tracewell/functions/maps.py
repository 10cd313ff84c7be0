"""Maps of files and their signatures that fit a budget of bytes. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def budgeted_map(files: Column, budget: int | Column) -> Column:
    """Struct of ``text``, ``n_bytes``, ``tokens_estimate``, ``files``, ``candidates`` and ``cut`` for files in their order.

    ``files`` is an array of structs of path and signatures. A file is a line of its path and an indented line for each signature. As
    many lines of a file are taken as fit, a file that was cut short may be followed by one that still fits, and the first path that does not
    fit ends the map. Null paths and signatures count as empty, a null array or file as none. A path takes 2 bytes and a signature 3
    at least, so what lies further back than the budget allows is never looked at.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    budget = F.greatest(budget, F.lit(0)).cast("long")
    all_files = F.coalesce(F.filter(files, lambda f: f.isNotNull()), F.array().cast("array<struct<path:string,signatures:array<string>>>"))
    first = lambda a, least: F.slice(a, F.lit(1), (F.floor(budget / least) + 1).cast("int"))
    text = lambda c: F.coalesce(c, F.lit(""))
    lines = lambda f: F.concat(F.array(F.concat(text(f["path"]), F.lit(":\n"))), F.transform(F.coalesce(first(f["signatures"], 3), F.array().cast("array<string>")), lambda s: F.concat(F.lit("  "), text(s), F.lit("\n"))))
    blocks = F.transform(first(all_files, 2), lines)
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("takes"), F.lit(False).alias("cut"), F.lit(False).alias("over"))

    def taken(block: Column, used: Column) -> Column:
        """(bytes, lines) of a block that fit behind ``used`` bytes."""
        start = F.struct(used.alias("used"), F.lit(0).alias("n"), F.lit(True).alias("fits"))
        size = lambda line: F.octet_length(line).cast("long")
        return F.aggregate(block, start, lambda a, line: F.when(a["fits"] & (a["used"] + size(line) <= budget), F.struct((a["used"] + size(line)).alias("used"), (a["n"] + 1).alias("n"), F.lit(True).alias("fits"))).otherwise(F.struct(a["used"].alias("used"), a["n"].alias("n"), F.lit(False).alias("fits"))))

    def step(a: Column, block: Column) -> Column:
        t = taken(block, a["used"])
        more = F.transform(F.array(t), lambda t: F.struct(t["used"].alias("used"), F.when(t["n"] > 0, F.concat(a["takes"], F.array(t["n"]))).otherwise(a["takes"]).alias("takes"), (a["cut"] | ~t["fits"]).alias("cut"), (t["n"] == 0).alias("over")))
        return F.when(a["over"], a).otherwise(F.get(more, F.lit(0)))

    done = F.aggregate(blocks, zero, step)
    shown = lambda d: F.array_join(F.flatten(F.zip_with(F.slice(blocks, F.lit(1), F.size(d["takes"])), d["takes"], lambda b, n: F.slice(b, F.lit(1), n))), "")
    out = lambda d: F.struct(shown(d).alias("text"), d["used"].alias("n_bytes"), F.ceil(d["used"] / 4).cast("long").alias("tokens_estimate"), F.size(d["takes"]).cast("long").alias("files"), F.size(all_files).cast("long").alias("candidates"), d["cut"].alias("cut"))
    return F.get(F.transform(F.array(done), out), F.lit(0))
