"""Paths as arrays of their parts: made plain, compared, and told from one another's folder. Text alone; links on disks aren't followed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column, cwd: Column | str = "/") -> Column:
    """The parts of a path from the root: without ".", "..", and empty ones. One that doesn't begin at the root lies below cwd; above the root there is nothing."""
    below = F.lit(cwd) if isinstance(cwd, str) else cwd
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(below, F.lit("/"), path))

    def stepped(taken: Column, part: Column) -> Column:
        up = F.slice(taken, F.lit(1), F.greatest(F.size(taken) - 1, F.lit(0)))
        return F.when(part == "..", up).otherwise(F.concat(taken, F.array(part)))

    named = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    return F.when(whole.isNotNull(), F.aggregate(named, F.array().cast("array<string>"), stepped))


def plain(path: Column, cwd: Column | str = "/") -> Column:
    """The path from the root, each thing by one name."""
    return F.concat(F.lit("/"), F.array_join(parts(path, cwd), "/"))


def shared(a: Column, b: Column) -> Column:
    """How many parts two arrays of parts have in common from their beginning."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def tracked_reference(folder: Column, path: Column, cwd: Column | str = "/") -> Column:
    """path as seen from a folder: up to where they part, then down. Empty if they are one."""
    here, there = parts(folder, cwd), parts(path, cwd)
    common = shared(here, there)
    up = F.array_repeat(F.lit(".."), F.size(here) - common)
    return F.array_join(F.concat(up, F.slice(there, common + 1, F.size(there))), "/")


def manifest_reference(folder: Column, path: Column, cwd: Column | str = "/") -> Column:
    """path as seen from a folder if it lies in it, or in one that the folder lies in; else from the root."""
    here, there = parts(folder, cwd), parts(path, cwd)
    common, depth = shared(here, there), F.size(there)
    below = F.array_join(F.slice(there, F.size(here) + 1, depth), "/")
    # By the folder that holds it, even where the other folder lies below the path itself.
    above = F.concat(F.repeat(F.lit("../"), F.size(here) - depth + 1), F.try_element_at(there, F.lit(-1)))
    return F.when(common == F.size(here), below).when((depth > 0) & (common >= depth - 1), above).otherwise(plain(path, cwd))
