"""Prompts as Column functions, in words of our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULE_LINES = 100
#: What stands between the sections of a module's files.
BETWEEN = "\n\n"


def fenced(lang: Column, source: Column) -> Column:
    return F.concat(F.lit("```"), lang, F.lit("\n"), source, F.lit("\n```"))


def explain(kind: Column, name: Column, path: Column, lang: Column, source: Column) -> Column:
    return F.concat(F.lit("Explain what this "), kind, F.lit(" does.\nName: "), name, F.lit("\nFile: "), path, F.lit("\n\n"), fenced(lang, source))


def section(path: Column, source: Column) -> Column:
    """The first lines of a file, as a part of its module's prompt."""
    return F.concat(F.lit("## "), path, F.lit("\n"), F.array_join(F.slice(F.split(source, "\n"), 1, MODULE_LINES), "\n"))


def summary_head(module: Column) -> Column:
    return F.concat(F.lit("Summarize the module "), module, F.lit(".\n\n"))


def summarize(module: Column, files: Column) -> Column:
    """Of a module and an array of (path, source): the first lines of each file."""
    return F.concat(summary_head(module), F.array_join(F.transform(files, lambda f: section(f["path"], f["source"])), BETWEEN))


def called(name: Column, callers: Column, callees: Column) -> Column:
    """Of the joined names of those that call it and that it calls."""
    return F.concat(F.lit("Describe the part that "), name, F.lit(" plays.\nCalled by: "), callers, F.lit("\nCalls: "), callees)


def call_graph(name: Column, callers: Column, callees: Column) -> Column:
    return called(name, F.array_join(callers, ", "), F.array_join(callees, ", "))
