"""Shell output: passing lines dropped, near-identical runs grouped, library frames collapsed, lines capped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines_with_ends, strip

# Lines of passing tests, frames of libraries, and the line of a root exception.
PASSING = (
    r"(?iU)^\s*(PASSED|PASS|ok|\.)\s*\z",
    r"(?iU)^\s*test_\w+\s+PASSED",
    r"(?iU)\bPASSED\s*\z",
    r"(?U)^\s*✓\s+",
    r"(?iU)^\s*--- PASS:",
    r"(?iU)^\s*test .* \.\.\. ok\n?\z",
    r"(?U)^\s*\d+ passed",
    r"(?iU)^\s*collecting \.\.\.",
)
LIBRARY_FRAME = r'(?d)File "(?:.*(site-packages|dist-packages|Lib[/\\]|lib/python|<frozen)[^"]*)"'
EXCEPTION = r"(?imdU)^([\w.]*?)(?:Error|Exception|Warning|Failure|Fault|Panic|FAIL|fatal).*"


def drop_passing(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in PASSING)))


def group_similar(lines: Column, ratio: float = 0.15) -> Column:
    """Runs of lines near the first of the run become that line and a count; their line end is lost."""
    none = F.array().cast("array<struct<head:string,n:int>>")

    def step(runs, line):
        last = F.element_at(runs, -1)
        most = (F.greatest(F.length(last["head"]), F.length(line), F.lit(1)) * F.lit(ratio)).cast("int")
        near = (F.size(runs) > 0) & (F.levenshtein(strip(last["head"]), strip(line)) <= most)
        grown = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["head"].alias("head"), (last["n"] + 1).alias("n"))))
        return F.when(near, grown).otherwise(F.concat(runs, F.array(F.struct(line.alias("head"), F.lit(1).alias("n")))))

    # try_element_at semantics are needed on the first line only: an empty list has no head
    runs = F.aggregate(F.slice(lines, 2, 1 << 30), F.when(F.size(lines) > 0, F.array(F.struct(F.get(lines, F.lit(0)).alias("head"), F.lit(1).alias("n")))).otherwise(none), step)
    return F.transform(runs, lambda r: F.when(r["n"] > 1, F.concat(F.regexp_replace(r["head"], r"(?U)\s+\z", ""), F.lit(" [×"), r["n"].cast("string"), F.lit("]"))).otherwise(r["head"]))


def collapse_frames(lines: Column) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("run"))

    def note(n):
        return F.concat(F.lit("    … "), n.cast("string"), F.when(n > 1, " stdlib/venv frames omitted …\n").otherwise(" stdlib/venv frame omitted …\n"))

    def flush(s):
        return F.when(s["run"] > 0, F.concat(s["out"], F.array(note(s["run"])))).otherwise(s["out"])

    def step(s, line):
        return F.when(line.rlike(LIBRARY_FRAME), F.struct(s["out"].alias("out"), (s["run"] + 1).alias("run"))).otherwise(F.struct(F.concat(flush(s), F.array(line)).alias("out"), F.lit(0).alias("run")))

    return F.aggregate(lines, start, step, flush)


def cap_lines(lines: Column, most: int = 200) -> Column:
    half = most // 2
    note = F.concat(F.lit("\n… ["), (F.size(lines) - most).cast("string"), F.lit(" lines omitted] …\n"))
    return F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, half), F.array(note), F.slice(lines, -half, half))).otherwise(lines)


def root_exception(text: Column) -> Column:
    """The last line that begins with a dotted name of an exception.

    The dotted name is a class of characters in the pattern, as a repeated group would take a stack frame for each part;
    that its parts are not empty is asked of what was found.
    """
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(EXCEPTION), F.lit(0)).alias("line"), F.regexp_extract_all(text, F.lit(EXCEPTION), F.lit(1)).alias("name"))
    named = F.filter(found, lambda x: ~x["name"].startswith(".") & ~F.contains(x["name"], F.lit("..")))
    return F.when(F.size(named) > 0, F.element_at(named, -1)["line"])


def minify_shell(text: Column, most: int = 200, ratio: float = 0.15) -> Column:
    root = root_exception(text)
    out = F.array_join(cap_lines(collapse_frames(group_similar(drop_passing(lines_with_ends(text)), ratio)), most), "")
    return F.when(root.isNotNull() & (root != "") & ~F.contains(out, root), F.concat(out, F.lit("\n[ROOT EXCEPTION] "), root, F.lit("\n"))).otherwise(out)
