"""Feature conditions of code: evaluated as nested expressions, taken from attributes, inherited by blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A call's opening, a feature test, a closing, or any other test.
_PARTS = r"""[A-Za-z_]\w*\s*\(|feature\s*=\s*"[^"]*"|\)|[^,()\s][^,()"]*(?:"[^"]*")?"""
_FRAME = "array<struct<op:string,value:boolean>>"


def _fed(frames: Column, value: Column) -> Column:
    """The frames with one more value for the innermost: any needs one that is true, every other operator all of them."""
    top = F.element_at(frames, -1)
    joined = F.when(top["op"] == "any", F.coalesce(top["value"], F.lit(False)) | value).otherwise(F.coalesce(top["value"], F.lit(True)) & value)
    return F.concat(F.slice(frames, F.lit(1), F.size(frames) - 1), F.array(F.struct(top["op"].alias("op"), joined.alias("value"))))


def _closed(frames: Column) -> Column:
    """The frames after a closing: the innermost one's result is a value of the one around it."""
    top = F.element_at(frames, -1)
    result = F.when(top["op"] == "not", ~F.coalesce(top["value"], F.lit(True))).when(top["op"].isin("any", "all"), F.coalesce(top["value"], F.lit(True))).otherwise(True)
    outer = F.slice(frames, F.lit(1), F.size(frames) - 1)
    return F.when(F.size(frames) > 1, _fed(outer, result)).otherwise(frames)


def is_live(condition: Column, features: Sequence[str] | Column) -> Column:
    """Whether code under a condition is built with the active features (names, or an array column).

    feature = "x", all(...), any(...) and not(...) nest to any depth; every other test, known operator or not, counts as true, and
    so does a condition that is null, empty, has empty brackets or is not closed.
    """
    names = features if isinstance(features, Column) else F.array(*(F.lit(f) for f in features)).cast("array<string>")
    parts = F.regexp_extract_all(F.coalesce(condition, F.lit("")), F.lit(_PARTS), 0)

    def step(frames: Column, part: Column) -> Column:
        named = F.regexp_extract(part, r'^feature\s*=\s*"([^"]*)"$', 1)
        is_feature = part.rlike(r'^feature\s*=\s*"[^"]*"$')
        opened = F.concat(frames, F.array(F.struct(F.trim(F.regexp_replace(part, r"\($", "")).alias("op"), F.lit(None).cast("boolean").alias("value"))))
        return (
            F.when(part == ")", _closed(frames)).when(part.endswith("("), opened)
            .otherwise(_fed(frames, F.when(is_feature, F.array_contains(names, named)).otherwise(True)))
        )

    start = F.array(F.struct(F.lit("all").alias("op"), F.lit(None).cast("boolean").alias("value"))).cast(_FRAME)
    frames = F.aggregate(parts, start, lambda acc, p: step(acc, p).cast(_FRAME))
    return F.when(F.size(frames) == 1, F.coalesce(F.get(frames, F.lit(0))["value"], F.lit(True))).otherwise(True)


_ATTRIBUTE = r"""#\[(?:[^\[\]"]|"(?:\\.|[^"\\])*"|\[[^\[\]]*\])*\]"""
_FUNCTION = rf'(?m)((?:{_ATTRIBUTE}\s*)*)^?[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+"[^"]*")?)\s+)*\bfn\s+(\w+)'


def function_conditions(files: DataFrame) -> DataFrame:
    """(file, function, condition) of the functions in Rust files (file, content) that stand under a cfg attribute.

    Only attributes right before a function are its own; of several cfg attributes the last one counts. A function without one
    has no row, and of functions with one name each has its own.
    """
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(_FUNCTION), 1).alias("attributes"), F.regexp_extract_all("content", F.lit(_FUNCTION), 2).alias("function"))
    rows = files.select("file", F.explode(found).alias("f"))
    own = F.filter(F.regexp_extract_all("f.attributes", F.lit(_ATTRIBUTE), 0), lambda a: a.rlike(r"(?s)^#\[\s*cfg\s*\(.*\)\s*\]$"))
    inner = F.trim(F.regexp_extract(F.element_at(own, -1), r"(?s)^#\[\s*cfg\s*\((.*)\)\s*\]$", 1))
    return rows.where(F.size(own) > 0).select("file", F.col("f.function").alias("function"), inner.alias("condition"))


def inherited(blocks: DataFrame, conditions: DataFrame) -> DataFrame:
    """Blocks (file, function, ...) with the condition of their function, null without one."""
    return blocks.join(conditions, ["file", "function"], "left")
