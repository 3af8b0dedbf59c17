"""Command lines: split as a shell does, and the flags that compile a file alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Starts of flags that are kept, and flags whose value is the next word (fixed values).
KEPT = ("-D", "-I", "-isystem", "-std=", "-f", "-m")
WITH_VALUE = ("-I", "-isystem")


def shell_split(command: Column) -> Column:
    """Words of a command line: white space parts them but not inside quotes, single or double, which are left out themselves and may
    stand anywhere in a word. An open quote reaches to the end; empty quotes alone are no word; null gives null."""
    pieces = F.regexp_extract_all(command, F.lit("\"[^\"]*(?:\"|\\z)|'[^']*(?:'|\\z)|\\s+|[^\\s\"']+"), 0)
    kind = "struct<words:array<string>,word:string>"

    def step(acc: Column, piece: Column) -> Column:
        bare = F.regexp_replace(piece, "(?s)^([\"'])(.*?)(?:\\1)?$", "$2")
        closed = F.when(acc["word"] != "", F.array_append(acc["words"], acc["word"])).otherwise(acc["words"])
        blank = piece.rlike(r"\A\s+\z")
        return F.struct(F.when(blank, closed).otherwise(acc["words"]).alias("words"), F.when(blank, "").otherwise(F.concat(acc["word"], bare)).alias("word"))

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit("").alias("word"))
    done = F.aggregate(pieces, start, lambda acc, p: step(acc, p).cast(kind))
    return F.when(done["word"] != "", F.array_append(done["words"], done["word"])).otherwise(done["words"])


def useful_flags(words: Column) -> Column:
    """Flags of a split command without its compiler: those that start as KEPT, with the next word where a flag has its value there;
    the word after -o goes with it."""
    kind = "struct<flags:array<string>,next:string>"

    def step(acc: Column, word: Column) -> Column:
        kept = F.lit(False)
        for start in KEPT:
            kept = kept | word.startswith(start)
        take = (acc["next"] == "value") | (F.coalesce(acc["next"], F.lit("")) == "") & kept
        then = F.when(acc["next"] != "", "").when(word == "-o", "drop").when(word.isin(*WITH_VALUE), "value").otherwise("")
        return F.struct(F.when(take, F.array_append(acc["flags"], word)).otherwise(acc["flags"]).alias("flags"), then.alias("next"))

    start = F.struct(F.array().cast("array<string>").alias("flags"), F.lit("").alias("next"))
    return F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), start, lambda acc, w: step(acc, w).cast(kind))["flags"]
