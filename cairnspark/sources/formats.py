"""Line formats read with DataFrame functions: LCOV, LSIF, compile commands, compiler text. Lines are numbered in their file by a
table (file, n, line), so a file's lines can be carried in order by windows over the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.shell import shell_split, useful_flags


def numbered_lines(files: DataFrame) -> DataFrame:
    """(file, n, line) of files (file, content)."""
    return files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("n", "line"))


def _carried(lines: DataFrame, expr: F.Column) -> F.Column:
    return F.last(expr, ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


def lcov(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line hits (source, line, hits; the last record of a line counts) and branch hits (source, line, block, branch, taken; the
    greatest, '-' and negative numbers as 0)."""
    named = lines.withColumn("source", _carried(lines, F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20))))
    field = lambda i: F.split(F.regexp_replace("line", "^[A-Z]+:", ""), ",")[i]
    da = named.where(F.col("line").startswith("DA:")).select("source", "file", "n", field(0).cast("long").alias("at"), field(1).cast("long").alias("hits"))
    hits = da.groupBy("source", F.col("at").alias("line")).agg(F.max_by("hits", F.struct("file", "n")).alias("hits"))
    taken = F.greatest(F.coalesce(F.expr("try_cast(split(regexp_replace(line, '^[A-Z]+:', ''), ',')[3] as bigint)"), F.lit(0)), F.lit(0))
    brda = named.where(F.col("line").startswith("BRDA:")).select("source", field(0).cast("long").alias("line"), field(1).cast("long").alias("block"), field(2).alias("branch"), taken.alias("taken"))
    return hits, brda.groupBy("source", "line", "block", "branch").agg(F.max("taken").alias("taken"))


def lsif_summary(spark: SparkSession, path: str) -> DataFrame:
    """Of an LSIF dump: the last package's name and the numbers of document and symbol vertices. A dump without a package is an error
    when the row is read."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("v", F.from_json("value", "type string, label string, name string"))
    rows = rows.where("v.type = 'vertex'")
    sums = rows.agg(
        F.max_by("v.name", F.when(F.col("v.label") == "package", F.col("n"))).alias("package"), F.count_if(F.col("v.label") == "package").alias("packages"),
        F.count_if(F.col("v.label") == "document").alias("documents"), F.count_if(F.col("v.label") == "symbol").alias("symbols"),
    )
    named = F.when(F.col("packages") > 0, F.col("package")).otherwise(F.raise_error(F.lit(f"no package in {path}")).cast("string"))
    return sums.select(named.alias("package"), "documents", "symbols")


def compile_flags(spark: SparkSession, path: str) -> DataFrame:
    """(file, flags) of a compile_commands.json: the flags that compile a file alone, of its arguments or its split command. A relative
    file is below its entry's directory."""
    rows = spark.read.json(path, multiLine=True, schema="directory string, file string, command string, arguments array<string>")
    words = F.coalesce("arguments", shell_split(F.col("command")))
    whole = F.when(F.col("file").startswith("/") | F.col("directory").isNull(), F.col("file")).otherwise(F.concat(F.regexp_replace("directory", "/+$", ""), F.lit("/"), "file"))
    return rows.select(whole.alias("file"), useful_flags(words).alias("flags"))


def mir_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of Rust MIR text: file, function, block, terminator. A block's terminator is the kind of its last statement."""
    fn = F.nullif(F.regexp_extract("line", r"^fn +([^(]+)\(", 1), F.lit(""))
    block = F.nullif(F.regexp_extract("line", r"^ +bb(\d+)(?: \(cleanup\))?: \{", 1), F.lit(""))
    named = lines.withColumn("function", _carried(lines, fn)).withColumn("block", _carried(lines, F.when(F.col("line").rlike("^(fn |})"), "-").otherwise(block)))
    inside = named.where(F.col("function").isNotNull() & (F.col("block") != "-") & F.col("line").rlike(r"^ {8}\S")).withColumn("block", F.col("block").cast("long"))
    last = inside.groupBy("file", "function", "block").agg(F.max_by(F.trim("line"), "n").alias("text"))
    kind = (
        F.when(F.col("text").startswith("return"), "return").when(F.col("text").startswith("goto"), "fallthrough").when(F.col("text").startswith("switchInt"), "conditional")
        .when(F.col("text").startswith("unreachable"), "unreachable").when(F.col("text").rlike("^(assert|drop)"), "conditional").when(F.col("text").contains("->"), "call").otherwise("fallthrough")
    )
    return last.select("file", "function", "block", kind.alias("terminator"), F.expr(r"transform(regexp_extract_all(text, 'bb([0-9]+)', 1), x -> cast(x as bigint))").alias("targets"))


def llvm_facts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of LLVM IR text: blocks (file, function, label, terminator, targets) and calls (file, function, callee). A switch is conditional
    whatever its cases, an invoke is a call with its two ways on as targets; both may spread over lines."""
    fn = F.nullif(F.regexp_extract("line", r'^define .*?@"?([\w.$]+)"?\(', 1), F.lit(""))
    label = F.nullif(F.regexp_extract("line", r"^([\w.$-]+):", 1), F.lit(""))
    named = lines.withColumn("function", _carried(lines, F.when(F.col("line").startswith("}"), F.lit("")).otherwise(fn)))
    named = named.withColumn("label", _carried(lines, F.when(fn.isNotNull(), "entry").otherwise(label))).where("function is not null and function <> ''")
    op = F.regexp_extract("line", r"^\s+(?:%[\w.$-]+ *= *)?(ret|br|switch|indirectbr|unreachable|invoke|resume)\b", 1)
    # a terminator's targets may stand on the lines below it, up to the end of its block
    began = _carried(named, F.when(F.col("label").isNotNull() & (op != ""), F.struct("label", op.alias("op"))))
    marked = named.withColumn("began", began).where("began is not null and began.label = label")
    ends = marked.groupBy("file", "function", "label").agg(F.max("began.op").alias("op"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    ends = ends.withColumn("targets", F.regexp_extract_all("text", F.lit(r'label %"?([\w.$-]+)'), 1))
    kind = (
        F.when(F.col("op").isin("ret", "resume"), "return").when(F.col("op") == "unreachable", "unreachable").when(F.col("op") == "invoke", "call")
        .when(F.col("op").isin("switch", "indirectbr") | (F.size("targets") > 1), "conditional").otherwise("fallthrough")
    )
    calls = named.select("file", "function", F.regexp_extract("line", r'\b(?:call|invoke)\b[^@]*@"?([\w.$]+)"?\(', 1).alias("callee")).where("callee <> ''")
    return ends.select("file", "function", "label", kind.alias("terminator"), "targets"), calls


def rust_imports(files: DataFrame) -> DataFrame:
    """`use` and `mod` statements of Rust files (file, content): file, kind, path array, name, is_glob; {a, b} gives a row each."""
    found = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?((?:use|mod)\s+[^;{]+(?:\{[^}]*\})?)\s*;"), 1)
    rows = files.select("file", F.explode(found).alias("s"))
    rows = rows.select("file", F.regexp_extract("s", r"^(use|mod)", 1).alias("kind"), F.regexp_replace("s", r"^(use|mod)\s+", "").alias("s"))
    head = F.regexp_replace(F.regexp_extract("s", r"^([^{]*)", 1), r"::\s*$", "")
    items = F.when(F.col("s").contains("{"), F.split(F.regexp_extract("s", r"\{([^}]*)\}", 1), r"\s*,\s*")).otherwise(F.array(F.lit("")))
    each = rows.select("file", "kind", head.alias("head"), F.explode(F.filter(items, lambda x: (x != "") | (F.size(items) == 1))).alias("item"))
    whole = F.trim(F.regexp_replace(F.when(F.col("item") != "", F.concat_ws("::", "head", F.trim("item"))).otherwise(F.col("head")), r"\s+as\s+\w+$", ""))
    return each.select("file", "kind", F.split(whole, "::").alias("path"), F.element_at(F.split(whole, "::"), -1).alias("name"), whole.endswith("*").alias("is_glob"))
