"""Fuzzy line dedup with DataFrame and SQL functions only.

Lines become sets of hashed character shingles. A line's signature divides its shingles among places by their hash and keeps the
least hash of each place (one-permutation MinHash), so it costs one hash for each shingle; a line with too few distinct
shingles to fill its places also gets a signature of independent hash functions. Two places of a signature agree with the
probability of the lines' Jaccard similarity. Bands of the signature find candidates, the full shingle sets decide, and a
distributed union-find over the verified pairs makes components, of which the first line in order of document and position stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from .common import components, drop_table, small, table

SHINGLE, THRESHOLD, BANDS, ROWS = 10, 0.8, 8, 3
PLACES = BANDS * ROWS
#: Shingles for each place that a long line looks at: those with the least hashes, which are all that can be the least of a place.
#: A place stays empty in one of 150 cases then. Lines of up to PLACES * PER_PLACE shingles look at all of them.
PER_PLACE = 5
#: A line with fewer bands also gets bands of independent hash functions.
LEAST_BANDS, OWN_BANDS = 7, 6
#: Lines of a group in one block; the blocks of a larger group are compared two by two.
BLOCK = 2000
_ALL = 1 << 32
#: An independent function is (odd factor x hash + summand) mod 2^32.
_random = random.Random(20240229)
_FUNCTIONS = [(_random.randrange(1, 1 << 30, 2), _random.randrange(1 << 32)) for _ in range(OWN_BANDS * ROWS)]


def _starts(coded: Column) -> Column:
    """Byte offsets (from 1) of the shingles of a line in UTF-16; a line shorter than a shingle is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.length(coded) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))


def _hash(coded: Column, start: Column) -> Column:
    return F.hash(F.substring(coded, start, F.lit(2 * SHINGLE)))


def shingles(line: Column) -> Column:
    """The set of hashes (32 bits: two of 600 shingles share one in 1 of 25,000 cases) of a line's shingles."""
    # the line is encoded once and named by the outer function, or each shingle would copy it
    named = F.transform(F.array(F.encode(line, "UTF-16BE")), lambda coded: F.transform(_starts(coded), lambda i: _hash(coded, i)))
    return F.array_distinct(F.get(named, F.lit(0)))


def occurrences(docs: DataFrame) -> DataFrame:
    """Each line that is not blank: doc_id, text_hash, at (its place in the text), line, node (its 64-bit hash)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("node", F.xxhash64("line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """A row for each shingle of each line: node, i (1 for a line's first), n (shingles of the line), h (32 bits, from 0)."""
    coded = lines.select("node", F.encode("line", "UTF-16BE").alias("coded"))
    rows = coded.select("node", "coded", F.explode(_starts(F.col("coded"))).alias("i"))
    n = F.greatest(F.shiftright(F.length("coded"), 1) - (SHINGLE - 1), F.lit(1)).alias("n")
    return rows.select("node", "i", n, _hash(F.col("coded"), F.col("i")).cast("long").bitwiseAND(F.lit(_ALL - 1)).alias("h"))


def _buckets(least: DataFrame, bands: int, kind: int) -> DataFrame:
    """(node, n, copies, buckets): a hash for each band whose places are all filled."""
    of = ([f"m{b * ROWS + r}" for r in range(ROWS)] for b in range(bands))
    hashes = (F.when(F.greatest(*band) < F.lit(_ALL), F.xxhash64(F.lit(kind), F.lit(b), *band)) for b, band in enumerate(of))
    return least.select("node", "n", "copies", F.array_compact(F.array(*hashes)).alias("buckets"))


def signatures(lines: DataFrame) -> DataFrame:
    """(node, copies, buckets) for each distinct line, and a second row for a line that is short or fills too few places.

    A line with most bands meets any similar line by them, whether that one has them all or not; two lines that both lack
    bands meet by their independent hash functions.
    """
    whole = PLACES * PER_PLACE
    within = F.col("h") * F.col("n") < F.lit(_ALL * whole)
    # the first shingle of each line stays, to count lines
    thinned = _hashed(lines).where(within | (F.col("i") == 1)).withColumn("place", F.when(within, F.col("h") % PLACES).otherwise(PLACES).cast("int"))
    # by its filter a row touches the one minimum that it may change
    filled = table(_buckets(_count_and_least(thinned, [F.col("h")] * PLACES, "place"), BANDS, 0), "places")
    lacking = filled.where((F.col("n") > whole) & (F.size("buckets") < LEAST_BANDS)).select("node")
    short = F.length("line") < whole + SHINGLE
    flags = small(lacking).withColumn("lacking", F.lit(True))
    rows = _hashed(lines.select("node", "line").join(flags, "node", "left").where(short | F.col("lacking")))
    second = _count_and_least(rows, [(F.col("h") * F.lit(a) + F.lit(b)).bitwiseAND(F.lit(_ALL - 1)) for a, b in _FUNCTIONS])
    return filled.unionByName(table(_buckets(second, OWN_BANDS, 1), "functions")).drop("n")


def _count_and_least(rows: DataFrame, values: list[Column], place: str | None = None) -> DataFrame:
    """(node, n, copies, m0, m1, ...): the least of each value; with `place`, over the rows whose place is the value's number, or else _ALL."""
    least = [F.min(value).alias(f"m{k}") for k, value in enumerate(values)]
    if place:
        least = [F.expr(f"min(_value{k}) filter (where {place} = {k})").alias(f"m{k}") for k in range(len(values))]
        rows = rows.select("*", *(value.alias(f"_value{k}") for k, value in enumerate(values)))
    summed = rows.groupBy("node").agg(F.first("n").alias("n"), F.count(F.when(F.col("i") == 1, 1)).alias("copies"), *least)
    return summed.select("node", "n", "copies", *(F.coalesce(f"m{k}", F.lit(_ALL)).alias(f"m{k}") for k in range(len(values))))


def _alike(common: Column, n: Column, m: Column, threshold: float) -> Column:
    """Whether |x & y| / |x | y| is at least the threshold, to three digits and in whole numbers."""
    t = round(threshold * 1000)
    return common * (1000 + t) >= t * (n + m)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough by their full shingle sets."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    n, m = F.size("x"), F.size("y")
    # the smaller set is all that two lines can have in common
    may = F.least(n, m) * 1000 >= round(threshold * 1000) * F.greatest(n, m)
    sizes = pairs.join(one, "a").join(two, "b").where(may).select("a", "b", n.alias("n"), m.alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return table(sizes, "verified").where(_alike(F.col("common"), F.col("n"), F.col("m"), threshold)).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _links_of_rest(rooted: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between lines (bucket, node, root) of a bucket that have different roots so far.

    All lines outside the largest component of a bucket are compared with every line of the bucket that is not in theirs. Both sides are
    cut into blocks, so that no bucket is one group; sets are compared inside the join, which makes links, not pairs.
    """
    marks = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    counted = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), *marks)
    largest = F.max(F.struct("n", "root")).alias("main")
    summed = counted.groupBy("bucket").agg(largest, F.count("*").alias("roots"), F.sum("n").alias("size"), *(F.bit_xor(c).alias(c) for c in "xy"))
    # of buckets with the same lines one is enough
    apart = summed.where("roots > 1").groupBy("x", "y", "size").agg(F.min(F.struct("bucket", "main")).alias("of"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = apart.select("of.bucket", F.col("of.main.root").alias("main"), blocks(F.col("size") - F.col("of.main.n")).alias("ls"), blocks(F.col("size")).alias("rs"))
    rows = table(rooted.join(small(table(split, "apart")), "bucket"), "apart-lines")
    of_line = signed.join(rows.select("node").distinct(), "node").groupBy("node").agg(F.flatten(F.collect_list("buckets")).alias("buckets"))
    rows = rows.join(of_line.join(sets, "node"), "node")
    dealt = lambda own, other, k: F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(k)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = rows.where("root <> main").select("bucket", own("ls").alias("l"), dealt("l", "rs", "r"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("buckets").alias("x"), F.col("set").alias("s"))
    two = rows.select("bucket", dealt("r", "ls", "l"), own("rs").alias("r"), F.col("node").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"), F.col("buckets").alias("y"), F.col("set").alias("t"))
    n, m = F.size("s"), F.size("t")
    same = (one["bucket"] == two["bucket"]) & (one["l"] == two["l"]) & (one["r"] == two["r"])
    # the cheaper tests come first; two lines outside the largest component meet twice, and in each bucket that they share
    test = (F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (F.least(n, m) * 1000 >= round(threshold * 1000) * F.greatest(n, m))
    once = F.array_min(F.array_intersect("x", "y")) == one["bucket"]
    return one.join(two, same & test & once & _alike(F.size(F.array_intersect("s", "t")), n, m, threshold)).select("a", "b")


def shared_buckets(lines: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, copies) for buckets of several lines, and the shingle sets (node, set) of those lines."""
    placed = signed.select("node", "copies", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("bucket")
    shared = table(shared, "buckets")
    placed = table(placed.join(small(shared), "bucket"), "bucket-lines")
    nodes = table(placed.select("node").distinct(), "bucket-nodes")
    texts = lines.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.first("line").alias("line"))
    sets = table(texts.select("node", shingles(F.col("line")).alias("set")), "shingle-sets")
    for used in (shared, nodes):
        drop_table(used)
    return placed, sets


def similar_lines(placed: DataFrame, sets: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) for the distinct lines that are connected to others by verified similarity.

    First every line is compared with the most frequent line of each of its buckets, which edited copies mostly come from; where lines of
    a bucket are then still apart they are compared with each other, so no link is left out.
    """
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("copies", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"))
    others = table(placed.join(small(table(hubs, "hubs")), "bucket").where("node <> hub").select("bucket", "node", "hub"), "hub-lines")
    links = table(verified(others.select(*_ordered("node", "hub")).distinct(), sets, threshold), "hub-links")
    first = components(links, "line-stars")
    rooted = table(others.join(first, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "rooted")
    more = table(_links_of_rest(rooted, signed, sets, threshold), "rest-links")
    for used in (placed, others, sets, first, rooted):
        drop_table(used)
    return components(links.unionByName(more), "line-links")


def _filled_lines(text: Column) -> Column:
    """Lines of a text that are not blank. Where none begins with a blank or is empty, each is one."""
    # a line that is not blank is the start of the text or a line feed, blanks and what is not blank
    counted = F.regexp_count(text, F.lit(r"(?:^|\n)[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"))
    blanks = [F.lit(x) for x in " \t\n\x0b\x0c\r"]
    doubtful = (text == "") | F.endswith(text, F.lit("\n"))
    for x in blanks:
        doubtful = doubtful | F.startswith(text, x) | F.contains(text, F.concat(F.lit("\n"), x))
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(doubtful, counted).otherwise(feeds + 1)


def deduped(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row (a struct with the columns of docs), text (the new one), n_lines, n_dropped for each row of docs; see dedup()."""
    lines = table(occurrences(docs), "lines")
    signed = signatures(lines)
    placed, sets = shared_buckets(lines, signed)
    # from here on texts are not needed
    places = table(lines.select("doc_id", "text_hash", "at", "node"), "line-places")
    drop_table(lines)
    groups = similar_lines(placed, sets, signed, threshold)
    repeated = signed.where("copies > 1").select("node").distinct()
    members = repeated.join(groups, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root"))
    place = F.struct("doc_id", "text_hash", "at")
    found = table(places.join(small(table(members, "line-groups")), "node").select("root", "doc_id", "text_hash", "at"), "grouped-lines")
    heads = table(found.groupBy("root").agg(F.min(place).alias("head")), "line-heads")
    gone = found.join(small(heads), "root").where(~place.eqNullSafe(F.col("head"))).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone"))
    gone = table(gone.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "gone"), "gone")
    for used in (places, signed, groups, found, heads):
        drop_table(used)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    parts = F.split("row.text", "\n", -1)
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    n_lines = F.coalesce(_filled_lines(F.col("row.text")), F.lit(0)).cast("long")
    return joined.select(
        "row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("text"),
        n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text and any other columns) with one line per component, and n_lines and n_dropped before `text` changes.

    Two lines are linked when the Jaccard similarity of their sets of 10-character shingles is `threshold` or more; equal lines
    are. A character is a unit of UTF-16, so one from U+10000 on counts as two, and a shingle may begin or end inside it. Of each component the line stays that is first by doc_id (nulls first), then by a hash of the text, then by place. Blank lines
    always stay, and so do nulls: a null text stays null, an empty one empty. Rows with the same doc_id and text are one
    document and are all treated alike; other rows with the same doc_id are documents of their own. Long lines and texts are taken
    whole. An empty table gives no rows. The result has the columns of docs with the new text, and _n_lines (lines
    that are not blank) and _n_dropped, which take the place of columns of docs with these names. Lines are told apart by
    64-bit hashes. A pair at the threshold shares a band with a probability of 0.997 (measured recall: README).
    """
    left = deduped(docs, threshold)
    own = [c for c in docs.columns if c.lower() not in ("_n_lines", "_n_dropped")]
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own]
    return left.select(*columns, F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))
