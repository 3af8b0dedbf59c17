"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import merkle, sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*values: str) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf(row: dict, text: str | None) -> str:
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and each leaf's pairs of what is left and right of it, level by level."""
    paths, below = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        upper, above = [], []
        for k in range(0, len(hashes), 3):
            run = hashes[k : k + 3]
            for j in range(len(run)):
                for i in below[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            upper.append(digest(*run))
            above.append([i for j in range(len(run)) for i in below[k + j]])
        hashes, below = upper, above
    return hashes[0], paths


def plain(rows: list[dict]) -> list[tuple]:
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r, leaf(r, r["text"])))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        found = sorted(by_source[s], key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees.append((found, *climb([h for _, h in found])))
    root, upper = climb([t[1] for t in trees])
    out = []
    for (found, subroot, lower), rest in zip(trees, upper, strict=True):
        for (r, own), path in zip(found, lower, strict=True):
            text, ident = r["text"], "" if r["doc_id"] is None else str(r["doc_id"])
            if text is not None and zlib.crc32(ident.encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for left, right in path + rest:
                h = digest(left, h, right)
            out.append((r["doc_id"], own, subroot, root, digest(*(a + b for a, b in path + rest)), h, h == root))
    return out


def run(df, rows):
    return rows(merkle.manifest(df, merkle.without_newlines()))


def test_sizes_of_groups(spark, rows):
    """Lone leaves, one run, last runs of one, a block of 243 rows and one more, and several rounds."""
    sizes = {None: 1, "": 2, "é": 3, "z": 4, "a": 10, "b": 242, "c": 243, "d": 244, "e": 2300}
    data, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            data.append((i * 7 % 3001, source, None if i % 5 else "en", i % 3 or None, None if i % 11 == 0 else f"line {i}\nand {i % 4}"))
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    assert run(df, rows) == sorted(plain([r.asDict() for r in df.collect()]), key=str)


def test_many_sources(spark, rows):
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("x\n").alias("text"))
    assert run(df, rows) == sorted(plain([r.asDict() for r in df.collect()]), key=str)


def test_odd_rows(spark, odd_docs, no_docs, rows):
    assert run(no_docs, rows) == []
    found = run(odd_docs, rows)
    assert found == sorted(plain([r.asDict() for r in odd_docs.collect()]), key=str)
    # an untouched text is always verified
    assert all(r["verified"] for r in merkle.manifest(odd_docs).collect())
    one = spark.createDataFrame([(5, "s", "en", 1, "a")], SCHEMA)
    only = merkle.manifest(one).first()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == digest()


def test_sql(spark, rows):
    duck = duckdb.connect()
    path = "/root/testdata/sf0.001/documents.parquet"
    duck.execute(f"create view documents as select * from '{path}'")
    assert run(spark.read.parquet(path), rows) == sorted(duck.execute(sql.MERKLE).fetchall(), key=str)


@pytest.mark.parametrize("value,text", [(None, "-"), ("", "0:"), ("é", "2:é")])
def test_parts(spark, value, text):
    assert spark.createDataFrame([(value,)], "v string").select(merkle.part(F.col("v")).alias("p")).first()["p"] == text
