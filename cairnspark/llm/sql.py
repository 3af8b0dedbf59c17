"""SQL that gives the same rows as those corpus operators that SQL can express."""

from __future__ import annotations


def _part(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Whether 2 divides the crc32 of the decimal id: the checksum's bits are pushed out one by one, eight for each digit.
_EVEN = """list_reduce(flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '')]),
  lambda c, x: xor(xor(c, CAST(x AS BIGINT)) >> 1, CASE WHEN xor(c, CAST(x AS BIGINT)) & 1 = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)) & 1 = 1"""


def _climb(name: str, start: str) -> str:
    """The levels of a tree from rows (g, idx, h), and what stands left and right of each node in its run."""
    run = "OVER (PARTITION BY g, l, idx // 3 ORDER BY idx ROWS BETWEEN"
    return f"""{name}(g, l, idx, h, n) AS (
  SELECT g, 0, idx, h, count(*) OVER (PARTITION BY g) FROM {start}
  UNION ALL
  SELECT g, l + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, l, idx // 3),
{name}_steps AS (SELECT g, l, idx, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name} WHERE n > 1)"""


def _fold(name: str, steps: str, start: str) -> str:
    """Rows (rid, g, idx, h, proof) carried up a tree; the last row of each rid is at the root."""
    return f"""{name}(rid, g, l, idx, h, proof) AS (
  SELECT rid, g, 0, idx, h, proof FROM {start}
  UNION ALL
  SELECT f.rid, f.g, f.l + 1, f.idx // 3, sha256(s.lft || f.h || s.rgt), f.proof || s.lft || s.rgt FROM {name} f JOIN {steps} s USING (g, l, idx)),
{name}_end AS (SELECT rid, arg_max(h, l) AS h, arg_max(proof, l) AS proof FROM {name} GROUP BY rid)"""


MERKLE = f"""WITH RECURSIVE
leaves AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf,
  {_leaf(f"(CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END)")} AS found FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h FROM leaves),
{_climb("up", "placed")},
sources AS (SELECT g AS of, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, h FROM up WHERE n = 1),
{_climb("top", "sources")},
low AS (SELECT rid, g, idx, found AS h, '' AS proof FROM placed),
{_fold("own", "up_steps", "low")},
mid AS (SELECT p.rid, s.g, s.idx, e.h, e.proof FROM own_end e JOIN placed p USING (rid) JOIN sources s ON s.of = p.g),
{_fold("rest", "top_steps", "mid")}
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN sources s ON s.of = p.g JOIN rest_end e USING (rid) JOIN top t ON t.n = 1"""


#: ASCII upper case to lower, nothing else.
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""WITH words AS (SELECT rid, doc_id, unnest(t) AS term, CAST(len(t) AS BIGINT) AS n FROM
  (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL)),
tf AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM words GROUP BY ALL),
totals AS (SELECT CAST(count(DISTINCT rid) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS len FROM words),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
scores AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""
