"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed words that are no search terms.
STOP_WORDS = (
    "a", "an", "and", "are", "be", "been", "bug", "by", "calls", "fix", "for", "from", "how", "in", "into", "is", "of", "on", "show", "that", "the", "these",
    "this", "those", "to", "was", "were", "what", "whats", "when", "where", "who", "why", "with",
)


def terms(text: Column, most: int = 8) -> Column:
    """Search terms in order, as they are spelled: identifiers of three letters or more, or with an underscore; no stop words, and
    each once in either case."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    kept = F.filter(words, lambda w: ((F.length(w) >= 3) | w.contains("_")) & ~F.lower(w).isin(*STOP_WORDS))
    named = F.array(F.struct(kept.alias("words"), F.transform(kept, F.lower).alias("lower")))
    once = F.transform(named, lambda n: F.filter(n["words"], lambda w, i: F.array_position(n["lower"], F.lower(w)) == i + 1))
    return F.slice(F.get(once, F.lit(0)), 1, most)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def frontmatter(text: Column) -> Column:
    """key: value lines between --- at the very start, as a map; empty without."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))
    named = F.transform(pairs, entry)
    # the last line of a key counts
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda e: e["k"] == k), -1)["v"]))


def title(text: Column) -> Column:
    """The title of the front matter, else the first heading of level one; null without."""
    heading = F.regexp_extract(text, r"(?m)^# +(.+)$", 1)
    return F.coalesce(F.try_element_at(frontmatter(text), F.lit("title")), F.when(heading != "", F.trim(heading)))


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|shown]] in order, each once."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda x: x != ""))


def tags(text: Column) -> Column:
    """Tags of the front matter (a list, or parted by commas), then #tags of the text without hex colours of three or six digits; in
    order, each once."""
    listed = F.regexp_replace(F.coalesce(F.try_element_at(frontmatter(text), F.lit("tags")), F.lit("")), r"^\[|\]$", "")
    named = F.transform(F.split(listed, ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", ""))
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}#]+$", ""))
    inline = F.transform(F.filter(words, lambda w: w.startswith("#") & (F.length(w) > 1)), lambda w: F.substring(w, 2, 1 << 30))
    inline = F.filter(inline, lambda t: ~t.rlike("^([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"))
    return F.array_distinct(F.concat(F.filter(named, lambda t: t != ""), inline))


def simple_name(name: Column) -> Column:
    """What stands after the last :: or . of a name."""
    return F.element_at(F.split(name, r"::|\."), -1)


def parent_module(path: Column) -> Column:
    """A :: path without its last part; empty at the top."""
    return F.when(path.contains("::"), F.regexp_replace(path, "::[^:]*$", "")).otherwise("")


#: Fixed names of symbol kinds and their keys.
KINDS = {
    "Function": "fn", "Method": "method", "Class": "struct", "Interface": "trait", "Enum": "enum", "Module": "mod", "Union": "union", "Namespace": "namespace",
    "TypeAlias": "type_alias", "Unknown": "unknown",
}


def normalized_kind(kind: Column) -> Column:
    """The key of a symbol kind by its name or its key; null for others."""
    out = F.lit(None).cast("string")
    for name, key in KINDS.items():
        out = F.when(kind.isin(name, key), key).otherwise(out)
    return out


#: Fixed phrases by which a question is told; the first intent that has one of its phrases counts.
INTENTS = {
    "callers": ("who calls", "who uses", "callers of", "who references", "who invokes", "dependencies of", "dependents of", "who depends on"),
    "callees": ("who is called by", "callees of", "calls from", "outgoing calls", "called by"),
    "cfg": ("cfg for", "control flow", "cfg of", "show cfg"),
    "blast_zone": ("blast zone", "blast-zone", "hot paths", "hotpaths", "hot path"),
    "cycles": ("cycles", "circular", "cyclic", "strongly connected"),
    "impact": ("impact of", "affected by", "what breaks", "what changes"),
    "complex": ("complex", "high complexity", "most complex", "complicated"),
    "search": ("search", "semantic", "find code", "look for"),
}


def intent(question: Column) -> Column:
    """What a question asks for; "find" without any of the phrases."""
    q, out = F.lower(question), F.lit("find")
    for name, phrases in reversed(INTENTS.items()):
        found = F.lit(False)
        for phrase in phrases:
            found = found | q.contains(phrase)
        out = F.when(found, name).otherwise(out)
    return out


def project_name(url: Column) -> Column:
    """Name of a repository by its remote URL: the last path part without .git, other characters as dashes; null if empty."""
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), r"([^/:]+)$", 1)
    clean = F.regexp_replace(F.regexp_replace(last, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(clean != "", clean)


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) at a character offset (from 0)."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def language_of(path: Column) -> Column:
    """Language by file extension, case sensitive; null if unknown. The table is fixed."""
    known = {
        "rs": "rust", "py": "python", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hip": "cpp", "java": "java", "js": "javascript",
        "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "cu": "cuda", "cuh": "cuda",
    }
    ext = F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), ext)


def symbol_id(language: Column, path: Column, kind: Column, name: Column, other: Column) -> Column:
    """Stable id: 16 hex digits of the SHA-256 of language, relative path, kind, name and what else tells it apart."""
    return F.substring(F.sha2(F.concat_ws(":", language, path, kind, name, other), 256), 1, 16)


def span_id(path: Column, start: Column, end: Column) -> Column:
    """16 hex digits of the SHA-256 of path, start and end, numbers as 8 bytes with the highest first."""
    eight = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    sep = F.lit(":").cast("binary")
    return F.substring(F.sha2(F.concat(path.cast("binary"), sep, eight(start), sep, eight(end)), 256), 1, 16)
