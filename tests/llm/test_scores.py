"""Quality, language, rules and secrets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import docstats, langid, quality, rules, secrets, urls

from .conftest import prose


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_word_stats_by_brute_force():
    r = random.Random(3)
    texts = [None, "", "\n\n", "a", "a a a a", "x\nx\n \nx", "é#é b"] + [" ".join(r.choice(["a", "b", "c", "\n", "#|", "ß", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(400)]
    s = docstats.word_stats(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(s[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_stats(text), text


def test_rules(spark, odd_docs, no_docs):
    out = rules.judge(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_text = {r["doc_id"]: r for r in out if r["doc_id"]}
    assert not by_text[3]["kept"] and by_text[3]["base_failed"] and by_text[3]["n_words"] == 0
    assert by_text[1]["kept"]
    assert rules.judge(no_docs).count() == 0
    junk = spark.createDataFrame([(1, prose(1, 200), "en"), (2, prose(2, 200), "en"), (3, prose(3, 200, "$$$%%%###"), None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in rules.judge(junk).collect()} == {1: True, 2: True, 3: False}


def test_distance_bounds():
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]])
    d = rules.distances(p, p[:2])
    assert d[0, 0] == 0 and d[0, 1] == pytest.approx(1.0) and np.isfinite(d).all()


def test_trees_learn_and_are_walked():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = quality.fit(x[:10], np.ones(10))
    assert np.allclose(one.predict(x[:3]), one.predict(x[:3])[0]) and one.predict(x[:3])[0] > 0.9
    assert quality.fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


def test_scores(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, None), (None, 1), (9, 0), (9, 1)], "doc_id long, quality int")
    out = quality.score(odd_docs, labels, quality.by_crc(5, 0)).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.score(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, prose(i, 80, "$$" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    held = quality.by_crc(5, 0)
    label = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    flipped = label.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(quality.score(docs, label, held)) == key(quality.score(docs, flipped, held))


def test_languages(spark, odd_docs, no_docs):
    alphabets = {"aa": "ba ka lu mo ni sa", "bb": "stri groz vlk prst smrt krk"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(alphabets[k].split()) for _ in range(60)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, quality.by_crc(4, 2))
    out = {x["doc_id"]: x for x in langid.identify(docs, model).collect()}
    assert all(out[i]["lang_pred"] == k and not out[i]["rejected"] for i, _, k in rows)
    far = spark.createDataFrame([(1, "7 7 7"), (2, None), (3, "qqq xxx yyy www jjj " * 20)], "doc_id long, text string")
    got = {x["doc_id"]: (x["lang_pred"], x["rejected"]) for x in langid.identify(far, model).collect()}
    assert got[1] == got[2] == ("und", True) and got[3][1]
    assert langid.train(no_docs) is None
    assert {x["lang_pred"] for x in langid.identify(odd_docs, None).collect()} == {"und"}
    carried = langid.identify(odd_docs, model, carry=True)
    assert carried.select("row.*").columns == odd_docs.columns and carried.count() == odd_docs.count()
    assert langid.identify(no_docs, model).count() == 0


#: Each kind as an expression of the standard library, and what its matches must hold.
SECRETS = {
    "assign": (re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    "github": (re.compile("gh[pousr]_[A-Za-z0-9]{36,}"), bool),
    "slack": (re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"), bool),
    "google": (re.compile("AIza[0-9A-Za-z_-]{35}"), bool),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), bool),
    "stripe": (re.compile("[sr]k_live_[0-9A-Za-z]{16,}"), bool),
    "key_block": (re.compile("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), bool),
}


def test_secrets_by_brute_force(spark, odd_docs):
    r = random.Random(3)
    parts = ["token", '="', "'", ": ", "AKIA", "ABCDEF0123456789", "0af" * 12, "Password", "api_key", "apikey = ", "xyz12345", "  ", "=", "é", "eyJabc.eyJdef.gh", "\0", "ghp_" + "a" * 36, "AIza" + "b_" * 18, "xoxb-1-", "sk_live_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "secret", "ſ", "K"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, "", "x" * 30_000 + " token=abcdefgh1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [(f["start"], f["kind"], f["end"]) for f in x["findings"]] for x in secrets.scan(docs).collect()}
    order = [x.kind for x in secrets.RULES]
    for i, text in enumerate(texts):
        expect = sorted((m.start(), order.index(kind), m.end()) for kind, (exact, holds) in SECRETS.items() for m in exact.finditer(text or "") if holds(m))
        assert got[i] == [(a, order[k], b) for a, k, b in expect]
    assert secrets.scan(odd_docs).count() == odd_docs.count()


def test_automaton_is_minimal_enough_and_lanes_agree():
    rules_ = [secrets.Rule("x", "ab*c|d{2,3}", "ab*c|d{2,3}")]
    a = secrets.compile_rules(rules_)
    assert len(a.marks) <= 5
    marks, size = a.lanes(b"-" * 5000 + b"a" + b"b" * 3000 + b"c" + b"-" * 500)
    assert marks.any() and np.flatnonzero(marks).tolist() == [8001 // size]


def test_urls(spark):
    pages = [
        (1, "https://A.Example.net/en/x?q#z", None), (2, "https://other.net/x", ""), (3, "http://m.example.com/de/1", None), (4, "http://x.org/fr/", None),
        (5, "http://example.net/de/1", None), (6, None, None), (7, "no scheme", "x"), (8, "http://bare.net", None),
        (9, "http://linker.test/", '<a href="http://bad.net/1">x</a>'), (10, "http://friend.test/", ""), (11, "http://good.org/fr/", '<a href="//friend.test/">'), (12, "http://bad.net/9", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [out[i]["rule"] for i in (2, 3, 4, 5, 8)] == ["net/", "example.com/de/", "org/fr/", "net/", None]
    assert [out[i]["verdict"] for i in (2, 3, 4, 5)] == ["block", "block", "allow", "block"]
    assert (out[6]["host"], out[6]["path"], out[6]["rule"], out[6]["verdict"]) == ("", "", None, "allow") and out[7]["host"] == ""
    assert out[9]["verdict"] == "block" and out[9]["distrust"] > out[9]["trust"]
    assert out[10]["verdict"] == "allow" and out[10]["trust"] > 0
    assert urls.judge(df.limit(0)).count() == 0


def test_url_verdicts_do_not_depend_on_the_number_of_hosts(spark):
    copies = spark.range(1500).select(F.col("id").alias("k"))
    small = [
        (0, "http://linker{}.test/", '<a href="http://bad{}.net/1">x</a>'), (1, "http://bad{}.net/1", ""), (2, "http://friend{}.test/", ""),
        (3, "http://good{}.org/fr/", '<a href="//friend{}.test/">'), (4, "http://alone{}.test/", ""),
    ]
    shape = spark.createDataFrame(small, "page_id long, url string, html string")
    named = lambda c: F.replace(c, F.lit("{}"), F.col("k").cast("string")).alias(c)
    many = shape.crossJoin(F.broadcast(copies)).select("page_id", named("url"), named("html"))
    of = lambda df: {(r["page_id"], r["verdict"], round(r["trust"], 9), round(r["distrust"], 9)) for r in urls.judge(df).collect()}
    one = of(shape)
    assert {(i, v) for i, v, *_ in one} == {(0, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "allow")}
    assert of(many) == one


def test_noise_and_unlearned_languages_are_rejected():
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    of = lambda sounds, n: ["".join(r.choice(sounds) for _ in range(r.randint(1, 4))) for _ in range(n)]
    spoken = {"aa": of("the in ing er and on ti re".split(), 400), "bb": of("sch ein en ung der ver eit ge".split(), 400)}
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    learned = [(k, say(spoken[k], r.choice([20, 60, 300, 900]))) for k in ("aa", "bb") for _ in range(300)]
    learned += [("aa", "outlier " * 200), ("bb", "%s " % ("xq" * 300))]
    model = langid.fit([k for k, _ in learned], langid.ngram_counts(pa.array([t for _, t in learned])))
    assert np.bincount(model.owner[model.nearest(langid.ngram_counts(pa.array([t for _, t in learned])))[0]]).min() >= 300

    def rejected(texts):
        counts = langid.ngram_counts(pa.array(texts))
        return model.too_far(counts, *model.nearest(counts)).mean()

    for n in (20, 60, 300, 900):
        assert rejected([say(spoken[k], n) for k in ("aa", "bb") for _ in range(50)]) == 0
        strange = of([a + b for a in "klmnpst" for b in "aiou"], 400)
        assert rejected([say(strange, n) for _ in range(50)]) >= 0.98
        assert rejected([say(["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n)], n) for _ in range(50)]) >= 0.98
        assert rejected(["".join(r.choice(letters) for _ in range(6 * n)) for _ in range(50)]) >= 0.98
        assert rejected(["".join(chr(r.randint(0xAC00, 0xD7A3)) for _ in range(3 * n)) for _ in range(50)]) >= 0.98


def test_texts_without_common_words_are_not_kept(spark):
    r = random.Random(4)
    common, letters = [f"c{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)], "abcdefghijklmnopqrstuvwxyz"
    rare = lambda: "".join(r.choice(letters) for _ in range(r.randint(5, 9)))
    # a third of the words are common ones, as in the real tables
    say = lambda n, share=0.35: " ".join(r.choice(common) if r.random() < share else rare() for _ in range(n))
    sizes = (60, 200, 200, 200, 900)
    clean = [(i, say(sizes[i % 5]), "en") for i in range(300)]
    strange = [(1000 + i, say(sizes[1 + i % 4], 0), None) for i in range(50)]
    docs = spark.createDataFrame(clean + strange, "doc_id long, text string, lang string")
    kept = {x["doc_id"]: x["kept"] for x in rules.judge(docs).collect()}
    assert all(kept[i] for i, *_ in clean)
    assert not any(kept[i] for i, *_ in strange)


def test_trees_are_walked_and_split_as_one_by_one():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)).astype(np.float32)
    x[:, 3] = r.integers(0, 3, 300)
    y = (x[:, 1] + 0.3 * x[:, 3] > 0.4).astype(float)
    forest = quality.fit(x, y, trees=7, depth=3)

    def walked(row):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.predict(x), [walked(row) for row in x])
    # one stump: the split of most gain among all values between bins, each tried by itself
    stump = quality.fit(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(j, t):
        left = x[:, j] <= t
        if h[left].sum() < 1 or h[~left].sum() < 1:
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 2.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 2.0)

    tried = [gain(j, t) for j in range(4) for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1]).astype(np.float32))]
    assert gain(stump.feature[0, 0], stump.threshold[0, 0]) == pytest.approx(max(tried))
    left = x[:, stump.feature[0, 0]] <= stump.threshold[0, 0]
    assert stump.leaf[0] == pytest.approx([-0.15 * g[s].sum() / (h[s].sum() + 2.0) for s in (left, ~left)])


def test_distances_as_by_definition():
    r = np.random.default_rng(6)
    p, q = r.integers(0, 9, (20, 7)).astype(float), r.integers(1, 9, (3, 7)).astype(float)
    p[p.sum(axis=1) == 0, 0] = 1
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)

    def plain(a, b):
        m = [(u + v) / 2 for u, v in zip(a, b, strict=True)]
        part = lambda c: sum(u * np.log2(u / w) for u, w in zip(c, m, strict=True) if u > 0)
        return max((part(a) + part(b)) / 2, 0.0) ** 0.5

    assert np.allclose(rules.distances(p, q), [[plain(a, b) for b in q] for a in p])


def test_host_ranks_by_plain_iteration(spark):
    r = random.Random(8)
    hosts = [f"h{i}" for i in range(30)]
    edges = {(r.choice(hosts), r.choice(hosts)): float(r.randint(1, 4)) for _ in range(90)}
    edges = {(a, b): n for (a, b), n in edges.items() if a != b}
    seeds = {"h0": (1.0, 0.0), "h1": (0.0, 1.0), "h2": (1.0, 0.0), "h3": (0.0, 1.0), "h4": (0.0, 0.0)}

    def plain(kind):
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        rank = {h: 0.15 * s[kind] for h, s in seeds.items()}
        for _ in range(12):
            following = {h: 0.15 * s[kind] for h, s in seeds.items()}
            for (a, b), n in edges.items():
                # both by the linking host's own share of links
                here, there = (a, b) if kind == 0 else (b, a)
                following[there] = following.get(there, 0.0) + 0.85 * rank.get(here, 0.0) * n / out[a]
            rank = following
        return rank

    got = urls.propagate(
        spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n double"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"),
    )
    got = {x["host"]: (x["trust"], x["distrust"]) for x in got.collect()}
    trust, distrust = plain(0), plain(1)
    for h in hosts:
        assert got.get(h, (0.0, 0.0)) == pytest.approx((trust.get(h, 0.0), distrust.get(h, 0.0)), abs=1e-12)


@pytest.mark.parametrize("n", [10, 1000, 5000])
def test_linkers_of_a_blocked_host_are_blocked_however_many(spark, n):
    """Linkers with all, half and a fiftieth of their links to the one blocked host."""
    made = spark.range(n).withColumn("k", F.col("id") % 3)
    link = lambda host, times: F.repeat(F.lit(f'<a href="http://{host}/1">x</a>'), times)
    html = F.when(F.col("k") == 0, link("bad.net", 1)).when(F.col("k") == 1, F.concat(link("bad.net", 1), link("other.test", 1))).otherwise(F.concat(link("bad.net", 1), link("other.test", 49)))
    pages = made.select("id", F.concat(F.lit("http://h"), "id", F.lit(".test/")).alias("url"), html.alias("html"))
    bad = spark.createDataFrame([(n, "http://bad.net/1", None), (n + 1, "http://other.test/", None)], "page_id long, url string, html string")
    out = urls.judge(bad.unionByName(pages.withColumnRenamed("id", "page_id"))).where(f"page_id < {n}").groupBy((F.col("page_id") % 3).alias("k"), "verdict").count().collect()
    assert {(r["k"], r["verdict"]) for r in out} == {(0, "block"), (1, "block"), (2, "allow")}


def test_equal_rules_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None)] * 3 + [(None, None, None)], "page_id long, url string, html string")
    tied = [urls.Rule("allow", "net", "/"), urls.Rule("block", "net", "/")]
    out = urls.judge(pages, tied).where("page_id = 1").collect()
    assert len(out) == 3 and {r["verdict"] for r in out} == {"allow"}


def test_secrets_of_an_empty_table_and_repeated_rows(spark, no_docs):
    assert secrets.scan(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "token=abcdefgh1")] * 2, "doc_id long, text string")
    assert [len(r["findings"]) for r in secrets.scan(twice).collect()] == [1, 1]


def test_nearest_centroid_one_by_one():
    r = random.Random(9)
    say = lambda sounds: " ".join("".join(r.choice(sounds) for _ in range(3)) for _ in range(80))
    learned = [("aa", say("the in ing er".split())) for _ in range(60)] + [("bb", say("sch ein ung ver".split())) for _ in range(60)]
    counts = langid.ngram_counts(pa.array([t for _, t in learned]))
    model = langid.fit([k for k, _ in learned], counts)
    best, cosine = model.nearest(counts)
    for i in range(0, 120, 7):
        row = [float(c) ** 0.5 * float(w) for c, w in zip(counts[i], model.idf, strict=True)]
        norm = sum(v * v for v in row) ** 0.5
        each = [sum(v * float(c) for v, c in zip(row, centre, strict=True)) / norm for centre in model.centroids]
        assert cosine[i] == pytest.approx(max(each), rel=1e-4) and each[best[i]] == pytest.approx(max(each), rel=1e-4)
        assert model.languages[model.owner[best[i]]] == learned[i][0]
