"""Fingerprints, collocations and fill-in-the-middle against brute force, on ordinary and awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import collocations, fill_middle, onebin_minhash

DOCS = "doc_id long, text string, lang string"
MANY = {c: 7 for c in ("fingerprint", "f", "l", "n", "phrase", "w0", "rank", "data", "_at", "_chunk", "_down", "_next", "form", "a b")}


def prose(seed, n, vocabulary=400):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, vocabulary, n))


ROWS = [
    (1, prose(1, 300), "en"), (2, prose(1, 300), "en"), (2, prose(1, 300), "en"), (2, prose(2, 80), "de"), (3, None, None), (4, "", "de"), (5, " \n\t ", "de"), (6, "One  two", "fr"),
    (7, "one two", "fr"), (8, prose(3, 30_000, 5000), "en"), (None, prose(4, 60), None), (9, "ÄÖ ß é 漢字 🙂 x. " * 9, "und"), (10, "a<P>b c d", "en"), (11, "tie tie tie, " * 60, "en"),
    (12, "x" * 50_000, "en"), (13, "<", "en"), (14, "a<S", "en"), (15, "New York city; new york State. " * 30, "en"), (-5, "minus one two three four", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward documents with more columns, some of them named like the operators' own."""
    return spark.createDataFrame(ROWS, DOCS).repartition(3).withColumns({c: F.lit(v) for c, v in MANY.items()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


# Fingerprints


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    wide = [found[i:i + 5] for i in range(len(found) - 4)] if len(found) >= 5 else [found] if found else []
    return {tuple(w) for w in wide}


def spark_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return signed(h)


def plain_print(text, bins):
    """Bins, permutations and digits one by one."""
    shift = 64 - (bins.bit_length() - 1)
    least = {}
    for s in shingles(text):
        h = spark_hash(s)
        at = (h >> shift) + bins // 2
        least[at] = min(least.get(at, h), h)
    if not least:
        return ""
    out = []
    for i, step in enumerate(onebin_minhash.steps(bins)):
        a, b, t, at = step & 0xFFFF, step >> 32, 0, i
        while at not in least:
            at, t = (a * t + b) % bins, t + 1
        out.append("%x" % (least[at] & 15))
    return "".join(out)


def plain_like(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / len(a) - 1 / 16) / (1 - 1 / 16))


@pytest.mark.parametrize("bins", [16, 512])
def test_op11_prints_equal_plain_python(docs, bins):
    got = docs.select("doc_id", "text", onebin_minhash.fingerprint(F.col("text"), bins).alias("fp")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.fp == plain_print(r.text, bins), r.doc_id


def test_op11_steps_are_permutations():
    for step in onebin_minhash.steps(64):
        a, inverse, b = step & 0xFFFF, step >> 16 & 0xFFFF, step >> 32
        assert sorted((a * t + b) % 64 for t in range(64)) == list(range(64)) and a * inverse % 64 == 1


def test_op11_estimates_the_jaccard_likeness(spark):
    base = prose(7, 400, 100_000).split()
    rows, true = [], {}
    for k in range(60):
        other = base[:400 - 6 * k] + prose(100 + k, 6 * k, 100_000).split()
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        rows.append((k, " ".join(base), " ".join(other)))
        true[k] = len(a & b) / len(a | b)
    frame = spark.createDataFrame(rows, "k long, a string, b string")
    p = [onebin_minhash.fingerprint(F.col(c)) for c in "ab"]
    got = frame.select("k", p[0].alias("a"), p[1].alias("b")).select("k", onebin_minhash.likeness(F.col("a"), F.col("b")).alias("e")).collect()
    miss = np.array([r.e - true[r.k] for r in got])
    assert abs(miss.mean()) < 0.02 and np.sqrt((miss**2).mean()) < 0.045
    assert {r.k: r.e for r in got}[0] == 1.0


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_op11_next_documents_over_chunk_borders(docs, empty, chunk):
    rows = sorted(((-1e30 if d is None else d, t or "") for d, t, _ in ROWS), key=lambda r: -r[0])
    got = onebin_minhash.compare_with_edits(docs, chunk).collect()
    assert len(got) == len(rows)
    twice = [i for i, (d, _) in enumerate(rows) if d == 2]  # texts of one id are ordered by their hash
    after = {}
    for i, (d, t) in enumerate(rows):
        n, nxt = rows[(i + 1) % len(rows)]
        if i not in twice and (i + 1) % len(rows) not in twice:
            edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
            fps = [plain_print(x, 512) for x in (t, edited, nxt)]
            after[d] = (len(t), edited, fps[0], fps[1], plain_like(fps[0], fps[1]), plain_like(fps[0], fps[2]))
    for r in got:
        d = -1e30 if r.doc_id is None else r.doc_id
        if d in after:
            assert tuple(r)[1:4] == after[d][:3] and r.edited_fingerprint == after[d][3]
            assert r.near_edited == pytest.approx(after[d][4]) and r.near_next == pytest.approx(after[d][5])
    assert sum(r.doc_id == 2 for r in got) == 3
    assert onebin_minhash.compare_with_edits(empty).count() == 0
    single = onebin_minhash.compare_with_edits(docs.filter("doc_id = 1")).first()
    assert single.near_next == 1.0


def test_op11_chunks_split_an_id_with_many_texts(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    dealt, window = onebin_minhash.in_order(many, 100)
    sizes = dealt.filter("_guest = 0").groupBy("_chunk").count().toPandas()["count"]
    assert sizes.sum() == 5000 and sizes.max() < 500
    led = dealt.withColumn("_n", F.lead("_hash").over(window)).filter("_guest = 0")
    assert led.filter("_n IS NULL").count() == 0 and led.select("_n").distinct().count() == 5000


# Collocations


def plain_collocations(rows, longest, least, top, inside):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = collections.defaultdict(list)
    big = {p: c for p, c in f.items() if len(p[1]) >= 2 and c >= least}
    longer = collections.Counter()
    for (lang, w), c in big.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i:i + k]] = max(longer[lang, w[i:i + k]], c)
    for (lang, w), a in big.items():
        if 100 * longer[lang, w] >= inside * a:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, hits in found.items() for i, (s, a, p, l, r) in enumerate(sorted(hits)[:top]))


@pytest.mark.parametrize("longest,least,top,inside", [(3, 10, 2000, 50), (4, 3, 25, 80), (2, 2, 5, 50)])
def test_op12_equals_brute_force(docs, empty, longest, least, top, inside):
    got = collocations.collocations(docs, longest, least, top, inside)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(ROWS, longest, least, top, inside)
    assert collocations.collocations(empty, longest, least, top, inside).count() == 0


def test_op12_products_beyond_64_bits(spark):
    a = spark.createDataFrame([("en", ["x", "y"], "x y", 4_000_000_000), ("en", ["x"], "x", 5_000_000_000), ("en", ["y"], "y", 7_000_000_001), ("en", [], "", 9 * 10**10)],
                              "lang string, words array<string>, phrase string, f long")
    row = collocations.ranked(a).first()
    assert row.score == 10**6 * 4_000_000_000**2 // (5_000_000_000 * 7_000_000_001)


# Fill-in-the-middle


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    plain = form == "plain"
    return (doc_id, len(u), form, None if plain else len(p), None if plain else len(m), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), out


def by_id(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("units", [1, 7, 4096])
def test_op13_equals_brute_force(docs, empty, monkeypatch, units):
    monkeypatch.setattr(fill_middle, "UNITS", units)
    use = docs if units > 1 else docs.filter("length(text) < 3000 OR text IS NULL")
    rows = [r for r in ROWS if units > 1 or not r[1] or len(r[1]) < 3000]
    got = by_id(tuple(r) for r in fill_middle.transform(use).collect())
    assert got == by_id(plain_fim(d, t)[0] for d, t, _ in rows)
    outs = by_id(tuple(r) for r in fill_middle.outputs(use).collect())
    assert outs == by_id((d, plain_fim(d, t)[0][2], plain_fim(d, t)[1]) for d, t, _ in rows)
    assert fill_middle.transform(empty).count() == 0 and fill_middle.outputs(empty).count() == 0


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_op13_restorer_finds_markers_over_any_border(form):
    p, m, s = b"ab<S<", b"<<", b"<M c<"
    whole = {"psm": b"<P>" + p + b"<S>" + s + b"<M>" + m, "spm": b"<S>" + s + b"<P>" + p + b"<M>" + m, "plain": p + m + s}[form]
    for width in range(1, len(whole) + 1):
        parse, parts = fill_middle.Restorer(form), collections.defaultdict(bytes)
        for i in range(0, len(whole), width):
            for part, data in parse.feed(whole[i:i + width]):
                parts[part] += data
        for part, data in parse.close():
            parts[part] += data
        assert parts[0] + parts[1] + parts[2] == p + m + s


def test_op13_many_documents_and_all_forms(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("A b, "), F.repeat(F.lit("xyz é "), (F.col("id") % 50).cast("int"))).alias("text"))
    got = by_id(tuple(r) for r in fill_middle.transform(frame).collect())
    want = by_id(plain_fim(r.doc_id, r.text)[0] for r in frame.collect())
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
