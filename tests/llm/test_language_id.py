import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import language_id as L
from lexigrid.llm.common import read


def rare(spark, sf, most):
    """The documents, with ``most`` of the Spanish ones only."""
    docs = read(spark, sf, "documents")
    es = [r[0] for r in docs.where("lang = 'es'").select("doc_id").orderBy("doc_id").limit(most).collect()]
    return docs.where(F.coalesce(F.col("lang"), F.lit("")) != "es").unionByName(docs.where(F.col("doc_id").isin(es))), es


def test_a_language_that_few_texts_declare_is_a_class(spark, sf):
    for most in (17, 3):
        docs, es = rare(spark, sf, most)
        found = {r["doc_id"]: r for r in L.identify(docs).collect()}
        named = [i for i in es if found[i]["accepted"]]
        assert len(es) == most and len(named) >= 0.8 * most
        assert {found[i]["lang"] for i in named} == {"es"}
        kept = {r["doc_id"] for r in L.keep_identified(docs).select("doc_id").collect()}
        assert kept == {i for i, r in found.items() if r["accepted"]}


def test_a_thin_language_takes_no_texts_from_others(spark, sf):
    docs, es = rare(spark, sf, 2)
    other = L.identify(docs.where(~F.col("doc_id").isin(es))).where("accepted").select("doc_id", "lang").collect()
    found = {r["doc_id"]: r["lang"] for r in L.identify(docs).collect()}
    assert len(other) > 100 and sum(found[r["doc_id"]] != r["lang"] for r in other) <= 2


def test_without_any_declaration_texts_with_letters_are_kept(spark, sf):
    docs = read(spark, sf, "documents").withColumn("lang", F.lit(None).cast("string"))
    blank = docs.limit(1).withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit("12 34 ..."))
    found = L.identify(docs.unionByName(blank)).collect()
    assert {r["lang"] for r in found} == {"und"}
    kept = {r["doc_id"] for r in L.keep_identified(docs.unionByName(blank)).select("doc_id").collect()}
    assert len(kept) > 0.8 * docs.count() and -1 not in kept


def test_the_declared_language_of_a_page_with_a_long_head(spark):
    root = '<html class="x" lang="es-MX"><p>hola</p></html>'
    pages = ["<!-- " + "x" * 5000 + " -->" + root, "<!DOCTYPE html [" + " " * 3000 + "]>\n" + root, '<!-- <html lang="fr"> -->' + root, "<html><p>a</p></html>", None]
    df = spark.createDataFrame([(i, "http://a.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert {r["d"]: r["declared"] for r in L.page_evidence(df).collect()} == {0: "es", 1: "es", 2: "es", 3: None, 4: None}


def plain_trigrams(text):
    b = (text or "").lower().encode()
    letter = [c >= 128 or chr(c).isalpha() for c in b]
    c = [x if letter[i] else 32 for i, x in enumerate(b) if i == 0 or letter[i] or letter[i - 1]]
    out = []
    for x in zip(c, c[1:], c[2:]):
        if x != (32, 32, 32):
            out.append(((x[0] | x[1] << 8 | x[2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
    return out


TEXTS = ["the quick brown fox", "le renard brun saute", "12 ab 3", "", None, "é", "a", "the fox and the dog", "...", "el zorro y el perro", "x y z"]


def test_trigrams_are_those_of_a_plain_loop():
    got = {}
    for i, _, buckets, off in L.trigrams(pa.array(TEXTS)):
        for r in range(len(off) - 1):
            got[i + r] = buckets[off[r] : off[r + 1]].tolist()
    assert got == {i: plain_trigrams(t) for i, t in enumerate(TEXTS)}


def posteriors(rows):
    """By plain loops, from ``(text, declared, host, domain, suffix)``."""
    counts = defaultdict(lambda: defaultdict(float))
    for t, d, *_ in rows:
        for g in plain_trigrams(t) if d and d != L.UND and t is not None else []:
            counts[d][g] += 1
    names = sorted(counts)
    pooled = defaultdict(float)
    for c in counts.values():
        for g, n in c.items():
            pooled[g] += n
    whole = sum(pooled.values())

    def log_p(name, g):
        base = (pooled[g] + L.ADD) / (whole + L.ADD * L.BUCKETS)
        return math.log((counts[name][g] + L.LEAN * base) / (sum(counts[name].values()) + L.LEAN))

    ll = [[sum(log_p(n, g) for g in plain_trigrams(t)) for n in names] for t, *_ in rows]
    best = [max(range(len(names)), key=lambda i: (x[i], -i)) if plain_trigrams(r[0]) else None for x, r in zip(ll, rows)]

    def tally(key):
        out = defaultdict(lambda: [0.0] * len(names))
        for b, r in zip(best, rows):
            if b is not None and key(r) is not None:
                out[key(r)][b] += 1
        return out

    total = tally(lambda r: 0)[0]
    top = [(n + 1) / (sum(total) + len(names)) for n in total]
    smooth = lambda n, parent, k: [(x + k * p) / (sum(n) + k) for x, p in zip(n, parent)]
    domains = {k: smooth(n, top, L.KAPPA_DOMAIN) for k, n in tally(lambda r: r[3]).items()}
    hosts = {k[0]: smooth(n, domains.get(k[1], top), L.KAPPA_HOST) for k, n in tally(lambda r: (r[2], r[3]) if r[2] is not None else None).items()}
    out = []
    ties = {}
    for c in (1, 4):
        t = tally(lambda r: r[c])
        ties[c] = {v: [math.log((x + L.ADD) / (n + L.ADD * (len(t) + 1))) for x, n in zip(n_, total)] for v, n_ in t.items()}
    for (t, d, h, dom, suf), x in zip(rows, ll):
        if not plain_trigrams(t):
            out.append((L.UND, None))
            continue
        prior = hosts.get(h, top)
        more = [ties[c].get(v, [0.0] * len(names)) for c, v in ((1, d), (4, suf))]
        post = [math.log(p * (1 - L.UNKNOWN)) + sum(m[i] for m in more) + L.TEMPER * x[i] for i, p in enumerate(prior)]
        post.append(math.log(L.UNKNOWN) + sum(sum(m) / len(names) for m in more) - L.TEMPER * len(plain_trigrams(t)) * math.log(L.BUCKETS))
        i = max(range(len(post)), key=lambda i: (post[i], -i))
        out.append(([*names, L.UND][i], 1 / sum(math.exp(p - post[i]) for p in post)))
    return out


def test_posteriors_are_those_of_plain_loops(spark):
    words = {"en": "the quick brown fox jumps over the lazy dog", "fr": "le renard brun saute par dessus le chien", "es": "el zorro salta sobre el perro perezoso"}
    rows = []
    for i, (lang, text) in enumerate(words.items()):
        for k in range(6):
            w = text.split()
            t = " ".join(w[k % 3 :] + w[:k])
            rows.append((t, lang if k % 2 else (None if k else "xx"), f"h{(i + k) % 4}.site{i}.org", f"site{i}.org" if k else None, ["org", "com", None][k % 3]))
    rows += [("zzz qqq", None, None, None, None), ("", "en", "h1", None, "org"), (None, None, None, None, None), ("...", "fr", None, None, None)]
    df = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "d long, h long, text string, declared string, host string, domain string, suffix string").repartition(3)
    found = {r["d"]: (r["lang"], r["posterior"]) for r in L.fuse(df, L.train(df)).collect()}
    for i, (lang, p) in enumerate(posteriors(rows)):
        assert found[i][0] == lang, (i, found[i], lang)
        assert found[i][1] == (None if p is None else pytest.approx(p, rel=1e-4))


def test_many_languages(spark):
    rows = [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} noch eins", chr(97 + i % 26) + chr(97 + i // 26), "s", i) for i in range(220)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h int")
    assert L.identify(df).select("lang").distinct().count() > 100


def test_unclosed_elements_are_read_once(spark):
    page = "<html lang=fr><p>" + "<script " * 30_000 + "<!-- " * 30_000
    df = spark.createDataFrame([(1, "http://a.example/", page), (2, None, None)], "page_id long, url string, html string")
    assert {r["d"]: r["declared"] for r in L.page_evidence(df).collect()} == {1: "fr", 2: None}


def test_rows_and_empty_tables(spark, sf):
    docs = read(spark, sf, "documents")
    odd = docs.limit(2).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    more = docs.unionByName(odd).unionByName(docs.limit(1)).withColumn("best", F.lit(1)).withColumn("a.b", F.lit(2))
    assert L.identify(more).count() == more.count()
    kept = L.keep_identified(more)
    assert kept.columns == more.columns and kept.where("doc_id IS NULL").count() == 2
    assert L.identify(docs.limit(0)).count() == L.keep_identified(docs.limit(0)).count() == 0


def test_scores_of_a_batch_take_memory_of_its_blocks():
    import tracemalloc

    model = L.Model(list("abcde"), np.random.default_rng(3).integers(0, 50, (5, L.BUCKETS)).astype(float))
    column = pa.array(["some words of a text, one like the other " * 50] * 2000)
    tracemalloc.start()
    scores, n = model.score(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (scores == model.score(column[:1])[0]).all() and (n == n[0]).all()
    assert peak < 48 << 20
