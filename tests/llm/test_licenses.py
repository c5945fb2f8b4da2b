import random

from lexigrid.llm import licenses as L

MIT = L.TEMPLATES["MIT-text"]


def scan(text):
    return [(name, missing + extra) for name, _, _, _, missing, extra in L.scan_text(text, L.Templates(L.TEMPLATES))]


def test_an_altered_notice_before_an_exact_one_is_found():
    altered = MIT.replace("deal in the", "deal with the")
    text = "\n\n".join([altered, MIT, altered, MIT])
    got = [x for x in scan(text) if x[0] == "MIT-text"]
    assert [d > 0 for _, d in got] == [True, False, True, False]
    for key in ("BSD-clauses", "GPL-3.0-notice"):
        words = L.TEMPLATES[key].split()
        words[9] = "otherwise"
        assert [x[0] for x in scan(" ".join(words) + "\n" + L.TEMPLATES[key])] == [key, key]


def test_places_do_not_overlap():
    found = L.scan_text(" ".join([MIT] * 5), L.Templates(L.TEMPLATES))
    assert len(found) == 5 and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_a_wrapped_cue_is_a_cue(spark):
    texts = ["All rights\nreserved.", "# All rights\n# reserved.", "All  rights   reserved.", "all right reserved", None, ""]
    rows = L.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [(i, "All-rights-reserved") for i in range(3)]


T = L.Templates(L.TEMPLATES)


def without_compression(text):
    """Every template is confirmed on every block."""

    class All(L.Templates):
        def ranked(self, block, short):
            return [(1.0, 0.0, k) for k in sorted(self.words) if (k in self.short) == short]

    return [(n, a, b, m, x) for n, a, b, _, m, x in L.scan_text(text, All(L.TEMPLATES))]


def corpus(seed, n=60):
    rng = random.Random(seed)
    prose = "once upon a time a small boat left the harbour and nobody knew the license of its captain or any copyright in free software".split()
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [rng.choice(prose) for _ in range(rng.randrange(0, 60))]
            words = L.TEMPLATES[rng.choice(sorted(L.TEMPLATES))].split()
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(prose)
            parts += words if rng.random() < 0.7 else words[: len(words) // 2]
        yield " ".join(parts + [rng.choice(prose) for _ in range(20)])


def test_compression_loses_no_place_that_words_confirm():
    found = 0
    for text in corpus(3):
        got = [(n, a, b, m, x) for n, a, b, _, m, x in L.scan_text(text, T)]
        assert got == without_compression(text), text
        found += len(got)
    assert found > 60


def test_compression_excludes_most_templates():
    tried = kept = 0
    for text in corpus(4):
        spans = L.word_spans(text)
        for short in (True, False):
            for lo, hi in L.blocks(spans, text, (L.SHORT if short else T.longest) + L.AROUND):
                tried += sum((k in T.short) == short for k in T.words)
                kept += len(T.ranked([w for w, _, _ in spans[lo:hi]], short))
    assert kept < 0.5 * tried


def test_each_template_is_found_in_its_own_text():
    for name, text in L.TEMPLATES.items():
        assert (name, 0) in [(n, d) for n, d in scan("Before it. " + text + " After it.")], name


def test_rows(spark):
    text = L.TEMPLATES["MIT"]
    rows = [(None, text, 1, 2), (1, None, 1, 2), (2, "", 1, 2), (3, text, 1, 2), (3, text, 1, 2), (4, "plain", 1, 2), (5, "word " * 300_000 + text, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int, `a.b` int")
    got = sorted(((r["doc_id"], r["license"], r["start"]) for r in L.find_licenses(df).collect()), key=repr)
    assert got == sorted([(None, "MIT", 0), (3, "MIT", 0), (3, "MIT", 0), (5, "MIT", 1_500_000)], key=repr)
    assert L.find_licenses(df.limit(0)).count() == 0
