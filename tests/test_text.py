from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_window_counts(spark):
    sizes = {0: 0, 1: 1, 1100: 1, 1101: 2, 1200: 2, 2300: 3}
    docs = spark.createDataFrame([(str(n), " ".join(["w"] * n)) for n in sizes], "doc_id string, text string")
    found = {r["doc_id"]: r["count"] for r in chunking.chunk_words(docs).groupBy("doc_id").count().collect()}
    assert {n: found.get(str(n), 0) for n in sizes} == sizes


def test_breadcrumbs(spark):
    docs = spark.createDataFrame([("m", "intro\n# A\na\n## B\nb\n# C\nc")], "doc_id string, text string")
    paths = [r["heading_path"] for r in chunking.split_sections(docs).orderBy("section").collect()]
    assert paths == [[], ["A"], ["A", "B"], ["C"]]
    all_so_far = [r["heading_path"] for r in chunking.split_sections(docs, cumulative=True).orderBy("section").collect()]
    assert all_so_far == [[], ["A"], ["A", "B"], ["A", "B", "C"]]


def test_sections_keep_headings_without_text_and_make_no_chunk_of_them(spark):
    docs = spark.createDataFrame([("m", "# A\n## B\nb b b")], "doc_id string, text string")
    assert chunking.split_sections(docs).count() == 2
    assert [(r["position"], r["text"]) for r in chunking.chunk_sections(docs).collect()] == [(0, "b b b")]


def test_truncate(spark):
    assert one(spark, "ab. cd. ef", lambda c: T.truncate(c, 10)) == "ab. cd. ef"
    assert one(spark, "ab. cd. efg", lambda c: T.truncate(c, 10)) == "ab. cd."
    assert one(spark, "abcdefgh", lambda c: T.truncate(c, 5)) == "abcde"


def greedy(text, most):
    """The rule word for word."""
    if len(text) <= most:
        return text
    out = ""
    for s in text.split(". "):
        if len(out) + len(s) + 1 > most:
            break
        out += s + ". "
    return (out or text[:most]).strip(" ")


def test_truncate_follows_the_greedy_rule(spark):
    texts = ["a. bb. ccc. dddd. eeeee", "x" * 30, ". . . . . . . .", "one two. three four. five", "a.. b. c. d. e. f. g. h"]
    for most in (5, 8, 13):
        for t in texts:
            assert one(spark, t, lambda c: T.truncate(c, most)) == greedy(t, most), (t, most)


def test_titles(spark):
    assert one(spark, "x" * 100, T.clip_title) == "x" * 100
    assert one(spark, "x" * 101, T.clip_title) == "x" * 97 + "..."
    assert one(spark, " ", T.clip_title) == one(spark, None, T.clip_title) == "Untitled Topic"


def test_sentences(spark):
    assert one(spark, "Mr. Fox ran. He e.g. hid! Then?", T.sentences) == ["Mr. Fox ran.", "He e.g. hid!", "Then?"]
    assert one(spark, "", T.sentences) == [""]


def test_html(spark):
    page = "<html><head><title>x</title></head><script>no()</script><nav>n</nav><h2>Head</h2><p>a &amp; b<br>c</p><ul><li>i</li></ul></html>"
    assert one(spark, page, T.html_to_markdown) == "## Head\na & b\nc\n- i"


def test_no_chunker_shuffles(spark):
    docs = spark.createDataFrame([("m", "# A\na")], "doc_id string, text string")
    for f in (chunking.chunk_words, chunking.split_sections, chunking.chunk_sections):
        assert "Exchange" not in f(docs)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_sheet_are_numbered_by_many_tasks(spark, monkeypatch):
    from lexigrid.operators import chunking

    ranges = []
    write = chunking.materialise
    monkeypatch.setattr(chunking, "materialise", lambda df, label: ranges.append(write(df, label)) or ranges[-1])
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.lit("b")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.lit("a")).alias("d"), (999 - F.col("id")).alias("k"))
    got = chunking.numbered(rows, "d", ["k"], task_rows=50).collect()
    # the values of k are gone, so numbers must be those of all rows of a value once each
    for d, n in (("a", 800), ("b", 100), (None, 100)):
        assert sorted(r["i"] for r in got if r["d"] == d) == list(range(n))
    assert ranges[0].where("d = 'a'").selectExpr("shiftright(_m, 33)").distinct().count() > 4
    blocks = chunking.group_rows(rows, F.col("k").cast("string"), [F.col("k")], F.col("d"), 30).where("doc_id = 'b'").orderBy("position").collect()
    assert [t for b in blocks for t in b["text"].split("\n")] == [str(k) for k in range(9, 1000, 10)] and len(blocks) == 4
