"""The pipeline against a plain chain of the operators' brute-force versions."""

import random

import test_decontaminate
import test_line_dedup
import test_near_dedup
import tiktoken
from test_bpe import RANKS

import corpus_pipeline as P
from lexigrid.llm import bpe as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the house and water with people light because under which garden thought morning should nothing between".split(),
    "es": "el casa agua con gente luz porque debajo jardín mañana debería nada entre cuando siempre corazón".split(),
}
ITEM = "a quick question about seventeen purple elephants crossing the frozen river at midnight"


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "es"
        lines = [" ".join(rng.choice(WORDS[lang]) for _ in range(12)) for _ in range(3)]
        rows.append([i, "\n".join(lines), lang])
    first = rows[1][1].split("\n")
    rows[5][1] += "\n" + first[0] + "s"  # a line within one edit of an earlier one
    rows[7][1] = "\n".join(first)  # nothing is left of it
    # the same words in other lines: no line repeats, nearly all 3-grams do
    whole = rows[9][1].replace("\n", " ").split(" ")
    rows.append([40, " ".join(whole[:10]) + "\n" + " ".join(whole[10:]), "en"])
    rows[11][1] += " " + ITEM
    rows += [[41, None, "en"], [42, "12345 678", "en"], [43, "", None], [44, rows[4][1] + " nada", "es"]]
    return [(i, t, lang, "web", len(t or "")) for i, t, lang in rows]


def plain(rows):
    """``{doc_id: text}`` of what is left. Declared texts with letters are in a language of the table."""
    docs = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    docs = sorted(test_line_dedup.brute(docs))
    texts = [t for _, t in docs]
    copies = {i for i, _ in test_near_dedup.groups(texts, test_near_dedup.share_a_table(texts))}
    docs = [d for k, d in enumerate(docs) if k not in copies]
    leaks = {i for i, *_ in test_decontaminate.brute(docs, [(0, ITEM)])}
    return {i: t for i, t in docs if i not in leaks}


def write(spark, home, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")


def test_pipeline_is_the_chain_of_plain_versions(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows, [(0, ITEM)])
    want = plain(rows)
    assert set(want) == set(range(45)) - {7, 11, 40, 41, 42, 43}
    got = P.run(spark, str(tmp_path)).collect()
    enc = tiktoken.Encoding("x", pat_str=B.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert {r["doc_id"]: r["token_ids"] for r in got} == {i: enc.encode_ordinary(t) for i, t in want.items()}
    assert len(got) == len(want) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert P.run(spark, str(tmp_path)).count() == 0
