"""Language ID by Bayesian evidence fusion.

The posterior over languages of a text combines

* the likelihood of its letter trigrams (hashed, under counts of every labelled text),
* how often texts of a language carry the declared markup language at hand,
* how often they carry the address suffix at hand,
* the prior of the host, smoothed towards its domain, which is smoothed towards the whole.

All of these are counted over the whole input by grouped aggregation; which
language a text counts for is decided by its trigrams alone. Beside the
languages there is ``und``, for which every trigram is as likely as any other. Every declared
language is one of the languages, however few texts declare it. Where nothing is declared, all texts
together are the only language, and it has no name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import beside, id_of, packed, row_key, runs, unpacked, utf8
from lexigrid.shipping import map_arrow
from lexigrid.storage import materialise

BUCKETS = 1 << 15
#: Bytes looked at at once: each takes some hundred bytes where six languages are told apart.
BLOCK = 1 << 18
#: Trigrams overlap, so each counts for less than an independent witness would.
TEMPER = 0.4
KAPPA_DOMAIN = 20.0
KAPPA_HOST = 10.0
ADD = 0.5
#: So many trigrams laid out like those of all labelled texts are added to each language's own: a thin language leans on them.
LEAN = 4096.0
UNKNOWN = 0.01
ACCEPT = 0.5
UND = "und"

_letter = np.zeros(256, bool)
_letter[128:] = True
_letter[[c for c in range(128) if chr(c).isalpha()]] = True


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges ``i:j`` the trigram buckets end to end, and the offset of each row. A word is framed by blanks."""
    whole, offsets = utf8(pc.utf8_lower(column))
    for i, j in runs(offsets, BLOCK):
        b, off = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        solid = _letter[b]
        # what is not a letter becomes one blank, and each row starts with one
        first = np.zeros(len(b) + 1, bool)
        first[off] = True
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        keep[off[:-1][off[:-1] < len(b)]] = True
        total = np.zeros(len(b) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        c = np.where(solid, b, 32)[keep].astype(np.uint32)
        o = total[off]
        if len(c) < 3:
            yield i, j, np.zeros(0, np.int32), np.zeros(j - i + 1, np.int64)
            continue
        code = c[:-2] | (c[1:-1] << 8) | (c[2:] << 16)
        bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int32)
        row = np.repeat(np.arange(j - i), np.diff(o))
        good = row[:-2] == row[2:]
        # a trigram without letters says nothing
        good &= (c[:-2] != 32) | (c[1:-1] != 32) | (c[2:] != 32)
        yield i, j, bucket[good], np.searchsorted(row[:-2][good], np.arange(j - i + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of trigrams by declared language, of all the batches of a partition."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column("declared").to_pylist()
        for i, _, buckets, off in trigrams(batch.column("text")):
            size = np.diff(off)
            here = np.array(names[i : i + len(size)], dtype=object)
            for name in set(here.tolist()):
                table = tables.setdefault(name, np.zeros(BUCKETS, np.int64))
                table += np.bincount(buckets[np.repeat(here == name, size)], minlength=BUCKETS)
    for name, table in tables.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["declared", "bucket", "n"])


class Model:
    """Log likelihood of each trigram under each language; ``und`` comes last. Takes 128 KB a language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = [*languages, UND]
        pooled = (counts.sum(axis=0) + ADD) / (counts.sum() + ADD * BUCKETS)
        p = (counts + LEAN * pooled) / (counts.sum(axis=1, keepdims=True) + LEAN)
        self.log = np.vstack([np.log(p), np.full((1, BUCKETS), -np.log(BUCKETS))]).T.astype(np.float32).copy()

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, languages)`` tempered log likelihoods, and the number of trigrams of each row."""
        out = np.zeros((len(column), len(self.languages)))
        n = np.zeros(len(column), np.int64)
        for i, j, buckets, off in trigrams(column):
            size = np.diff(off)
            n[i:j] = size
            full = np.flatnonzero(size)
            if len(full):
                out[i + full] = np.add.reduceat(self.log[buckets].astype(np.float64), off[full], axis=0)
        return TEMPER * out, n


def train(pool: DataFrame) -> Model:
    """Counts of every labelled text, of all texts where none is labelled. What reaches the driver is bounded by languages times buckets."""
    texts = pool.where("text IS NOT NULL").select(F.when(F.col("declared") != UND, F.col("declared")).alias("declared"), "text")

    def counted(rows: DataFrame) -> pd.DataFrame:
        counts = map_arrow(rows, _count, "declared string, bucket int, n long")
        return counts.groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()

    got = counted(texts.where("declared IS NOT NULL"))
    if not len(got):
        got = counted(texts.withColumn("declared", F.lit(UND)))
    # a language all of whose texts lack letters has no counts and is none
    names = sorted(got["declared"].unique())
    table = np.zeros((len(names), BUCKETS))
    table[got["declared"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"]
    return Model(names, table)


def subtag(c: Column) -> Column:
    """The primary language subtag in lower case; null where there is none."""
    s = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(s != "", s)


def document_evidence(docs: DataFrame) -> DataFrame:
    """``(d, h, text, declared, host, domain, suffix)``: ``lang`` is the declared language and ``source`` the host."""
    rows = docs.select(row_key().alias("k"), "text", subtag(F.col("lang")).alias("declared"), F.col("source").cast("string").alias("host"))
    return rows.select("k.d", "k.h", "text", "declared", "host", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """The same of web pages: text without markup, the ``lang`` of the root element, and the parts of the address.

    An element or comment that is never closed reaches to the end of the page, so that a page is read once.
    """
    html = F.col("html")
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"&[#A-Za-z0-9]+;", " ")
    # wherever the root element starts, but not in a comment
    declared = subtag(F.regexp_extract(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " "), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(row_key("page_id", "html").alias("k"), text.alias("text"), declared.alias("declared"), F.when(host != "", host).alias("host"))
    return rows.select("k.d", "k.h", "text", "declared", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract("host", r"\.([^.]+)$", 1).alias("suffix"))


def _scores(pool: DataFrame, model: Model) -> DataFrame:
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.languages)
        for batch in batches:
            s, n = m.score(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, width), pa.int32()), pa.array(s.ravel()))
            best = pa.array(np.where(n > 0, s[:, :-1].argmax(axis=1) if width > 1 else 0, -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "h", "declared", "host", "domain", "suffix")] + [lists, best, pa.array(n)], ["d", "h", "declared", "host", "domain", "suffix", "ll", "best", "n"])

    return map_arrow(pool, run, "d long, h long, declared string, host string, domain string, suffix string, ll array<double>, best int, n long")


def _tally(scored: DataFrame, by: list[str], width: int) -> DataFrame:
    """Texts by language for each value of ``by``: one array, in the order of the model."""
    known = scored.where(F.col("best") >= 0)
    for c in by:
        known = known.where(F.col(c).isNotNull())
    # by value and language first: one row each, however many languages there are
    counts = known.groupBy(*by, "best").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pivot = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("m"))
    return pivot.select(*by, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("n"))


def fuse(pool: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``(d, h, lang, posterior, declared, accepted)`` for each row of the evidence.

    ``lang`` is ``und`` with posterior null where the text has no letters. ``accepted``: a
    language of the model has a posterior of at least ``accept``. The one language of a table without any
    declaration is called ``und`` as well; accepted are the texts that fit it better than chance.
    """
    width = len(model.languages) - 1
    scored = materialise(_scores(pool, model), "scores")
    if width == 0:
        return scored.select("d", "h", F.lit(UND).alias("lang"), F.lit(None).cast("double").alias("posterior"), "declared", F.lit(False).alias("accepted"))
    zeros = F.array(*[F.lit(0.0)] * width)
    whole = np.array(_tally(scored.withColumn("all", F.lit(1)), ["all"], width).select("n").first() or [[0.0] * width])[0]
    prior = (whole + 1.0) / (whole.sum() + width)
    top = F.array(*[F.lit(float(x)) for x in prior])
    total = F.array(*[F.lit(float(x)) for x in whole])

    def smoothed(n: Column, parent: Column, kappa: float) -> Column:
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda x, p: (x + F.lit(kappa) * p) / (size + F.lit(kappa)))

    domains = _tally(scored, ["domain"], width).select("domain", smoothed(F.col("n"), top, KAPPA_DOMAIN).alias("of_domain"))
    hosts = _tally(scored.withColumn("domain", F.coalesce("domain", F.lit(""))), ["host", "domain"], width).join(domains, "domain", "left")
    hosts = materialise(hosts.select("host", smoothed(F.col("n"), F.coalesce("of_domain", top), KAPPA_HOST).alias("of_host")), "hosts")

    def likelihood(column: str) -> DataFrame:
        """log P(value | language), smoothed over the values seen and one unseen."""
        t = _tally(scored, [column], width)
        values = t.count() + 1
        return materialise(t.select(column, F.zip_with("n", total, lambda x, n: F.log((x + F.lit(ADD)) / (n + F.lit(ADD * values)))).alias(f"of_{column}")), column)

    out = scored
    for column, table in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", hosts)):
        out = out.join(beside(table, 8 * width + 32), column, "left")
    logs = F.transform(F.coalesce("of_host", top), lambda p: F.log(p * F.lit(1 - UNKNOWN)))
    for column in ("of_declared", "of_suffix"):
        logs = F.zip_with(logs, F.coalesce(column, zeros), lambda a, b: a + b)
    # und says nothing of declarations and addresses: it takes the mean language's odds
    und = F.log(F.lit(UNKNOWN)) + sum((F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / width, F.lit(0.0)) for c in ("of_declared", "of_suffix")), F.lit(0.0))
    out = out.withColumn("post", F.zip_with(F.concat(logs, F.array(und)), "ll", lambda a, b: a + b))
    out = out.withColumn("top", F.array_max("post"))
    out = out.withColumn("sum", F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    names = F.array(*[F.lit(x) for x in model.languages])
    place = F.array_position("post", F.col("top")).cast("int")
    lang = F.when(F.col("n") > 0, F.element_at(names, place)).otherwise(F.lit(UND))
    posterior = F.when(F.col("n") > 0, 1 / F.col("sum"))
    accepted = (place <= width) & (F.coalesce(posterior, F.lit(0.0)) >= accept)
    return out.select("d", "h", lang.alias("lang"), posterior.alias("posterior"), "declared", accepted.alias("accepted"))


def identify(docs: DataFrame | None = None, pages: DataFrame | None = None, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, page_id, lang, posterior, declared, accepted)``, one row for each row of either table.

    Texts without letters, null ones among them, are ``und`` and not accepted. Null declarations,
    sources and addresses are no evidence. Ties go to the language that
    comes first in the alphabet. Rows that repeat id and text count as often as they are there, null ids stay null. Texts of any
    length are read whole, extra columns are not read, and empty tables give no rows.
    """
    parts = []
    if docs is not None:
        parts.append(document_evidence(docs).withColumn("host", F.concat(F.lit("doc "), "host")))
    if pages is not None:
        parts.append(page_evidence(pages))
    model = train(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    none = F.lit(None).cast("long")
    out = []
    for k, part in enumerate(parts):
        is_doc = docs is not None and k == 0
        found = fuse(part, model, accept)
        key = id_of(F.col("d"))
        out.append(found.select((key if is_doc else none).alias("doc_id"), (none if is_doc else key).alias("page_id"), "lang", "posterior", "declared", "accepted"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def keep_identified(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows whose language is not accepted; all columns stay as they are, whatever their names.

    Texts that are null, empty or without letters go; of repeated rows all stay or none. An empty table stays empty, and without
    any declaration all texts with letters that fit the table better than chance stay.
    """
    pool = document_evidence(docs)
    found = fuse(pool, train(pool), accept)
    gone = materialise(found.where("NOT accepted").select("d", "h").distinct(), "rejected")
    gone = beside(gone)
    rows = packed(docs).withColumn("k", row_key(F.col("r.doc_id"), F.col("r.text")))
    return unpacked(rows.join(gone, (F.col("k.d") == gone.d) & (F.col("k.h") == gone.h), "left_anti"))
