"""Entities and relations from text, and their resolution by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import sentences
from lexigrid.shipping import extended, map_arrow

TRIES = 3
SPANS = "array<struct<text:string,label:string,score:double>>"
TRIPLES = "array<struct<h:string,r:string,t:string>>"
Spans = list[tuple[str, str, float]]
Triples = list[tuple[str, str, str]]

_capital = re.compile(r"\b[A-ZÀ-Þ][\w'-]+(?:\s+[A-ZÀ-Þ][\w'-]+)*")
_ORGANISATION = re.compile(r"(Inc|Ltd|GmbH|Corp|Bank|University|Agency|Ministry)\b")


def capitalised_spans() -> Callable[[list[str]], list[Spans]]:
    """Surrogate of a named-entity model: runs of capitalised words; a lone one that opens its sentence counts half."""

    def run(batch: list[str]) -> list[Spans]:
        out = []
        for s in batch:
            spans = []
            for m in _capital.finditer(s):
                score = 0.5 if m.start() == 0 and " " not in m.group() else 0.9
                spans.append((m.group(), "Organization" if _ORGANISATION.search(m.group()) else "Concept", score))
            out.append(spans)
        return out

    return run


def chained_triples() -> Callable[[str, Spans], Triples]:
    """Surrogate of a relation model: entities that follow each other in a sentence are related by the word between them."""

    def run(text: str, spans: Spans) -> Triples:
        names = list(dict.fromkeys(s for s, _, _ in spans))
        out = []
        for a, b in zip(names, names[1:]):
            i = text.find(a)
            j = text.find(b, i + len(a))
            between = text[i + len(a) : j].split() if i >= 0 and j >= 0 else []
            out.append((a, (between[0].strip(".,;:").upper() if between else "") or "RELATED_TO", b))
        return out

    return run


def ner_spans(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[Spans]]] = capitalised_spans, threshold: float = 0.5) -> DataFrame:
    """``chunks`` with ``spans`` of all sentences, in order; a chunk on which the model fails has none."""
    rows = chunks.select(F.struct(*[F.col(f"`{c}`") for c in chunks.columns]).alias("r"), sentences(F.col("text")).alias("s"))
    schema = extended(rows.select("r").schema, f"spans {SPANS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("score", pa.float64())]))
        for b in batches:
            out = []
            for sents in b.column("s").to_pylist():
                out.append([{"text": t, "label": k, "score": p} for t, k, p in _spans(model, sents, threshold)])
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array(out, kind)], ["r", "spans"])

    return map_arrow(rows, run, schema).select("r.*", "spans")


def extract_triples(chunks: DataFrame, load: Callable[[], Callable[[str, Spans], Triples]] = chained_triples, tries: int = TRIES) -> DataFrame:
    """``chunks`` (with ``spans``) with ``triples`` and ``extraction_successful``; after so many failures a chunk has none."""
    rows = chunks.select(F.struct(*[F.col(f"`{c}`") for c in chunks.columns]).alias("r"))
    schema = extended(rows.schema, f"triples {TRIPLES}, extraction_successful boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        kind = pa.list_(pa.struct([("h", pa.string()), ("r", pa.string()), ("t", pa.string())]))
        for b in batches:
            r = b.column("r")
            out = []
            for text, spans in zip(r.field("text").to_pylist(), r.field("spans").to_pylist()):
                found = _triples(model, text, [(s["text"], s["label"], s["score"]) for s in spans or []], tries)
                out.append([{"h": h, "r": k, "t": t} for h, k, t in found])
            yield pa.RecordBatch.from_arrays([r, pa.array(out, kind), pa.array([bool(x) for x in out])], ["r", "triples", "extraction_successful"])

    return map_arrow(rows, run, schema).select("r.*", "triples", "extraction_successful")


def triples_of(chunks: DataFrame, load_spans: Callable[[], Callable[[list[str]], list[Spans]]] = capitalised_spans, load: Callable[[], Callable[[str, Spans], Triples]] = chained_triples, by: str = "doc_id", threshold: float = 0.5, tries: int = TRIES) -> DataFrame:
    """``(by, h, r, t)``: the triples that ``extract_triples`` of ``ner_spans`` gives, for what needs no more of a chunk. Its text passes to Python once and doesn't come back."""
    rows = chunks.select(F.col(by).alias("d"), F.col("text").alias("t"), sentences(F.col("text")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, triples = load_spans(), load()
        for b in batches:
            at, out = [], []
            for i, (text, sents) in enumerate(zip(b.column("t").to_pylist(), b.column("s").to_pylist())):
                found = _triples(triples, text, _spans(spans, sents, threshold), tries)
                at.extend([i] * len(found))
                out.extend(found)
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(at, pa.int64())), *[pa.array(c, pa.string()) for c in cols]], [by, "h", "r", "t"])

    return map_arrow(rows, run, f"{by} {dict(chunks.dtypes)[by]}, h string, r string, t string")


def _spans(model: Callable[[list[str]], list[Spans]], sents: list[str] | None, threshold: float) -> Spans:
    try:
        return [x for spans in model([s for s in sents or [] if s]) for x in spans if x[2] >= threshold]
    except Exception:  # hints only: extraction goes on without them
        return []


def _triples(model: Callable[[str, Spans], Triples], text: str | None, spans: Spans, tries: int) -> Triples:
    for _ in range(tries):
        try:
            return model(text or "", spans)
        except Exception:  # the next try may succeed; a chunk that never does stays empty
            continue
    return []


def canonical(name: str) -> str:
    return re.sub(r"[^\w\s]", "", name.strip().lower())


def jaccard(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def greedy_names(names: list[str], ratio: float = 0.85, tokens: float = 0.9) -> dict[str, str]:
    """Each name to its display name. Canonical names are taken in order; the first representative that is close enough
    takes a name in, and the longer one of the two represents both from then on.

    Characters that two names share bound their ratio from above, so few pairs are matched at all.
    """
    by_canonical: dict[str, list[str]] = {}
    for n in names:
        by_canonical.setdefault(canonical(n), []).append(n)
    order = sorted(by_canonical)
    words = [frozenset(c.split()) for c in order]
    # unequal sets of words come that close only if both have so many
    wordy = max(0, int(tokens / (1 - tokens)) - 1) if tokens < 1 else 1 << 60
    members: list[list[str]] = []
    matchers: dict[int, SequenceMatcher] = {}  # by group, once it is asked
    rep_of: list[int] = []
    group_of: dict[int, int] = {}  # by representative
    by_words: dict[frozenset[str], set[int]] = {}
    long: set[int] = set()
    for at, near in enumerate(_alike(order, ratio)):
        c, own = order[at], words[at]
        by_ratio = {group_of[j] for j in near if j in group_of}
        by_token = set(by_words.get(own, ())) if own and tokens <= 1 else set()
        if len(own) >= wordy:
            by_token |= {i for i in long if jaccard(c, order[rep_of[i]]) >= tokens}
        for i in sorted(by_ratio | by_token):
            if i not in by_token:
                if i not in matchers:
                    matchers[i] = SequenceMatcher(None, "", order[rep_of[i]])
                matchers[i].set_seq1(c)
                if matchers[i].ratio() < ratio:
                    continue
            members[i].append(c)
            break
        else:
            i = len(members)
            members.append([c])
            rep_of.append(-1)
        if rep_of[i] < 0 or len(c) > len(order[rep_of[i]]):
            if rep_of[i] >= 0:
                del group_of[rep_of[i]]
                by_words[words[rep_of[i]]].discard(i)
                long.discard(i)
                matchers.pop(i, None)
            rep_of[i], group_of[at] = at, i
            by_words.setdefault(own, set()).add(i)
            if len(own) >= wordy:
                long.add(i)
    out = {}
    for group in members:
        surface = [n for c in group for n in by_canonical[c]]
        shown = max(surface, key=lambda n: (len(n), sum(ch.isupper() for ch in n), n))
        out.update(dict.fromkeys(surface, shown))
    return out


def _alike(names: list[str], ratio: float) -> Iterator[list[int]]:
    """For each name the places of those before it that share so many characters with it that ``ratio`` may be reached."""
    sizes = np.array([len(n) for n in names], np.int64)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.unique(codes, return_inverse=True)[1] % 64 if len(codes) else codes.astype(np.int64)
    width = int(letter.max()) + 1 if len(letter) else 1
    counts = np.bincount(np.repeat(np.arange(len(names)), sizes) * width + letter, minlength=len(names) * width).reshape(-1, width).astype(np.int32)
    i = 0
    while i < len(names):
        end = min(len(names), i + max(1, (1 << 20) // ((i + 64) * width)))
        shared = np.minimum(counts[i:end, None, :], counts[None, :end, :]).sum(axis=2, dtype=np.int64)
        total = sizes[i:end, None] + sizes[None, :end]
        near = (2.0 * shared / np.maximum(total, 1) >= ratio) | (total == 0)
        row, other = np.nonzero(near & (np.arange(end) < np.arange(i, end)[:, None]))
        cut = np.searchsorted(row, np.arange(end - i + 1))
        for k in range(end - i):
            yield other[cut[k] : cut[k + 1]].tolist()
        i = end


def coref(names: DataFrame, scope: str = "scope_id", name: str = "name", ratio: float = 0.85, tokens: float = 0.9) -> DataFrame:
    """``(scope, name, mapped)``: names of a scope that mean the same, by greedy clustering of one scope at a time."""
    listed = names.where(F.col(name).isNotNull()).groupBy(F.col(scope).alias("s")).agg(F.collect_set(name).alias("n"))
    kind = dict(names.dtypes)[scope]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, own, shown = [], [], []
            for i, n in enumerate(b.column("n").to_pylist()):
                m = greedy_names(sorted(n), ratio, tokens)
                at.extend([i] * len(m))
                own.extend(m)
                shown.extend(m.values())
            yield pa.RecordBatch.from_arrays([b.column("s").take(pa.array(at, pa.int64())), pa.array(own, pa.string()), pa.array(shown, pa.string())], [scope, name, "mapped"])

    return map_arrow(listed, run, f"{scope} {kind}, {name} string, mapped string")


def display_name(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``(by, display)``: the longest surface form, then the one with the most capitals, then the greatest."""
    capitals = F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))
    return rows.groupBy(by).agg(F.max_by(name, F.struct(F.length(name), capitals, F.col(name))).alias("display"))


def remap(triples: DataFrame, mapping: DataFrame, keys: list[str], name: str = "name", mapped: str = "mapped") -> DataFrame:
    """Triples ``(h, r, t)`` with both ends mapped; blank ends, self-loops and repeats go."""
    m = mapping.select(*keys, name, mapped)
    out = triples.join(m.select(*keys, F.col(name).alias("h"), F.col(mapped).alias("_h")), [*keys, "h"], "left").join(m.select(*keys, F.col(name).alias("t"), F.col(mapped).alias("_t")), [*keys, "t"], "left")
    out = out.select(*keys, F.coalesce("_h", "h").alias("h"), "r", F.coalesce("_t", "t").alias("t"))
    return out.where("trim(h) <> '' AND trim(t) <> '' AND h <> t").distinct()


def label_map(spans: DataFrame, order: list[str]) -> DataFrame:
    """``(name, label)``: the last label that any spelling of a name carries, by ``order``; lower-case forms are names too."""
    forms = spans.select(F.explode(F.array_distinct(F.array("text", F.lower("text")))).alias("name"), "label", F.struct(*order).alias("o"))
    return forms.groupBy("name").agg(F.max_by("label", F.struct("o", "label")).alias("label"))


def build(names: DataFrame, labels: DataFrame) -> DataFrame:
    """``(name, ontology_class, llm_type)`` of ``(name, llm_type)``: the label of the name, else of its lower case, else Concept."""
    n = names.groupBy("name").agg(F.min("llm_type").alias("llm_type")).withColumn("low", F.lower("name"))
    exact, low = labels.select("name", F.col("label").alias("l1")), labels.select(F.col("name").alias("low"), F.col("label").alias("l2"))
    out = n.join(exact, "name", "left").join(low, "low", "left")
    return out.select("name", F.coalesce("l1", "l2", F.lit("Concept")).alias("ontology_class"), "llm_type")


def mentions(chunks: DataFrame, triples: str = "triples", initial: str = "entities") -> DataFrame:
    """``(chunk_id, name)``: ends of a chunk's triples, or its initial entities where it has none."""
    ends = F.flatten(F.transform(triples, lambda x: F.array(x["h"], x["t"])))
    pick = F.when(F.size(triples) > 0, ends).otherwise(F.col(initial))
    return chunks.select("chunk_id", F.explode(F.array_distinct(pick)).alias("name")).where("trim(name) <> ''")


def string_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two columns; the order of the arguments matters."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)
