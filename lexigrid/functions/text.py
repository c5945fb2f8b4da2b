"""Text expressions. All of them work within a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space comes first, so that what must precede it is looked at there only.
SENTENCE_BREAK = r"(?U)\s(?<=[.?!]\s)(?<!\w\.\w.\s)(?<![A-Z][a-z]\.\s)"


def words(text: Column) -> Column:
    """Words between white space; null stays null."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def windows(word_list: Column, size: int, overlap: int) -> Column:
    """Texts of ``size`` words that start every ``size - overlap`` words; none for no words.

    Give it a column, not an expression: it is looked at once for each window.
    """
    step = max(1, size - overlap)
    n = F.size(word_list)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(word_list, s + 1, size), " "))


def sentences(text: Column) -> Column:
    """Trimmed sentences that are not empty; the whole text where there are none."""
    found = F.filter(F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def truncate(text: Column, most: int) -> Column:
    """Whole sentences that fit into ``most`` characters; a hard cut where not even the first one does.

    The greedy sum over sentences ends at the last ". " within ``most + 1`` characters, so one
    match over that prefix finds it, however long the text is.
    """
    whole = F.regexp_extract(text.substr(1, most + 1), r"(?s)^.*\. ", 0)
    cut = F.when(whole != "", whole).otherwise(text.substr(1, most))
    return F.when(F.length(text) <= most, text).otherwise(F.trim(cut))


def clip_title(title: Column, most: int = 100) -> Column:
    short = F.when(F.length(title) > most, F.concat(title.substr(1, most - 3), F.lit("..."))).otherwise(title)
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", F.lit("Untitled Topic")).otherwise(short)


def excerpt(text: Column, most: int = 300) -> Column:
    return text.substr(1, most)


def canonical_name(name: Column) -> Column:
    """Lower case, no punctuation, trimmed."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s]", "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of the two; 0 where either has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def html_to_markdown(html: Column) -> Column:
    """Main content of a page: chrome goes, headings become ``#`` lines, blocks end lines, entities are resolved.

    The patterns use what Java's regex engine and RE2 share.
    """
    t = html
    for tag in ("script", "style", "nav", "footer", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"[\r\n]+", " ")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?i)</h[1-6]\s*>|</?(p|div|article|ul|ol|table|tr|br)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"<[^<>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def sql_html_to_markdown(html: str) -> str:
    """The same chain as DuckDB SQL."""
    t = html

    def sub(pattern: str, by: str) -> str:
        quoted, to = pattern.replace("'", "''"), by.replace("'", "''").replace("\n", "' || chr(10) || '")
        return f"regexp_replace({t}, '{quoted}', '{to}', 'g')"

    for tag in ("script", "style", "nav", "footer", "head"):
        t = sub(rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = sub(r"(?s)<!--.*?-->", " ")
    t = sub(r"[\r\n]+", " ")
    for level in range(1, 7):
        t = sub(rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = sub(r"(?i)</h[1-6]\s*>|</?(p|div|article|ul|ol|table|tr|br)\b[^>]*>", "\n")
    t = sub(r"(?i)<li\b[^>]*>", "\n- ")
    t = sub(r"<[^<>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = "replace({}, '{}', '{}')".format(t, entity, sign.replace("'", "''"))
    t = sub(r"[ \t]+", " ")
    t = sub(r" ?\n[ \n]*", "\n")
    return f"trim({t}, ' ' || chr(10))"
