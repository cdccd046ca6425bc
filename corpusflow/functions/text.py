"""Text expressions: Column in, Column out, all within Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that strip() and rstrip() remove.
SPACE = " \t\n\r\x0b\x0c"
#: A word character in every language; Java's \\w knows ASCII alone.
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def paragraphs(text: Column) -> Column:
    """Non-blank parts between blank lines, stripped."""
    return F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts between white space that follows . ! ? and precedes A-Z, stripped and not blank."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Lower-case words of two characters or more, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD}{{2,}})"), F.lit(1))


def number_facts(text: Column) -> Column:
    """Distinct numbers, dates and amounts in a text: a digit, then digits and ,./%- up to a word's edge."""
    # a fact ends in a word character, or is followed by one; digits alone can end it here
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<!{WORD})(\d(?:[\d,./%-]*\d)?)(?!{WORD})"), F.lit(1)))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains one of the words as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w.lower()))
    return out


def runs(values: Column) -> Column:
    """Array of (value, n) of the distinct values of an array and how often each occurs, ascending; linear after the sort.
    Null for an empty array."""

    def ends(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1)))
        return let(last, lambda e: F.transform(e, lambda at, j: F.struct(F.get(s, at).alias("value"), (at - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("n"))))

    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, ends(s)))  # array_sort calls a lambda for each comparison


def token_f1(left: Column, right: Column) -> Column:
    """F1 of two bags of words, 0 without a common word. A bag is the set of its words with the number of the occurrence."""

    def numbered(tokens: Column) -> Column:
        each = F.flatten(F.transform(runs(tokens), lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda k: F.concat_ws("\x01", r["value"], k.cast("string")))))
        return F.coalesce(each, F.array().cast("array<string>"))

    def score(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        both = F.size(F.array_intersect(a, b))
        precision, recall = both / F.size(a), both / F.size(b)
        return F.when(both == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    return let(F.struct(numbered(word_tokens(left)).alias("a"), numbered(word_tokens(right)).alias("b")), score)


def is_refusal(answer: Column, phrase: str) -> Column:
    return F.contains(F.lower(answer), F.lit(phrase))
