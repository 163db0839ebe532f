"""Lexical comparison of two statements: value differences, content difference, subject overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"([A-Za-z0-9$€£][A-Za-z0-9$€£.,:/%_+-]*)"
# Words that carry no content, and suffixes that are cut from words of three letters more.
FUNCTION_WORDS = (
    "a an the this that these those it its his her their our your my and or but nor so yet for to of in on at by with from as into onto over under within without across per via about "
    "is are was were be been being am do does did done has have had having will would shall should can could may might must not no if then than when while because since although "
    "though whether both each any all some only just also still even other another same such which who whom whose what where how there here now already always never ever one"
).split()
SUFFIXES = ["'s", "ies", "es", "s", "ed", "ing", "ly"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)


def differing(a: Column, b: Column) -> Column:
    """Tokens of one statement only."""
    return one_sided(tokens(a), tokens(b))


def one_sided(a: Column, b: Column) -> Column:
    """Tokens of one of two lists only."""
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def values(text: Column) -> Column:
    """The distinct numbers, versions, prices and acronyms of a statement, sorted."""
    return values_of(tokens(text))


def values_of(words: Column) -> Column:
    value = lambda t: t.rlike(r"\d|^[.,:/%_+-]*[A-Z][A-Z0-9]{1,5}[.,:/%_+-]*$")
    return F.sort_array(F.array_distinct(F.filter(words, value)))


def values_differ(a: Column, b: Column) -> Column:
    """Whether a number, version, price or acronym is in one statement only."""
    return values(a) != values(b)


def stems(lines: Column) -> Column:
    """A token in each line: its stem, or nothing for a function word."""
    bare = F.regexp_replace(F.lower(lines), r"""(?m)^[.,:;/%_+'"()\[\]-]+|[.,:;/%_+'"()\[\]-]+$""", "")
    # the longest suffix is tried first
    cut_off = F.regexp_replace(bare, rf"(?m)^(.{{3,}}?)({'|'.join(SUFFIXES)})$", "$1")
    return F.regexp_replace(cut_off, rf"(?m)^(?:{'|'.join(FUNCTION_WORDS)})$", "")


def content(text: Column) -> Column:
    """Stems of a statement's content words, repeats kept."""
    return content_of(tokens(text))


def content_of(words: Column) -> Column:
    # tokens hold no line breaks; all of a statement's are stemmed at once, since a lambda would be interpreted for each
    return F.array_remove(F.split(stems(F.array_join(words, "\n")), "\n"), "")


def numbered(words: Column) -> Column:
    """Words with the number of times they came before, so that the repeats of a multiset are entries of a set. ``words`` is named for
    each word: it should be a column, not an expression."""
    return F.transform(words, lambda w, i: F.concat(w, F.lit("\x01"), F.size(F.filter(F.slice(words, 1, i), lambda x: x == w)).cast("string")))


def numbered_overlap(a: Column, b: Column) -> Column:
    """``overlap`` of words that are numbered already, as once for each statement of many pairs."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared content words, repeats counted, over the longer statement's; 0 without words."""
    return numbered_overlap(numbered(a), numbered(b))


CUT = ["_words", "_values", "_stems"]


def cut(pieces: DataFrame, text: str) -> DataFrame:
    """Rows with CUT: tokens, values and content words of a text, each made once."""
    own = pieces.withColumn("_words", tokens(F.col(text)))
    return own.withColumns({"_values": values_of(F.col("_words")), "_stems": content_of(F.col("_words"))})


def stated(left: list[Column], right: list[Column]) -> list[Column]:
    """CUT of statements that are two texts with a blank between, from the CUT of both; their content words are yet to be numbered. No token holds a
    blank, so those of both follow each other, and texts that many statements share are cut once."""
    words, values, stems = zip(left, right, strict=True)
    return [F.concat(*words).alias(CUT[0]), F.sort_array(F.array_distinct(F.concat(*values))).alias(CUT[1]), F.concat(*stems).alias(CUT[2])]
