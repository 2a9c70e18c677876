"""Words, phrases and text clean-up, all as built-in column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeboard.fixed_values import MARKUP_MARKERS, MAX_KEYWORD_WORDS, WORD_PATTERN


def words(text: Column) -> Column:
    """Lower-cased whole words of a text, in order; null text has no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def tokens(title: Column, fulltext: Column) -> Column:
    """The searchable word sequence of a notice: title and body as one sequence."""
    blank = F.lit("")
    return words(F.concat(F.coalesce(title, blank), F.lit(" "), F.coalesce(fulltext, blank)))


def spaced(word_list: Column) -> Column:
    """A word list as text in which every word has a space of its own on both sides, so adjacent
    phrases never share a separator and `contains` means "these words, adjacent, whole"."""
    return F.concat(F.lit(" "), F.array_join(word_list, "  "), F.lit(" "))


def has_phrase(spaced_text: Column, phrase_words: Column) -> Column:
    """Whole adjacent words; an empty phrase matches nothing."""
    return (F.size(phrase_words) > 0) & F.contains(spaced_text, spaced(phrase_words))


def phrase_match(token_list: Column, phrase: str | Column) -> Column:
    phrase_words = words(F.lit(phrase) if isinstance(phrase, str) else phrase)
    return has_phrase(spaced(token_list), phrase_words)


def any_phrase(token_list: Column, phrase_lists: Column) -> Column:
    """True when any phrase (array of word arrays) occurs; no phrases, no match."""
    text = spaced(token_list)
    return F.coalesce(F.exists(phrase_lists, lambda p: has_phrase(text, p)), F.lit(False))


def overlaps_itself(phrase_words: Column) -> Column:
    """Whether an occurrence of the phrase may start inside another one: some proper prefix of its
    words is also a suffix ('a b a')."""
    n = F.size(phrase_words)
    lengths = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))))
    return F.coalesce(F.exists(lengths, lambda i: F.slice(phrase_words, F.lit(1), i)
                               == F.slice(phrase_words, n - i + 1, i)), F.lit(False))


def phrase_count(spaced_text: Column, spaced_phrase: Column, overlaps: Column) -> Column:
    """Occurrences of a phrase, overlapping ones included. Plain removal counts phrases that cannot
    overlap themselves; the others need a look-ahead, which consumes nothing."""
    removed = F.replace(spaced_text, spaced_phrase, F.lit(""))
    plain = ((F.octet_length(spaced_text) - F.octet_length(removed))
             / F.octet_length(spaced_phrase)).cast("int")
    ahead = F.regexp_count(spaced_text, F.concat(F.lit("(?="), spaced_phrase, F.lit(")")))
    return F.when(overlaps, ahead).otherwise(plain)


def phrases(keywords: Column) -> Column:
    """Keywords to a disjunction of phrases: quotes become spaces, blank keywords drop out."""
    word_lists = F.transform(keywords, lambda k: words(F.replace(k, F.lit('"'), F.lit(" "))))
    return F.filter(word_lists, lambda p: F.size(p) > 0)


def python_strip(text: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def is_sentence(query: Column) -> Column:
    """Routing rule: more than three white-space separated words is a sentence."""
    return word_count(query) > MAX_KEYWORD_WORDS


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def leaked(text: Column) -> Column:
    """Whether a generated answer carries tool-call markup."""
    flag = F.lit(False)
    for marker in MARKUP_MARKERS:
        flag = flag | F.contains(text, F.lit(marker))
    return F.coalesce(flag, F.lit(False))


def strip_markup(text: Column) -> Column:
    """Plain prose of a generated answer: everything from the first leaked marker on is dropped,
    then bold marks, headings, horizontal rules and inline-code quotes go, in that order."""
    prose = F.coalesce(text, F.lit(""))
    for marker in MARKUP_MARKERS:
        prose = F.split_part(prose, F.lit(marker), F.lit(1))
    prose = F.replace(F.replace(prose, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    prose = F.regexp_replace(prose, r"(?mdU)^\s{0,3}#{1,6}\s*", "")
    prose = F.regexp_replace(prose, r"(?mdU)^\s*[-*_]{3,}\s*$", "")
    prose = F.regexp_replace(prose, r"`([^`]*)`", "$1")
    return python_strip(prose)
