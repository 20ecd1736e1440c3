"""Text expressions: tokens, identities, segments, paragraphs, sentences and mentions; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic (fixed values).
STOP_WORDS = ("about", "does", "from", "have", "that", "their", "there", "these", "this", "what", "when", "where", "which", "with")

#: Letters and numbers of Unicode 14 and 15, which \p{L} and \p{N} of Java 17 lack.
_LATER = """
870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9
a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc
10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02
11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3
1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad
1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af
"""
#: Letters and numbers, within the brackets of a pattern. Java looks behind by whole characters, not halves of pairs, only
#: where the pattern has such characters themselves, not their numbers.
LETTERS = "\\p{L}\\p{N}" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _LATER.split())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def query_tokens(text: str) -> list[str]:
    """Terms of a query: ASCII letters and digits, in order, repeats kept."""
    return [t.lower() for t in re.findall(r"[A-Za-z0-9]+", text)]


def index_tokens(text: Column | str) -> Column:
    """Terms of an indexed text: runs of letters and digits of any script, lower-cased, common accents folded."""
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    folded = F.translate(F.lower(F.coalesce(_col(text), F.lit(""))), accented, plain)
    return F.array_remove(F.split(folded, "[^\\p{L}\\p{N}]+"), "")


def lower(text: Column | str) -> Column:
    """Lower case, one character for each: a dotted capital I becomes i, without the mark that F.lower puts after it."""
    return F.lower(F.replace(_col(text), F.lit("\u0130"), F.lit("i")))


def token_set(text: Column | str) -> Column:
    """Distinct lower-case words of letters, digits and hyphens."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), "[^\\p{L}\\p{N}_-]+"), ""))


def has_word(text: Column | str, words: tuple[str, ...], inner: str = f"{LETTERS}_-") -> Column:
    """Whether a text has one of the lower-case words, of `inner` characters, by itself; without a split of the text."""
    one = "|".join(words)  # looked for first, as a look at the character before is dearer
    return lower(text).rlike(f"(?={one})(?<![{inner}])(?:{one})(?![{inner}])")


def topic_terms(text: Column | str, least: int = 4, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of at least so many letters that are not stop words, in order."""
    return F.filter(token_set(text), lambda w: (F.length(w) >= least) & ~w.isin(list(stop)))


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "\\s+", " "))


def label(text: Column | str) -> Column:
    """A column label for comparison: without a parenthesised unit, lower-case, other characters as spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(_col(text), "\\([^)]*\\)", "")), "[^a-z0-9]+", " "))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix-<16 hex digits> of the joined parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256), 1, 16))


def windows(text: Column | str, width: int, step: int, least: int = 1) -> Column:
    """array<struct<start,end,text>> of windows over the stripped text; offsets count from 0, short ones are left out."""
    t = F.trim(F.coalesce(_col(text), F.lit("")))
    n = F.length(t)
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.struct(i.alias("start"), F.least(i + width, n).alias("end"), F.substring(t, i + 1, F.lit(width)).alias("text"))))
    made = F.coalesce(made, F.array().cast("array<struct<start:int,end:int,text:string>>"))
    return F.filter(made, lambda w: F.length(F.trim(w["text"])) >= least)


def paragraphs(text: Column | str) -> Column:
    return F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\n[ \t]*\n|\n"), lambda p: F.trim(p))


def sentences(text: Column | str) -> Column:
    """Runs that end in a full stop, question or exclamation mark. The mark is optional in the pattern and asked for
    afterwards: a long line without one is then read once, not once from each of its characters."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("[^.!?\n]+[.!?]?"), F.lit(0))
    return F.filter(F.transform(F.filter(found, lambda s: F.substring(s, -1, 1).isin(".", "!", "?")), lambda s: F.trim(s)), lambda s: s != "")


def first_label(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule (label, pattern) that a text matches, without regard to case."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def all_labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all rules (label, pattern) that a text matches, in the rules' order; a pattern sets its own flags."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]))


def mentions(text: Column, alias: Column) -> Column:
    """Whether an alias occurs as whole words, hyphens counted as part of a word."""
    quoted = F.regexp_replace(F.lower(alias), "([\\\\.^$|?*+()\\[\\]{}-])", "\\\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![\\p{L}\\p{N}-])"), quoted, F.lit("(?![\\p{L}\\p{N}-])")))
