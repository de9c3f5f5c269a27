"""Column expressions over log lines and templates. All stay in the JVM.

A template is text with wildcards `<*>`; a truncated `<*` counts as one too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "<*>"
_ANY_WORD = "[a-zA-Z0-9]"


def content(line: Column) -> Column:
    """A line without surrounding white space, pairs of blanks made one in a single pass."""
    return F.replace(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit("  "), F.lit(" "))


def mask(text: Column) -> Column:
    """Blank-separated tokens with a digit become wildcards.

    One regular expression over the whole text: it only starts at a token's
    first character, so a token is looked at once.
    """
    return F.regexp_replace(text, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", "<*>")


def char_classes(text: Column) -> Column:
    """Sorted classes of the characters: 'digit', 'alpha', or the character itself."""
    none = F.array().cast("array<string>")
    other = F.array_distinct(F.split(F.regexp_replace(text, r"[\p{L}\p{Nd}]", ""), ""))
    return F.array_sort(F.concat(F.when(text.rlike(r"\p{Nd}"), F.array(F.lit("digit"))).otherwise(none), F.when(text.rlike(r"\p{L}"), F.array(F.lit("alpha"))).otherwise(none), F.array_remove(other, "")))


def _tokens(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda t: F.when(t == "<*", WILD).otherwise(t))


def chars(template: Column) -> Column:
    """Characters, with wildcards as one token."""
    return _tokens(template, r"(?s)<\*>?|.")


def words(template: Column) -> Column:
    """Runs of letters and digits; any other character and a wildcard are tokens of their own."""
    return _tokens(template, r"(?s)<\*>?|[\p{L}\p{N}]+|.")


def index_tokens(template: Column) -> Column:
    """Runs of letters, digits and . _ / -; only a full wildcard is fused.

    Never fails on texts that begin with `>` or `*>`.
    """
    return F.regexp_extract_all(template, F.lit(r"(?s)<\*>|[\p{L}\p{N}._/-]+|."), F.lit(0))


def alpha_tokens(template: Column) -> Column:
    """Index tokens made of letters only: whole runs, found without making the tokens between them."""
    return F.regexp_extract_all(template, F.lit(r"(?<![\p{L}\p{N}._/-])\p{L}++(?![\p{N}._/-])"), F.lit(0))


def collapse_wildcards(template: Column) -> Column:
    """`<*> <*>` becomes `<*>` until nothing changes, in one pass."""
    return F.regexp_replace(template, r"<\*>(?: <\*>)+", "<*>")


def wildcard_count(template: Column) -> Column:
    return F.regexp_count(template, F.lit(r"<\*>"))


def has_no_word(text: Column) -> Column:
    """Nothing alphanumeric (ASCII) in it."""
    return ~text.rlike(_ANY_WORD)


def too_wild(template: Column, most: int = 50) -> Column:
    return wildcard_count(template) > most


def usable_template(extracted: Column, message: Column) -> Column:
    """An extracted template without any wildcard is replaced by the message."""
    return F.when(F.contains(extracted, F.lit(WILD)), extracted).otherwise(message)


def is_degenerate(template: Column) -> Column:
    """Only wildcards and blanks, or parts of them: stands for nothing but its own message."""
    return ~template.rlike("[^<>* ]")


def is_number_like(token: Column) -> Column:
    """Candidates for variables among constants: digits, a signed integer, a hex number, or
    four or more hex digits of which one is a decimal digit."""
    return token.rlike(r"^\d+$") | (token.rlike(r"^(?:-?\+?\d+|0[Xx][a-fA-F\d]+|[a-fA-F\d]{4,})$") & token.rlike(r"\d"))


def is_word_like(captured: Column) -> Column:
    """Candidates for constants among captured texts: three or more letters, no literal."""
    return captured.rlike(r"^\p{L}{3,}$") & ~F.lower(captured).isin("true", "false", "null")


def contains_other(text: Column, classes: Column) -> Column:
    """Whether some character of the text is outside the wildcard classes."""
    return F.size(F.array_except(char_classes(text), classes)) > 0


def split_leading_wildcard(template: Column, first_content: Column) -> Column:
    """A leading wildcard that captured a blank is split into two once."""
    return F.when(template.startswith(WILD) & F.contains(first_content, F.lit(" ")), F.concat(F.lit("<*> "), template)).otherwise(template)


def says_yes(reply: Column) -> Column:
    """A merge verdict: whether the text after the last `answer:` (the whole text without one) has a yes."""
    return F.contains(F.regexp_replace(F.lower(reply), r"(?s)^.*answer:", ""), F.lit("yes"))


def says_constant(reply: Column) -> Column:
    """A token verdict: constant is said and not denied."""
    low = F.lower(reply)
    return F.contains(low, F.lit("constant")) & ~low.rlike(r"not\s+(?:a\s+)?constant")


def final_answer(reply: Column) -> Column:
    """The trimmed text after the first `Final Answer:`; empty without one."""
    at = F.instr(reply, "Final Answer:")
    return F.when(at > 0, F.trim(F.substring(reply, at + F.lit(len("Final Answer:")), F.length(reply)))).otherwise("")


def pair_count(n: Column) -> Column:
    """Pairs among n rows."""
    return (n * (n - 1) / 2).cast("long")


def covers(diffs: Column) -> Column:
    """Each pair of differing texts has a side that is a wildcard without words; true for none."""
    wild = lambda s: F.contains(s, F.lit(WILD)) & has_no_word(s)
    return F.forall(diffs, lambda d: wild(d.l) | wild(d.r))


def all_digits(diffs: Column) -> Column:
    """Both sides of each pair are digits; true for none."""
    return F.forall(diffs, lambda d: d.l.rlike(r"^\p{Nd}+$") & d.r.rlike(r"^\p{Nd}+$"))
