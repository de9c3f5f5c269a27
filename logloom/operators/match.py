"""Matching lines against a template catalog.

A template is an anchored regular expression whose wildcards take any
characters of their classes. Where several match, the one that is literal for
longest wins: templates compare as texts in which a wildcard is the largest
character.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import align
from logloom.functions.shared import checkpoint, join_in_blocks

if TYPE_CHECKING:
    from logloom.operators.trie import Trie

#: Templates that a compiled catalog may hold; beyond that the join is used.
MAX_COMPILED = 20_000
#: Words of a template whose counts in the contents are taken, and as many keys as are broadcast for that.
RAREST, MAX_BROADCAST_KEYS = 3, 500_000
#: Characters at both ends of a text that are keys; a template has those of the greatest length that its literal ends reach.
ENDS = (8, 16, 32)
_LAST = chr(0x10FFFF)


def priority(template: Column) -> Column:
    return F.replace(template, F.lit("<*>"), F.lit(_LAST))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|()?*+\[\]{}&~#-])", r"\\$1")


def pattern(template: Column, classes: Column | None = None) -> Column:
    """Regular expression for a whole text, line ends of any kind included.

    Without classes every wildcard takes anything, the empty text too; each literal
    part stands at its first place then, without going back, so a text is read once. With them
    (an array for each wildcard, as `class_union` makes them) a wildcard takes
    characters of its classes only, and one that ends the template at least one;
    one without classes takes nothing, one beyond the given ones anything. A
    template without literal text then stands for no text but itself.
    """
    parts = F.split(template, r"<\*>", -1)
    if classes is None:
        last = F.size(parts) - 1
        anywhere = F.transform(parts, lambda p, k: F.when(k == 0, _escaped(p)).when(k == last, F.concat(F.lit(".*"), _escaped(p))).otherwise(F.concat(F.lit("(?>.*?"), _escaped(p), F.lit(")"))))
        return F.concat(F.lit("(?s)^"), F.array_join(anywhere, ""), F.lit("\\z"))

    def wildcard(k: Column) -> Column:
        last = (k == F.size(parts) - 2) & (F.element_at(parts, -1) == "")
        own = F.get(classes, k)
        others = F.array_join(F.transform(F.filter(own, lambda c: c != "alpha"), lambda c: F.when(c == "digit", r"\p{Nd}").otherwise(_escaped(c))), "")
        taken = F.concat(F.when(F.array_contains(own, "alpha"), r"\p{L}\p{Nl}\p{No}").otherwise(""), others)
        one = F.when(own.isNull(), ".").when(taken == "", "(?!)").otherwise(F.concat(F.lit("["), taken, F.lit("]")))
        return F.concat(one, F.when(last, "+").otherwise("*"))

    pieces = F.transform(parts, lambda p, k: F.concat(_escaped(p), F.when(k < F.size(parts) - 1, wildcard(k)).otherwise("")))
    rx = F.concat(F.lit("(?s)^"), F.array_join(pieces, ""), F.lit("\\z"))
    return F.when(template.rlike("[^<>* ]") | ~F.contains(template, F.lit("<*>")), rx).otherwise("(?!)")


def _whole_words(template: Column) -> Column:
    """Words of the literal text that have a blank or an end on both sides, so stand in every text that the template fits."""
    words = F.flatten(F.transform(F.split(template, r"<\*>", -1), lambda p: F.split(p, " ", -1)))
    padded = F.concat(F.lit(" "), template, F.lit(" "))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))))


def _end_keys(text: Column) -> Column:
    """The ends of a text as keys, of each length that it has."""
    ends = [(F.length(text) >= n, F.concat(F.lit(f"{at}{n}:"), cut(text, F.lit(n)))) for n in ENDS for at, cut in (("h", F.left), ("t", F.right))]
    return F.filter(F.array(*[F.when(long, key) for long, key in ends]), lambda k: k.isNotNull())


def _longest_end(part: Column, at: str, cut) -> Column:
    """The key of a template's literal end, null for one that is too short."""
    return F.coalesce(*[F.when(F.length(part) >= n, F.concat(F.lit(f"{at}{n}:"), cut(part, F.lit(n)))) for n in sorted(ENDS, reverse=True)])


def match_join(lines: DataFrame, templates: DataFrame, content_col: str = "content", template_col: str = "template", classes_col: str | None = None) -> DataFrame:
    """(content, template): each distinct content with the template that fits it best.

    A template without a wildcard is its text: an equal join. Its content needs no
    other, for a wildcard is the largest character. The other contents meet a
    template with wildcards by one of its keys, whichever is rarest among them: a
    literal end, or one of the RAREST whole words that are rarest among templates.
    A template with a key that no content has fits none. One without keys is met by
    the contents with its first literal character, and one of wildcards only by
    all. Contents are numbers until the keys are chosen. Those of a frequent key
    are dealt out in blocks, to each of which its templates go. Both ends and the
    longest literal part are compared before the regular expression is.
    classes_col: what each wildcard takes, see `pattern`; without it, anything.
    Null contents and templates are left out; repeated ones count once.
    """
    t = templates.select(F.col(template_col).alias("template"), *([F.col(classes_col).alias("classes")] if classes_col else [])).filter("template is not null")
    wild = F.contains("template", F.lit("<*>"))
    literal = t.filter(~wild).select(F.col("template").alias("content"), F.lit(False).alias("asked"), F.lit(True).alias("own"))
    texts = lines.select(F.col(content_col).alias("content"), F.lit(True).alias("asked"), F.lit(False).alias("own")).filter("content is not null").unionByName(literal)
    texts = texts.groupBy("content").agg(F.bool_or("asked").alias("asked"), F.bool_or("own").alias("own")).filter("asked")  # texts go by one shuffle
    marked = checkpoint(texts.select("content", "own"))
    sure = F.col("own") & ~F.contains("content", F.lit(_LAST))  # that character itself may tie with a wildcard

    parts = F.split("template", r"<\*>", -1)
    core = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))).getField("p")
    head, tail = F.element_at(parts, 1), F.element_at(parts, -1)
    ends = F.filter(F.array(_longest_end(head, "h", F.left), _longest_end(tail, "t", F.right)), lambda k: k.isNotNull())
    t = t.filter(wild).dropDuplicates(["template"]).select("template", pattern(F.col("template"), F.col("classes") if classes_col else None).alias("rx"), _whole_words(F.col("template")).alias("words"), ends.alias("ends"), head.alias("head"), tail.alias("tail"), core.alias("core"))
    t = checkpoint(t)
    if t.isEmpty():
        return marked.filter("own").select("content", F.col("content").alias("template"))
    rest = checkpoint(marked.filter(~sure).withColumn("n", F.monotonically_increasing_id()))

    asked = t.select("template", F.explode("words").alias("word"))
    df = asked.groupBy("word").agg(F.count("*").alias("df"))
    rare = asked.join(df, "word").groupBy("template").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "word"))), 1, RAREST).getField("word").alias("word"))
    rare = rare.select("template", F.explode("word").alias("word")).select("template", F.concat(F.lit("w"), "word").alias("key"))
    rare = checkpoint(rare.unionByName(t.select("template", F.explode("ends").alias("key"))))
    letter = F.substring(F.replace("template", F.lit("<*>"), F.lit("")), 1, 1)
    others = t.filter("size(words) = 0 and size(ends) = 0").select("template", F.concat(F.lit("c"), letter).alias("key"))

    keys = rare.select("key").distinct()
    keys = F.broadcast(keys) if rare.count() <= MAX_BROADCAST_KEYS else keys
    has = F.concat(_end_keys(F.col("content")), F.transform(F.array_distinct(F.split("content", " ", -1)), lambda w: F.concat(F.lit("w"), w)))
    near = checkpoint(rest.select("n", F.explode(has).alias("key")).join(keys, "key"))  # one pass over the contents
    often = near.groupBy("key").agg(F.count("*").alias("often"))
    best = rare.join(often, "key", "left").groupBy("template").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key")).alias("best"))
    keyed = best.filter("best.often > 0").select("template", F.col("best.key").alias("key")).unionByName(others)
    met = near.select("n", "key")
    if not others.isEmpty():
        signs = F.concat(F.array(F.lit("c")), F.transform(F.split("content", ""), lambda x: F.concat(F.lit("c"), x)))
        met = met.unionByName(checkpoint(rest.select("n", F.explode(F.array_distinct(signs)).alias("key")).join(others.select("key").distinct(), "key").select("n", "key")))
    keyed = checkpoint(keyed.join(t.drop("words", "ends"), "template"))
    met = met.join(keyed.select("key").distinct(), "key").join(rest.select("n", "content"), "n")
    fit = F.expr("startswith(content, head) and endswith(content, tail) and contains(content, core) and content rlike rx")
    hits = join_in_blocks(keyed, met, ["key"], "n").filter(fit).select("content", "template")
    hits = hits.unionByName(rest.filter("own").select("content", F.col("content").alias("template")))
    best = hits.groupBy("content").agg(F.min_by("template", priority(F.col("template"))).alias("template"))
    return marked.filter(sure).select("content", F.col("content").alias("template")).unionByName(best)


def class_union(projected: DataFrame, template_col: str = "template", classes_col: str = "classes") -> DataFrame:
    """(template, slot, classes): the classes that each wildcard of a template was seen with."""
    slots = projected.select(F.col(template_col).alias("template"), F.posexplode(classes_col).alias("slot", "one"))
    return slots.select("template", "slot", F.explode("one").alias("class")).groupBy("template", "slot").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def node_class_union(projected: DataFrame, template_col: str = "template", classes_col: str = "classes") -> DataFrame:
    """(template, slot, classes) as a prefix tree shares them: a wildcard takes what it was seen with
    in any template that is the same up to it, that wildcard included.

    Classes are summed up by that beginning, whatever templates go on from it, and joined back
    to each of them. Templates without literal text are in no tree and are left out.
    """
    src = projected.select(F.col(template_col).alias("template"), F.col(classes_col).alias("classes")).filter(F.col("template").rlike("[^<>* ]"))
    parts = F.split(F.regexp_replace("template", r"<\*>?", "<*>"), r"<\*>", -1)
    slots = src.select("template", parts.alias("parts"), F.posexplode("classes").alias("slot", "one"))
    slots = slots.withColumn("start", F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("slot") + 1), "<*>"), F.lit("<*>")))
    shared = slots.select("start", F.explode("one").alias("class")).groupBy("start").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return slots.select("template", "slot", "start").distinct().join(shared, "start").select("template", "slot", "classes")


def class_regex(classes: set[str] | list[str], last: bool) -> str:
    """What a wildcard with these classes takes; a trailing one takes a character at least."""
    letters = [r"[^\W\d_]"] if "alpha" in classes else []
    others = "".join(r"\d" if c == "digit" else re.escape(c) for c in sorted(classes) if c != "alpha")
    takes = letters + ([f"[{others}]"] if others else [])
    one = "(?:" + "|".join(takes) + ")" if takes else "(?!)"
    return one + ("+" if last else "*")


def fits(text: str, classes: set[str]) -> bool:
    """No character of the text is outside the classes."""
    return align.classes(text) <= set(classes)


def stops(text: str, start: int, classes: set[str], delimiters: set[str]) -> list[int]:
    """Where a wildcard from `start` may end: before each delimiter on its way, and
    at the first character outside its classes; at the end if there is neither."""
    found = []
    for k in range(start, len(text)):
        c = text[k]
        if not fits(c, classes) and not (c.isalnum() and not c.isdigit() and not c.isalpha()):
            return [*found, k]
        if c in delimiters:
            found.append(k)
    return found or [len(text)]


@dataclass
class Entry:
    tid: int
    template: str
    classes: list[set[str]]


class Catalog:
    """Compiled templates, tried in order of priority among those whose literal head fits."""

    def __init__(self, entries: list[Entry]) -> None:
        if len(entries) > MAX_COMPILED:
            raise ValueError(f"{len(entries)} templates; at most {MAX_COMPILED} are compiled, use match_join")
        self.rules: list[tuple[str, str, re.Pattern, int]] = []
        for e in sorted(entries, key=lambda e: (e.template.replace("<*>", _LAST), e.tid)):
            self.rules.append((e.template.replace("<*>", _LAST), e.template.split("<*>")[0], self._compile(e), e.tid))
        self.exact = {t: tid for t, _, _, tid in reversed(self.rules) if _LAST not in t}
        self.by_head: dict[str, list[int]] = {}
        for k, (t, head, _, _) in enumerate(self.rules):
            if _LAST in t:
                self.by_head.setdefault(head, []).append(k)
        self.head_lengths = sorted({len(h) for h in self.by_head})

    @staticmethod
    def _compile(e: Entry) -> re.Pattern:
        if not re.search("[^<>* ]", e.template):
            return re.compile("(?!)")  # stands for its own message only
        parts = e.template.split("<*>")
        rx = re.escape(parts[0])
        for k, part in enumerate(parts[1:]):
            classes = e.classes[k] if k < len(e.classes) else None
            last = k == len(parts) - 2 and not part
            rx += (class_regex(classes, last) if classes is not None else ".+" if last else ".*") + re.escape(part)
        return re.compile(rx, re.S)

    def best(self, message: str) -> tuple[str, int] | None:
        """The best template, in order of priority, and its id."""
        if message in self.exact:
            return message, self.exact[message]
        tried: list[int] = []
        for n in self.head_lengths[: bisect.bisect_right(self.head_lengths, len(message))]:
            tried += self.by_head.get(message[:n], ())
        for k in sorted(tried):
            if self.rules[k][2].fullmatch(message):
                return self.rules[k][0], self.rules[k][3]
        return None

    def match(self, message: str) -> int:
        """The id of the best template, or -1."""
        found = self.best(message)
        return found[1] if found else -1


def match_catalog(lines: DataFrame, catalog: Catalog | Trie, content_col: str = "content") -> DataFrame:
    """(content, tid): each distinct content with its template's id, -1 without one."""
    shared = lines.sparkSession.sparkContext.broadcast(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.match(x) if x is not None else -1 for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int32())], names=["content", "tid"])

    return lines.select(F.col(content_col).alias("content")).distinct().mapInArrow(run, "content string, tid int")
