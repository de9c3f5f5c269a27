"""Mining templates from messages.

Exact mode is an online pass over the distinct messages in the order of their
first line: match the catalog, else extract, refine, look up candidates, and
join one of them or open a new cluster. It runs on masks' representatives,
which are few in logs and bounded by a parameter, one task for each dataset. Scalable mode merges masks by
token-blocked pairs and connected components, and has no order.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import align, text
from logloom.functions.shared import checkpoint
from logloom.operators.match import Catalog, Entry
from logloom.operators.oracle import Heuristic, Oracle
from logloom.operators.pairs import contained_pairs
from logloom.sources.logs import number_lines

#: Candidates looked at for each unmatched message, and their least score.
CANDIDATES, LEAST = 3, 0.5
MAX_WILDCARDS = 50
#: Messages that exact mode takes, at most.
MAX_MESSAGES = 200_000
_WORD = re.compile("[a-zA-Z0-9]")
_NUMBER = re.compile(r"-?\+?\d+|0[Xx][a-fA-F\d]+|[a-fA-F\d]{4,}")
_RUN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_INDEX_TOKEN = re.compile(r"(?s)<\*>|(?:[^\W_]|[._/-])+|.")


def number_like(token: str) -> bool:
    return token.isdigit() or (_NUMBER.fullmatch(token) is not None and any(c.isdigit() for c in token))


def word_like(captured: str) -> bool:
    return captured.isalpha() and len(captured) >= 3 and captured.lower() not in ("true", "false", "null")


def _has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None or not text.isascii() and any(c.isdigit() for c in text)


def _worded(p: align.Projection, message: str) -> align.Projection:
    return p if _WORD.search(p.template) else align.heuristic(message)


def restore_constants(template: str, message: str, oracle: Oracle) -> align.Projection:
    """Captured words that the oracle calls constant go back into the template."""
    p = align.realign(template, message)
    if "<*" not in p.template:
        return _worded(align.realign(p.template, message), message)
    back = [c if word_like(c) and oracle.is_constant(message, c) else align.WILD for c in p.contents]
    slots = iter(back)
    made = "".join(next(slots, align.WILD) if t == align.WILD else t for t in align.chars(p.template))
    return _worded(align.realign(made, message), message)


def mask_variables(template: str, message: str, oracle: Oracle) -> align.Projection:
    """Number-like words of the template that the oracle does not call constant become wildcards, word by word."""
    if not _has_digit(template):  # so has every number-like word
        return _worded(align.realign(template, message), message)
    verdict: dict[str, bool] = {}
    made = ""
    for t in align.words(template):
        if t != align.WILD and number_like(t):
            if t not in verdict:
                verdict[t] = oracle.is_constant(message, t)
            made += t if verdict[t] else align.WILD
        else:
            made += t
    return _worded(align.realign(made, message), message)


@F.pandas_udf(align.PROJECTION)
def refined(template: pd.Series, message: pd.Series) -> pd.DataFrame:
    """Both refinements under the default oracle."""
    oracle = Heuristic()
    got = [mask_variables(restore_constants(t, m, oracle).template, m, oracle) for t, m in zip(template, message, strict=True)]
    return pd.DataFrame({"template": [g.template for g in got], "classes": [[sorted(c) for c in g.classes] for g in got], "contents": [g.contents for g in got]})


class Index:
    """Containment of a template's letters-only tokens in a query."""

    def __init__(self) -> None:
        self.postings: dict[str, dict[int, int]] = {}
        self.size: dict[int, int] = {}
        self.tokens: dict[int, Counter] = {}

    @staticmethod
    def split(template: str) -> Counter:
        return Counter(t for t in _INDEX_TOKEN.findall(template) if t.isalpha())

    def put(self, tid: int, template: str) -> None:
        """Index a template, in place of what the id stood for before."""
        for t in self.tokens.pop(tid, ()):
            del self.postings[t][tid]
        self.tokens[tid] = got = self.split(template)
        self.size[tid] = sum(got.values())
        for t, n in got.items():
            self.postings.setdefault(t, {})[tid] = n

    def drop(self, tid: int) -> None:
        for t in self.tokens.pop(tid, ()):
            del self.postings[t][tid]

    def query(self, template: str, k: int) -> list[tuple[int, float]]:
        common: Counter = Counter()
        for t, n in self.split(template).items():
            for tid, tf in self.postings.get(t, {}).items():
                common[tid] += min(n, tf)
        ranked = sorted(((tid, c / self.size[tid]) for tid, c in common.items()), key=lambda x: (-x[1], x[0]))
        return ranked[:k]


@dataclass
class Cluster:
    template: str
    first: int
    rows: int = 0
    members: list[str] = field(default_factory=list)


class Miner:
    """The online pass. Feed messages in order; clusters keep the messages that opened or widened them.

    An id is given once. A cluster that became part of another leaves a move;
    `root` follows moves from an id that was given to the cluster that it is now.
    What is matched does not depend on when the catalog was compiled, so a miner
    made again from clusters and entries (`restore`) goes on as the first would have.
    """

    def __init__(self, oracle: Oracle | None = None) -> None:
        self.oracle = oracle or Heuristic()
        self.clusters: dict[int, Cluster] = {}
        self.words: dict[int, frozenset[str]] = {}
        self.index = Index()
        self.entries: dict[tuple[int, str], Entry] = {}
        self.catalog = Catalog([])
        self.fresh: list[Entry] = []
        self.young: Catalog | None = None  # the fresh ones, compiled
        self.assigned: dict[str, int] = {}
        self.moves: dict[int, int] = {}
        self.next_id = 0
        self.calls = 0
        self.learned = 0

    def restore(self, clusters: dict[int, Cluster], entries: list[Entry], next_id: int) -> None:
        """Go on from what another miner held."""
        self.clusters, self.next_id = clusters, next_id
        for cid in sorted(clusters):
            self._describe(cid)
        self.entries = {(e.tid, e.template): e for e in entries}
        self._compile()

    def root(self, cid: int) -> int:
        while cid in self.moves:
            cid = self.moves[cid]
        return cid

    def _learn(self, cid: int, message: str) -> None:
        """Put the cluster's template, as it fits this message, into the catalog."""
        p = align.realign(self.clusters[cid].template, message)
        if text_is_degenerate(p.template):
            p = align.Projection(message)
        template = p.template
        if template.startswith(align.WILD) and p.contents and " " in p.contents[0]:
            template = f"{align.WILD} {template}"
            p.classes.insert(0, p.classes[0])
        old = self.entries.get((cid, template))
        if old:
            for have, more in zip(old.classes, p.classes, strict=False):
                have |= more
        else:
            old = self.entries[cid, template] = Entry(cid, template, p.classes)
        self.fresh.append(old)
        self.young = None
        self.learned += 1
        if len(self.fresh) > 64:
            self._compile()

    def _compile(self) -> None:
        self.catalog = Catalog(list(self.entries.values()))
        self.fresh, self.young = [], Catalog([])

    def match(self, message: str) -> int:
        """The cluster with the best template among those compiled and those learned since, or -1."""
        self.young = self.young or Catalog(self.fresh)
        found = [self.catalog.best(message), self.young.best(message)]
        return min((f for f in found if f), default=("", -1))[1]

    def feed(self, message: str, first: int = 0, rows: int = 1) -> int:
        """The cluster of a message; first is its first line, rows how many lines have it."""
        cid = self.match(message)
        if cid == -1:
            cid = self._place(message, first)
        self.clusters[cid].rows += rows
        self.clusters[cid].first = min(self.clusters[cid].first, first)
        self.assigned[message] = cid
        return cid

    def _place(self, message: str, first: int) -> int:
        self.calls += 1
        found = self.oracle.extract(message)
        if align.WILD not in found:
            found = message
        if not _WORD.search(found) or found.count(align.WILD) > MAX_WILDCARDS:
            found = align.heuristic(message).template
        near = self.index.query(found, CANDIDATES)
        template = restore_constants(found, message, self.oracle).template
        template = mask_variables(template, message, self.oracle).template
        for cid, score in near:
            if score < LEAST:
                break
            cluster = self.clusters[cid]
            ok, m = align.judge(cluster.template, template)
            if not ok:
                continue
            by_rule = cluster.template == template or align.covered(m.diffs) or align.digits_only(m.diffs)
            if by_rule or self.oracle.same(template, cluster.template):
                cluster.members.append(message)
                self._rename(cid, m.template)
                self._learn(cid, message)
                return cid if by_rule else self._absorb(cid)
        cid = self.next_id
        self.next_id += 1
        self.clusters[cid] = Cluster(align.realign(template, message).template, first, 0, [message])
        self._describe(cid)
        self._learn(cid, message)
        return self._absorb(cid)

    def _rename(self, cid: int, template: str) -> None:
        self.clusters[cid].template = template
        self._describe(cid)

    def _describe(self, cid: int) -> None:
        template = self.clusters[cid].template
        self.index.put(cid, template)
        self.words[cid] = frozenset(_RUN.findall(template))

    def _absorb(self, cid: int) -> int:
        """Clusters whose merge with this one is one of the two templates become part of it."""
        taken = []
        for other in list(self.clusters):
            # a merge that is one of the two keeps all words of that one, unless the two only differ in wildcards in a row
            mine, theirs = self.clusters[cid].template, self.clusters[other].template
            if other == cid or not (self.words[cid] <= self.words[other] or self.words[other] <= self.words[cid]):
                continue
            ok, m = align.judge(mine, theirs)
            if ok and m.template in (mine, theirs):
                taken.append(other)
                self._rename(cid, m.template)
        if taken:
            whole = self.clusters[cid]
            gone = {*taken}
            for other in taken:
                c = self.clusters.pop(other)
                self.index.drop(other)
                self.moves[other] = cid
                whole.rows += c.rows
                whole.first = min(whole.first, c.first)
                whole.members += c.members
            for key in [k for k in self.entries if k[0] in gone or k[0] == cid]:
                del self.entries[key]
            self.fresh = []
            for message in whole.members:
                self._learn(cid, message)
            self._compile()
        return cid


def text_is_degenerate(template: str) -> bool:
    return not re.search("[^<>* ]", template)


def distinct_messages(lines: DataFrame, content_col: str = "content", order_col: str = "LineId") -> DataFrame:
    """(content, first, rows): each message once."""
    return lines.groupBy(F.col(content_col).alias("content")).agg(F.min(order_col).alias("first"), F.count("*").alias("rows"))


def mine_exact(lines: DataFrame, content_col: str = "content", order_col: str = "LineId", oracle: Oracle | None = None, most: int = MAX_MESSAGES, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(structured, catalog) in the order of the lines; with `by`, of each dataset that those columns name, side by side.

    Messages with equal masks share a fate under the heuristic oracle, so the
    pass takes one for each mask: the first. A dataset's pass is one task's work,
    as each message depends on those before it; more than `most` masks in one is
    an error, and mine_scalable has no such bound. EventId numbers a dataset's
    clusters by their first line. Lines without content, or with a null in `by`,
    are mined like others. The driver sees nothing of the messages.
    """
    by = by or []
    keys = [F.col(f"`{c}`").alias(f"__by{k}") for k, c in enumerate(by)]
    named = [f"__by{k}" for k in range(len(by))]
    masked = lines.withColumns({f"__by{k}": x for k, x in enumerate(keys)} | {"__mask": text.mask(F.col(content_col))})
    heads = masked.groupBy(*named, "__mask").agg(F.min_by(content_col, order_col).alias("content"), F.min(order_col).alias("first"), F.count("*").alias("rows"))
    heads = checkpoint(heads)
    if not heads.groupBy(*named).count().filter(F.col("count") > most).isEmpty():
        raise ValueError(f"more than {most} masks; use mine_scalable")
    kinds = dict(heads.dtypes)

    def mined(group: pd.DataFrame) -> pd.DataFrame:
        miner = Miner(oracle)
        group = group.sort_values("first", kind="stable")
        for content, first, rows in zip(group["content"], group["first"], group["rows"], strict=True):
            miner.feed(content or "", first, rows)
        order = {cid: k for k, (cid, _) in enumerate(sorted(miner.clusters.items(), key=lambda x: x[1].first))}
        at = [miner.root(miner.assigned[c or ""]) for c in group["content"]]
        return group[[*named, "__mask", "rows"]].assign(EventId=[order[c] for c in at], EventTemplate=[miner.clusters[c].template for c in at])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*named, "__mask", "rows"]), "EventId int", "EventTemplate string"])
    placed = checkpoint(heads.groupBy(*named).applyInPandas(mined, schema))
    catalog = placed.groupBy(*named, "EventId", "EventTemplate").agg(F.sum("rows").alias("Occurrences"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*named, "__mask"]]
    structured = masked.alias("l").join(placed.alias("p"), same, "left").select("l.*", "p.EventId", "p.EventTemplate").drop(*named, "__mask")
    return structured, catalog.select(*[F.col(f"__by{k}").alias(c) for k, c in enumerate(by)], "EventId", "EventTemplate", "Occurrences")


def token_pairs(templates: DataFrame, template_col: str = "template") -> DataFrame:
    """(a, b), a < b: templates of which one has the other's rarest letters-only token.

    A common token brings no pairs together unless it is a template's rarest; a
    template without letters meets none.
    """
    t = templates.select(F.col(template_col).alias("template")).distinct()
    tokens = t.select("template", F.explode(F.array_distinct(text.alpha_tokens(F.col("template")))).alias("token"))
    weight = tokens.groupBy("token").agg(F.count("*").alias("df"))
    rarest = tokens.join(weight, "token").groupBy("template").agg(F.min(F.struct("df", "token")).alias("m")).select("template", F.col("m.token").alias("token"))
    met = rarest.withColumnRenamed("template", "a").join(tokens.withColumnRenamed("template", "b"), "token").filter("a != b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge_clusters(templates: DataFrame, template_col: str = "template") -> DataFrame:
    """(template, root): templates that a rule merges into one of the two, transitively.

    Pairs come from contained_pairs, which misses none of these merges.
    """
    t = templates.select(F.col(template_col).alias("template")).filter("template is not null").distinct()
    verdict = contained_pairs(t).withColumn("v", align.judged("a", "b")).filter("v.mergeable and (v.merged = a or v.merged = b)").select("a", "b")
    edges = checkpoint(verdict)
    label = checkpoint(t.withColumn("root", F.col("template")))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:  # smallest label of the neighbours, then of the label itself
        near = both.join(label.select(F.col("template").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        step = label.join(near.withColumnRenamed("a", "template"), "template", "left").withColumn("root", F.least("root", F.coalesce("low", "root"))).drop("low")
        jump = step.select(F.col("template").alias("root"), F.col("root").alias("up"))
        nxt = checkpoint(step.join(jump, "root", "left").select("template", F.least("root", F.coalesce("up", "root")).alias("root")))
        if nxt.exceptAll(label).isEmpty():
            return nxt
        label = nxt


def merged_masks(masks: DataFrame, mask_col: str = "template") -> DataFrame:
    """(template, merged): for each mask the template of the group that a rule merges it
    into, which is its mask with most wildcards, the least of equal ones."""
    roots = merge_clusters(masks, mask_col)
    best = checkpoint(roots.groupBy("root").agg(F.min_by("template", F.struct(-text.wildcard_count(F.col("template")), "template")).alias("merged")))
    return roots.join(best, "root").select("template", "merged")


def mine_scalable(lines: DataFrame, content_col: str = "content", order_col: str = "LineId") -> tuple[DataFrame, DataFrame]:
    """(structured, catalog) without an order: masks, merged by rule over shared tokens."""
    masked = lines.withColumn("__mask", text.mask(F.col(content_col)))
    sizes = checkpoint(masked.groupBy("__mask").agg(F.min(order_col).alias("first"), F.count("*").alias("rows")))
    roots = merge_clusters(sizes, "__mask").withColumnRenamed("template", "__mask")
    groups = sizes.join(roots, "__mask").groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("Occurrences"), F.min_by("__mask", F.struct(-text.wildcard_count(F.col("__mask")), "__mask")).alias("EventTemplate"))
    numbered = checkpoint(number_lines(groups, "first", "root", name="n").withColumn("EventId", (F.col("n") - 1).cast("int")))
    where = roots.join(numbered.select("root", "EventId", "EventTemplate"), "root").select("__mask", "EventId", "EventTemplate")
    return masked.join(where, "__mask").drop("__mask"), numbered.select("EventId", "EventTemplate", "Occurrences")
