"""Lenient template comparison: rewrites after which equivalent templates are equal.

Each rule is applied until nothing changes. Most rules get there in one pass;
those that may apply again to what they made are repeated while they match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rewrites of the published scoring, in its order. (pattern, replacement)
RULES = [
    (r"(?:-)+<\*>", "<*>"),
    (r"<\*>(?::<\*>)+", "<*>"),
    (r"<\*>(?:\.<\*>)+", "<*>"),
    (r"<\*>(?:\s<\*>)+", "<*>"),
    (r"(?:<\*>){2,}", "<*>"),
    (r"(?:com.apple.)+<\*>", "<*>"),
    (r"(?:ib_sm_sweep.c:)+<\*>", "<*>"),
    (r"<*>##<*>", "<*>"),
    (r"<\*>(?:@<\*>)+", "<*>"),
    (r"<\*>(?:/<\*>)+", "<*>"),
    (r"(?:\.)+<\*>", "<*>"),
    (r"[\w_]+<\*>", "<*>"),
    (r"(?:/)+<\*>", "<*>"),
    (r"<\*>(?:ms)+", "<*>"),
    (r"<<\*>>", "<*>"),
    (r"<\*>(?:;)+", "<*>"),
    (r"@<\*>(?: @<\*>)+", "@<*>"),
    (r"(?:\{)+<\*>", "<*>"),
    (r"(?:\\\?\\)+<\*>", "<*>"),
    (r"<NUM>", "<*>"),
    (r"(?:#)+<\*>", "<*>"),
    (r"'<\*>'", "<*>"),
    (r"\s{2,}", " "),
    (r"(?:#)+<\*>", "<*>"),
    (r"<\*>(?: milliseconds)+", "<*>"),
    (r"<\*>(?: microseconds)+", "<*>"),
    (r"<\*>(?: msecs)+", "<*>"),
    (r"<\*>(?: ms)+", "<*>"),
    (r"<\*>(?: us)+", "<*>"),
    (r"<\*>(?: s )+", "<*>"),
    (r"<\*>(?: [GM]B)+", "<*>"),
    (r"<\*>(?: sec)+", "<*>"),
    (r"<\*>(?:\|<\*>)+", "<*>"),
    (r"<\*>(?:#)+", "<*>"),
    (r"\(<\*>\)", "<*>"),
    (r"\[<\*>\]", "<*>"),
    (r"<\*>(?: bytes)+", "<*>"),
    (r"<\*>(?:\.)+", "<*>"),
    (r'"<\*>"', "<*>"),
    (r"<\*>(?:\))+", "<*>"),
    (r"(?:\()+<\*>", "<*>"),
    (r"<\*>(?:,)+", "<*>"),
    (r"(?:<\*>){2,}", "<*>"),
    (r"<\*>(?::)+", "<*>"),
    (r"<\*>(?: <\*>)+", "<*>"),
    (r"(?:hdfs:)+<\*>", "<*>"),
    (r"<\*>(?:-)+", "<*>"),
    (r"ALERT <\*>(?: ALERT <\*>)+", "ALERT <*>"),
    (r"<\*>(?:/\*)+", "<*>"),
    (r"(?:\\)+<\*>", "<*>"),
    (r"(?:spark:)+<\*>", "<*>"),
    (r"<\*>(?:\])+", "<*>"),
    (r"<\*>(?:>)+", "<*>"),
    (r"#<\*>#", "<*>"),
    (r'<\*>(?:")+', "<*>"),
]
#: Rules that may apply again to what they made, with what bounds how often: each time takes one of the
#: signs before a wildcard, or one of the signs anywhere, so the longest run or their number is enough.
NESTED = {r"<<\*>>": r"(<+)<\*>", r"'<\*>'": r"('+)<\*>", r"\(<\*>\)": r"(\(+)<\*>", r"\[<\*>\]": r"(\[+)<\*>", r'"<\*>"': r'("+)<\*>', r"#<\*>#": r"(#+)<\*>", r"<*>##<*>": None}


def _settled(template: Column, pattern: str, to: str) -> Column:
    """The rule repeated until it does not match: in as many steps as it can take, not as the text is long."""
    run = NESTED[pattern]

    def fix(t: Column) -> Column:
        most = F.regexp_count(t, F.lit("##")) if run is None else F.array_max(F.transform(F.regexp_extract_all(t, F.lit(run), F.lit(1)), F.length))
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), most))
        return F.when(t.rlike(pattern), F.aggregate(steps, t, lambda held, _: F.regexp_replace(held, pattern, to))).otherwise(t)

    # inside a transform the text is a variable: the chain before it stands in the expression once
    return F.transform(F.array(template), fix)[0]


def comparable(template: Column) -> Column:
    """The template after all rewrites. Only for distinct templates: it is a long chain."""
    for pattern, to in RULES:
        template = _settled(template, pattern, to) if pattern in NESTED else F.regexp_replace(template, pattern, to)
    return template


def sql(templates: str) -> str:
    """DuckDB: a table normal_form(template, normal) for a query that gives a column `template`.

    A recursion that stays at a rule while it changes the text, apart from the chain above.
    """
    def texts(k: int) -> str:
        return "[" + ", ".join("'" + r[k].replace("'", "''") + "'" for r in RULES) + "]"

    return f"""rewrite_step AS (
      SELECT template, template AS t, 1 AS k FROM ({templates}) x
      UNION ALL
      SELECT template, n, CASE WHEN n = t THEN k + 1 ELSE k END FROM (
        SELECT template, t, k, regexp_replace(t, {texts(0)}[k], {texts(1)}[k], 'g') AS n FROM rewrite_step WHERE k <= {len(RULES)}) s),
    normal_form AS (SELECT DISTINCT template, t AS normal FROM rewrite_step WHERE k = {len(RULES) + 1})"""
