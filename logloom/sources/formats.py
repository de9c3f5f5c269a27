"""Header formats of log files, compiled to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The public benchmark's data sets with their header formats. Text between fields is a regular expression.
FORMATS = {
    "HDFS": r"<Date> <Time> <Pid> <Level> <Component>: <Content>",
    "Hadoop": r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
    "Spark": r"<Date> <Time> <Level> <Component>: <Content>",
    "Zookeeper": r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
    "OpenStack": r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
    "BGL": r"<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
    "HPC": r"<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
    "Thunderbird": r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
    "Windows": r"<Date> <Time>, <Level>  <Component>  <Content>",
    "Linux": r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
    "Mac": r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
    "Android": r"<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
    "HealthApp": r"<Time>\|<Component>\|<Pid>\|<Content>",
    "Apache": r"\[<Time>\] \[<Level>\] <Content>",
    "OpenSSH": r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
    "Proxifier": r"\[<Time>\] <Program> - <Content>",
}
_FIELD = re.compile(r"<([^<>]+)>")


@dataclass(frozen=True)
class LineFormat:
    """A compiled format: its fields, the regular expression, and each field's group number."""

    fields: tuple[str, ...]
    pattern: str
    groups: tuple[int, ...]
    optional: tuple[bool, ...]


def compile_format(text: str) -> LineFormat:
    """Fields in order; runs of blanks between them match any white space; the whole line must match.

    Groups of the format's own shift the numbers of the fields after them. A
    field inside an optional group may be absent.
    """
    pattern, fields, groups, optional = "^", [], [], []
    number, open_, at = 0, [], 0
    optional_at: dict[int, bool] = {}

    def literal(part: str) -> str:
        nonlocal number
        k = 0
        while k < len(part):
            c = part[k]
            if c == "\\":
                k += 2
                continue
            if c == "(":
                plain = part[k + 1 : k + 2] != "?"
                number += plain
                open_.append(len(fields))
            elif c == ")" and open_:
                first = open_.pop()
                if part[k + 1 : k + 2] in ("?", "*"):
                    optional_at.update(dict.fromkeys(range(first, len(fields)), True))
            k += 1
        return re.sub(" +", lambda _: r"\s+", part)

    for m in _FIELD.finditer(text):
        pattern += literal(text[at : m.start()])
        number += 1
        fields.append(m[1])
        groups.append(number)
        pattern += "(.*?)"
        at = m.end()
    pattern += literal(text[at:]) + "$"
    optional = [optional_at.get(k, False) for k in range(len(fields))]
    return LineFormat(tuple(fields), pattern, tuple(groups), tuple(optional))


def registry(spark: SparkSession) -> DataFrame:
    """(dataset, log_file, log_format, n_fields) of the known data sets."""
    rows = [(k, f"{k}/{k}_2k.log", v, len(compile_format(v).fields)) for k, v in FORMATS.items()]
    return spark.createDataFrame(rows, "dataset string, log_file string, log_format string, n_fields int")
