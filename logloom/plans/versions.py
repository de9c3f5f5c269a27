"""Queries of what grows by versions, and of merging and matching at catalog size.

Online mining and the index read a log of client changes in four batches, the
stream with a restart before each; questions are asked in two jobs with one memo.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import align, text
from logloom.functions.shared import shared_folder
from logloom.operators import ask, evaluate, index, match, mine, pairs
from logloom.plans.queries import _PART_PAIRS, _PRF, _SIZES, _SLOTS, LINES, _content, _event_content, _part_templates, query
from logloom.sources import formats
from logloom.streaming import lines as line_stream
from logloom.streaming import online

BATCHES = 4


def _change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, LineId, content, quarter): changes as messages, one dataset for each source. Late deletions
    are written in words that take in all statements of two words and `stored`."""
    c = spark.read.parquet(f"{sf_dir}/client_changes.parquet")
    top = c.agg(F.coalesce(F.max("change_id"), F.lit(0))).first()[0]
    number = lambda n: F.col(n).cast("string")
    size = F.when(F.col("balance") > 2500, "large").otherwise("small")
    pair = F.concat_ws(" ", F.coalesce("segment", F.lit("none")), size, F.lit("stored"))
    said = F.when(F.col("op") == "I", F.concat_ws(" ", F.lit("inserted"), number("change_id"), F.lit("for"), number("client_id")))
    said = said.when((F.col("op") == "D") & (F.col("change_id") * 5 >= top * 3), F.concat_ws(" ", number("change_id"), number("client_id"), F.lit("stored")))
    said = said.when(F.col("op") == "D", F.concat_ws(" ", F.lit("removed"), number("change_id"))).otherwise(pair)
    quarter = F.expr(f"CAST(({BATCHES} * change_id) div ({top} + 1) AS INT)")
    return c.select(F.coalesce("source", F.lit("none")).alias("dataset"), (F.col("change_id") + 1).alias("LineId"), said.alias("content"), quarter.alias("quarter"))


def _mined(spark: SparkSession, sf_dir: str) -> str:
    """Mine the lines batch by batch; the stream is started anew for each on one checkpoint. Gives the folder of versions."""
    where = shared_folder(spark, "online")
    lines = _change_lines(spark, sf_dir)
    for k in range(BATCHES):
        lines.filter(F.col("quarter") == k).drop("quarter").write.mode("append").parquet(f"{where}/lines")
        stream = spark.readStream.schema(lines.drop("quarter").schema).parquet(f"{where}/lines")
        online.mine_online(stream, f"{where}/versions", f"{where}/checkpoint").awaitTermination()
    return f"{where}/versions"


#: What the pass makes of these lines by hand: a statement opens a cluster at its first line, unless it is of two words
#: and `stored` and comes after the dataset's first late deletion, which takes all of those in. k: the batches seen.
_SAID = f"""said AS (SELECT coalesce(source, 'none') AS dataset, change_id + 1 AS line, CAST(({BATCHES} * change_id) // (top + 1) AS INTEGER) AS batch, op, op = 'D' AND change_id * 5 >= top * 3 AS late,
      CASE WHEN op = 'I' THEN 'inserted <*> for <*>' WHEN op = 'D' AND change_id * 5 >= top * 3 THEN '<*> <*> stored' WHEN op = 'D' THEN 'removed <*>'
        ELSE coalesce(segment, 'none') || CASE WHEN balance > 2500 THEN ' large' ELSE ' small' END || ' stored' END AS key
      FROM client_changes, (SELECT max(change_id) AS top FROM client_changes) t),
    seen AS (SELECT k, said.* FROM said JOIN (SELECT unnest(range({BATCHES})) AS k) r ON batch <= k),
    late AS (SELECT k, dataset, min(line) AS since FROM seen WHERE late GROUP BY k, dataset),
    mine AS (SELECT seen.*, since, key LIKE '% stored' AND line >= since IS TRUE AS taken FROM seen LEFT JOIN late USING (k, dataset)),
    own AS (SELECT *, CASE WHEN taken THEN '<*> <*> stored' ELSE key END AS statement FROM mine),
    opened AS (SELECT k, dataset, statement, row_number() OVER (PARTITION BY k, dataset ORDER BY min(line)) - 1 AS id FROM own GROUP BY k, dataset, statement),
    placed AS (SELECT own.*, opened.id AS first_id, CASE WHEN key LIKE '% stored' AND since IS NOT NULL THEN '<*> <*> stored' ELSE key END AS now FROM own JOIN opened USING (k, dataset, statement))"""


@query(
    f"""WITH {_SAID} SELECT p.dataset, line AS "LineId", batch, first_id, o.id AS "EventId", now AS "EventTemplate"
    FROM placed p JOIN opened o ON o.k = p.k AND o.dataset = p.dataset AND o.statement = now WHERE p.k = {BATCHES - 1}"""
)
def online_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the id that its batch gave it, and the one that merges of later batches made of it."""
    return online.structured(spark, _mined(spark, sf_dir))


@query(
    f"""WITH {_SAID} SELECT CAST(p.k AS INTEGER) AS batch, p.dataset, o.id AS "EventId", now AS "EventTemplate", count(*) AS "Occurrences"
    FROM placed p JOIN opened o ON o.k = p.k AND o.dataset = p.dataset AND o.statement = now GROUP BY ALL"""
)
def online_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after each batch."""
    path = _mined(spark, sf_dir)
    each = [online.catalog(spark, path, k).withColumn("batch", F.lit(k)) for k in range(BATCHES)]
    return reduce(DataFrame.unionByName, each).select("batch", "dataset", "EventId", "EventTemplate", "Occurrences")


@query(
    f"""WITH {_SAID}, pairs AS (SELECT p.dataset || ':' || o.id AS p, op AS g FROM placed p JOIN opened o ON o.k = p.k AND o.dataset = p.dataset AND o.statement = now WHERE p.k = {BATCHES - 1} AND op IS NOT NULL),
    cell AS (SELECT p, g, count(*) AS n FROM pairs GROUP BY p, g), {_SIZES}, {_PRF}
    SELECT a / b AS precision, a / c AS recall, 2 * (a / b) * (a / c) / (a / b + a / c) AS f1, (SELECT CAST(sum(n) AS BIGINT) FROM cell) AS rows,
      (SELECT CAST(sum(CASE WHEN k = 1 AND n_p = n_g THEN n ELSE 0 END) AS DOUBLE) / sum(n) FROM cell JOIN np USING (p) JOIN ng USING (g)) AS ga FROM s"""
)
def online_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online grouping against the kind of change that wrote a line: kinds are spread over datasets, and late deletions share a statement with updates."""
    mined = online.structured(spark, _mined(spark, sf_dir)).select("dataset", "LineId", F.concat_ws(":", "dataset", "EventId").alias("p"))
    truth = spark.read.parquet(f"{sf_dir}/client_changes.parquet").filter("op is not null").select((F.col("change_id") + 1).alias("LineId"), F.col("op").alias("g")).distinct()
    return evaluate.scores(mined.join(truth, "LineId").select("p", "g")).select("precision", "recall", "f1", "ga", "rows")


@query(
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'left' ELSE 'right' END AS source, event_type FROM events WHERE event_type <> 'error')
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY event_id) AS "LineId", CAST(event_id AS VARCHAR) AS "Pid", upper(event_type) AS "Level" FROM e"""
)
def stream_line_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log files of two sources that come in three batches: numbers go on over batches, and skip lines that do not match."""
    where = shared_folder(spark, "numbered")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    top = e.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    source = F.when(F.col("user_id") % 3 == 0, "left").otherwise("right")
    whole = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.col("event_id").cast("string"), F.upper("event_type"), F.lit("app: got"), "props")
    said = e.select("event_id", source.alias("source"), F.when(F.col("event_type") == "error", F.lit("broken")).otherwise(whole).alias("value"), F.expr(f"(3 * event_id) div ({top} + 1)").alias("third"))
    for k in range(3):
        third = said.filter(F.col("third") == k).repartitionByRange("event_id").sortWithinPartitions("source", "event_id")
        third.select("source", "value").write.mode("append").partitionBy("source").text(f"{where}/files")
        files = spark.readStream.schema("value string, source string").text(f"{where}/files")
        running, state = line_stream.number_stream(files, f"{where}/out", f"{where}/checkpoint", formats.FORMATS["HDFS"])
        running.awaitTermination()
    return state.lines().select("source", "LineId", "Pid", "Level")


# the index by versions


_CITY = "coalesce(source, '') || ' ' || coalesce(segment, '') || ' ' || coalesce(city, '') || ' <*>'"


@query(
    f"""WITH q AS (SELECT *, ({BATCHES} * change_id) // (top + 1) AS quarter FROM client_changes, (SELECT max(change_id) AS top FROM client_changes) t),
    newest AS (SELECT * FROM q WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY quarter DESC, seq DESC, change_id DESC) = 1),
    said AS (SELECT CAST(client_id AS VARCHAR) AS tid, {_CITY} AS template FROM newest WHERE op <> 'D'),
    tok AS (SELECT tid, unnest(regexp_extract_all(template, '(?s)<\\*>|[\\p{{L}}\\p{{N}}._/-]+|.')) AS token FROM said)
    SELECT token, tid, count(*) AS tf FROM tok WHERE regexp_matches(token, '^\\p{{L}}+$') GROUP BY token, tid"""
)
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after four deltas with changed and removed ids, of which the second was made a base: as if built anew."""
    c = spark.read.parquet(f"{sf_dir}/client_changes.parquet").filter("client_id is not null")
    top = c.agg(F.coalesce(F.max("change_id"), F.lit(0))).first()[0]
    c = c.withColumn("quarter", F.expr(f"({BATCHES} * change_id) div ({top} + 1)"))
    last = c.groupBy("quarter", "client_id").agg(F.max(F.struct("seq", "change_id", "op", "source", "segment", "city")).alias("c")).select("quarter", "client_id", "c.*")
    template = F.when(F.coalesce(F.col("op") != "D", F.lit(False)), F.concat(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in ("source", "segment", "city")]), F.lit(" <*>")))
    store = index.IndexStore(spark, shared_folder(spark, "index"))
    for k in range(BATCHES):
        store.add(k, last.filter(F.col("quarter") == k).select(F.col("client_id").alias("tid"), template.alias("template")))
        if k == 1:
            store.compact()
    return store.postings()


# merging and matching


_ALL_PAIRS = _PART_PAIRS.replace(_PART_PAIRS[_PART_PAIRS.index("own AS (") : _PART_PAIRS.index("pair AS (")], "met AS (SELECT x.template AS a, y.template AS b FROM statement x JOIN statement y ON x.template < y.template),\n    ")


@query(f"WITH {_ALL_PAIRS} SELECT a, b, merged FROM pair WHERE len(diffs) <= 2 OR len(list_filter(diffs, lambda d: d[1] <> '<*>' AND d[2] <> '<*>')) = 0")
def mergeable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of statements that the rule merges, from candidates that miss none; the SQL looks at every pair."""
    return pairs.mergeable_pairs(_part_templates(spark, sf_dir))


_SETTING = """setting AS (SELECT 'set <*> of ' || source || ' to <*>' AS template, source, CASE WHEN source = 'crm' THEN 'c-' ELSE '' END || client_id AS first, CASE WHEN source = 'web' THEN '#' ELSE '' END || change_id AS second
      FROM client_changes WHERE source IS NOT NULL)"""


@query(
    f"""WITH {_SETTING}, said AS (SELECT template, 0 AS slot, 'set <*>' AS start, first AS got FROM setting UNION ALL SELECT template, 1, template, second FROM setting),
    k AS (SELECT DISTINCT start, CASE WHEN ch BETWEEN '0' AND '9' THEN 'digit' WHEN ch BETWEEN 'a' AND 'z' THEN 'alpha' ELSE ch END AS class FROM (SELECT start, unnest(string_split(got, '')) AS ch FROM said) x),
    taken AS (SELECT start, string_agg(class, ',' ORDER BY class) AS classes FROM k GROUP BY start)
    SELECT DISTINCT template, CAST(slot AS INTEGER) AS slot, classes FROM said JOIN taken USING (start)"""
)
def node_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of wildcards as a prefix tree shares them: the first of all statements, the last of each."""
    c = spark.read.parquet(f"{sf_dir}/client_changes.parquet").filter("source is not null")
    number = lambda sign, source, n: F.concat(F.when(F.col("source") == source, sign).otherwise(""), F.col(n).cast("string"))
    seen = F.array(text.char_classes(number("c-", "crm", "client_id")), text.char_classes(number("#", "web", "change_id")))
    said = c.select(F.concat(F.lit("set <*> of "), "source", F.lit(" to <*>")).alias("template"), seen.alias("classes")).distinct()
    return match.node_class_union(said).select("template", "slot", F.array_join("classes", ",").alias("classes"))


@query(
    """WITH said AS (SELECT event_type, 'app.' || event_type || ' got ' || array_to_string(list_transform(string_split(props, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS template FROM events WHERE event_type <> 'error')
    SELECT template AS "EventTemplate", count(*) AS lines FROM said GROUP BY template"""
)
def class_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines against the mined catalog by a join whose wildcards take their classes only."""
    lines = _event_content(spark, sf_dir)
    structured, _ = mine.mine_exact(lines)
    seen = structured.select("EventTemplate", "content").distinct().select(F.col("EventTemplate").alias("template"), align.realigned("EventTemplate", "content").getField("classes").alias("classes"))
    slots = match.class_union(seen).groupBy("template").agg(F.array_sort(F.collect_list(F.struct("slot", "classes"))).getField("classes").alias("classes"))
    hits = match.match_join(lines, slots, classes_col="classes")
    return lines.join(hits, "content").groupBy(F.col("template").alias("EventTemplate")).agg(F.count("*").alias("lines"))


@query(f"WITH {LINES}, {_SLOTS} SELECT content, template, CAST(1 AS BIGINT) AS calls FROM projected WHERE regexp_matches(content, '[0-9]')")
def asked_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the lines that hold a digit, asked on executors: half of the documents first, then all; no prompt twice."""
    lines = _content(spark, sf_dir).filter(F.col("content").rlike("[0-9]"))
    path = shared_folder(spark, "memo")
    ask.templates(lines.filter("doc_id % 2 = 0"), ask.Offline(), path)
    return ask.templates(lines, ask.Offline(), path)
