"""Planning documents over the driver's tables: a user's events are their cards, tasks and marked days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import dealt
from ..operators import boards
from . import frames
from .queries import as_text, query

PREFIX = "plan."
#: The column of each kind of event; errors are in the archive.
COLUMN_OF = {"click": "Ideas", "view": "This Week", "purchase": "Complete", "signup": "Parking Lot"}


def events(spark, sf_dir):
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    e = frames.table(spark, sf_dir, "events")
    # by user at once, so that what is grouped by user and more needs no shuffle of its own
    return dealt(e, e.count(), "user_id").select("user_id", "event_id", "event_type", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("card"), F.date_format("ts", "yyyy-MM-dd").alias("day"), ts.alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def user_boards(spark, sf_dir):
    """(user_id, document): one flat JSON object per user. A third of the tasks name their card, a third one that is none."""
    e = events(spark, sf_dir)
    card = F.struct(F.col("card").alias("id"), F.col("event_type").alias("title"), F.col("at").alias("createdAt"), F.array(F.struct(F.col("k").alias("n"))).alias("subtasks"), F.when(F.col("event_type") == "error", F.col("at")).alias("archivedAt"), F.when(F.col("event_type") == "error", "Ideas").alias("archivedFromColumn"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("event_id", x.alias("x")))), lambda r: r["x"])
    place = F.create_map(*[F.lit(v) for pair in COLUMN_OF.items() for v in pair])
    columns = e.where("event_type <> 'error'").groupBy("user_id", place[F.col("event_type")].alias("c")).agg(ordered(card).alias("x"))
    kanban = columns.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("c", "x")))).alias("value")).withColumn("key", F.lit("kanban"))
    archive = e.where("event_type = 'error'").groupBy("user_id").agg(F.to_json(ordered(card)).alias("value")).withColumn("key", F.lit("archive"))
    task = F.struct(F.col("event_type").alias("text"), (F.col("event_id") % 2 == 0).alias("done"), F.when(F.col("event_id") % 3 == 0, F.col("card")).when(F.col("event_id") % 3 == 1, "unknown").alias("projectId"))
    days = e.groupBy("user_id", "day").agg(F.to_json(ordered(task)).alias("value")).select("user_id", "value", F.concat(F.lit("dailyTasks."), "day").alias("key"))
    marks = e.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.collect_list("day")), lambda d: F.struct(d, F.lit(True))))).alias("value")).withColumn("key", F.lit("calendar"))
    stats = e.groupBy("user_id").agg(F.to_json(F.struct(F.count("*").alias("events"))).alias("value")).withColumn("key", F.lit("stats"))
    long = kanban.unionByName(archive).unionByName(days).unionByName(marks).unionByName(stats)
    pairs = F.collect_list(F.struct(F.concat(F.lit(PREFIX), "key"), F.parse_json("value")))
    return long.groupBy("user_id").agg(F.to_json(F.map_from_entries(pairs)).alias("document"))


def taken(spark, sf_dir):
    return boards.decompose(user_boards(spark, sf_dir), "user_id", "document", PREFIX)


_COLUMN = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in COLUMN_OF.items()) + " ELSE 'Ideas' END"
_E = f"SELECT user_id, event_id, event_type, 'c' || event_id AS card, CAST(ts AS DATE) AS day, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k, {_COLUMN} AS board_column FROM events"


@query(f"""SELECT user_id, card, event_type AS title, board_column, event_type = 'error' AS shelved, row_number() OVER (PARTITION BY user_id, board_column, event_type = 'error' ORDER BY event_id)::INT - 1 AS place, ts AS created_at,
    CASE WHEN event_type = 'error' THEN ts END AS archived_at, k AS subtask FROM ({_E})""")
def s1_board_cards(spark, sf_dir):
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return taken(spark, sf_dir).cards.select("user_id", "card", "title", "board_column", "shelved", "place", time("created_at"), time("archived_at"), F.variant_get("subtasks", "$[0].n", "int").alias("subtask"))


@query(f"SELECT user_id, day, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id)::INT - 1 AS place, event_type AS text, event_id % 2 = 0 AS done, CASE WHEN event_id % 3 = 0 THEN card END AS project FROM ({_E})")
def s1_board_tasks(spark, sf_dir):
    return taken(spark, sf_dir).tasks.select("user_id", "day", "place", "text", "done", "project")


_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00'"
_CARD = f"""'{{' || CASE WHEN event_type = 'error' THEN '"archivedAt":"' || {_TIME} || '","archivedFromColumn":"Ideas",' ELSE '' END || '"createdAt":"' || {_TIME} || '","date":"","description":"","enteredThisWeekAt":null,"id":"' || card || '","priority":"","subtasks":[{{"n":' || k || '}}],"title":"' || event_type || '","updatedAt":null}}'"""
_LISTED = "(SELECT coalesce('[' || string_agg(c, ',' ORDER BY event_id) || ']', '[]') FROM cards WHERE cards.user_id = u.user_id AND {})"
_KANBAN = " || ',' || ".join(f"""'"{c}":' || {_LISTED.format(f"board_column = '{c}' AND event_type <> 'error'")}""" for c in sorted(COLUMN_OF.values()))


@query(f"""WITH e AS MATERIALIZED ({_E}), cards AS MATERIALIZED (SELECT user_id, event_id, event_type, board_column, {_CARD} AS c FROM e), u AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1),
days AS (SELECT user_id, day, '"plan.dailyTasks.' || day || '":[' || string_agg('{{"done":' || (event_id % 2 = 0)::VARCHAR || ',"projectId":' || CASE WHEN event_id % 3 = 0 THEN '"' || card || '"' ELSE 'null' END || ',"subtaskId":null,"text":"' || event_type || '"}}', ',' ORDER BY event_id) || ']' AS x, '"' || day || '":true' AS m FROM e GROUP BY 1, 2),
d AS (SELECT user_id, string_agg(x, ',' ORDER BY day) AS tasks, string_agg(m, ',' ORDER BY day) AS marks FROM days GROUP BY 1)
SELECT user_id, '{{"plan.archive":' || {_LISTED.format("event_type = 'error'")} || ',"plan.calendar":{{' || marks || '}},' || tasks || ',"plan.doneLedger":[],"plan.kanban":{{' || {_KANBAN} || '}},"plan.parkingLot":' || {_LISTED.format("event_type = 'signup'")}
    || ',"plan.settings":{{}},"plan.stats":{{"events":' || n || '}}}}' AS document FROM u JOIN d USING (user_id)""")
def s5_rebuild_boards(spark, sf_dir):
    """Documents after a way through the tables and back."""
    return boards.rebuild(taken(spark, sf_dir), "user_id", PREFIX)


as_text("s1_board_cards", ("created_at", "archived_at"))
as_text("s1_board_tasks", ("day",))
