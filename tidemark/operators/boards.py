"""Planning documents of users, taken apart into typed tables and put together again.

A document is a flat JSON object whose keys start with a prefix; free-form parts stay VARIANT. One table of fields per
section serves both directions: how a column is read from the section and how it is written back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, written
from .documents import COLUMNS
from .keys import dedupe_last

#: Kinds of fields: text (missing: empty), link (missing: null), flag (missing: false), moment (a time with its zone,
#: written in UTC), object and list (free-form).
TEXT, LINK, FLAG, MOMENT, OBJECT, LIST = "text", "link", "flag", "moment", "object", "list"
#: Keys of the document's sections and their fields, by column.
STRATEGY = {
    "title": ("title", TEXT), "principle": ("principle", TEXT), "north_star": ("northStar", TEXT), "current_season": ("currentSeason", TEXT), "career_compass": ("careerCompass", OBJECT),
    "season": ("season", OBJECT), "rules": ("rules", LIST), "career_story": ("careerStory", OBJECT), "long_term_direction": ("longTermDirection", LIST),
}
CARD = {
    "card": ("id", TEXT), "title": ("title", TEXT), "date": ("date", TEXT), "description": ("description", TEXT), "priority": ("priority", TEXT), "subtasks": ("subtasks", LIST),
    "created_at": ("createdAt", MOMENT), "updated_at": ("updatedAt", MOMENT), "entered_this_week_at": ("enteredThisWeekAt", MOMENT),
}
SHELVED = {"archived_at": ("archivedAt", MOMENT), "archived_from": ("archivedFromColumn", TEXT)}
TASK = {"text": ("text", TEXT), "done": ("done", FLAG), "project": ("projectId", LINK), "subtask": ("subtaskId", LINK)}
FOCUS = {"main": ("main", TEXT), "secondary": ("secondary", TEXT), "health": ("health", TEXT)}
DONE = {"text": ("text", TEXT), "source": ("source", TEXT), "at": ("date", MOMENT), "project": ("projectId", LINK)}
META = {"settings": ("settings", OBJECT), "stats": ("stats", OBJECT)}
DAY, WEEK = r"^dailyTasks\.(\d{4}-\d{2}-\d{2})$", r"^weeklyFocus\.([0-9]{4}-[0-9]{2})$"


def moment(text: Column) -> Column:
    """A time with a date, `T` or a space, and an optional fraction and zone (none: UTC); null where it is no time."""
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), F.try_to_timestamp(text))


def read_field(source: Column, key: str, kind: str) -> Column:
    of = lambda t: F.try_variant_get(source, f"$.{key}", t)
    if kind in (OBJECT, LIST):
        right = of("map<string,variant>" if kind == OBJECT else "array<variant>").isNotNull()
        return F.when(right, of("variant")).otherwise(F.parse_json(F.lit("{}" if kind == OBJECT else "[]")))
    if kind == FLAG:
        return F.coalesce(of("boolean"), F.lit(False))
    if kind == MOMENT:
        return moment(of("string"))
    return F.coalesce(of("string"), F.lit("")) if kind == TEXT else F.nullif(of("string"), F.lit(""))


def write_field(column: Column, kind: str) -> Column:
    if kind != MOMENT:
        return column
    utc = F.to_utc_timestamp(column, F.current_timezone())
    whole, micros = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(utc, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def read_fields(source: Column, fields: dict[str, tuple[str, str]]) -> list[Column]:
    return [read_field(source, key, kind).alias(name) for name, (key, kind) in fields.items()]


def write_fields(fields: dict[str, tuple[str, str]]) -> Column:
    return F.struct(*[write_field(F.col(name), kind).alias(key) for name, (key, kind) in fields.items()])


@dataclass
class Boards:
    """The tables of all users' documents.

    strategy: user and STRATEGY. cards: user, CARD, SHELVED, board_column, place (in its column, or in the archive), shelved.
    tasks: user, day, place, TASK. focus: user, week, FOCUS. calendar: user, day. done: user, place, DONE. meta: user, META.
    """

    strategy: DataFrame
    cards: DataFrame
    tasks: DataFrame
    focus: DataFrame
    calendar: DataFrame
    done: DataFrame
    meta: DataFrame


def decompose(df: DataFrame, user: str, document: str, prefix: str) -> Boards:
    """Tables of one document per user; the document holds all of a user. A document that is null or no object, keys of
    another form, cards without an id and values of another shape give no rows. Of a card that is in several places the
    archive counts, then the later column, then the later place. Project links to cards that the user does not have are
    null. Of equal entries (text, source, time) of what is done the first stays; entries without a time are left out.
    Documents are taken apart once: their keys and the cards are written, as every table reads them.
    """
    flat = df.select(user, F.explode(F.from_json(document, "map<string,variant>")).alias("key", "value")).where(F.startswith("key", F.lit(prefix)))
    flat = written(flat.withColumn("key", F.substring("key", F.lit(len(prefix) + 1), F.length("key"))))
    of = lambda key: flat.where(F.col("key") == key)
    typed = lambda t: F.try_variant_get("value", "$", t)
    is_object = lambda c: F.try_variant_get(c, "$", "map<string,variant>").isNotNull()

    strategy = of("strategy").where(is_object("value")).select(user, *read_fields(F.col("value"), STRATEGY))
    columns = F.array(*map(F.lit, COLUMNS))
    live = of("kanban").select(user, F.explode(typed("map<string,array<variant>>")).alias("board_column", "x")).where(F.col("board_column").isin(*COLUMNS))
    live = live.select(user, "board_column", F.lit(False).alias("shelved"), F.posexplode("x").alias("place", "x")).withColumn("_order", F.array_position(columns, F.col("board_column")))
    kept = of("archive").select(user, F.posexplode(typed("array<variant>")).alias("place", "x")).withColumns({"shelved": F.lit(True), "_order": F.lit(99).cast("long")})
    kept = kept.withColumn("board_column", F.coalesce(F.nullif(F.try_variant_get("x", "$.archivedFromColumn", "string"), F.lit("")), F.lit(COLUMNS[-1])))
    both = live.unionByName(kept).where(is_object("x")).select(user, "board_column", "shelved", "place", "_order", *read_fields(F.col("x"), CARD | SHELVED))
    cards = dedupe_last(both.where("card <> ''"), [user, "card"], [F.col("_order"), F.col("place")]).drop("_order")
    cards = written(cards.withColumns({"archived_at": F.when(F.col("shelved"), F.col("archived_at")), "archived_from": F.when(F.col("shelved"), F.col("archived_from")).otherwise("")}))

    known = cards.select(F.col(user).alias("_user"), F.col("card").alias("_card"))
    linked = lambda rows: rows.join(known, (F.col(user) == F.col("_user")) & (F.col("project") == F.col("_card")), "left").withColumn("project", F.col("_card")).drop("_user", "_card")
    dated = flat.withColumn("day", F.nullif(F.regexp_extract("key", DAY, 1), F.lit("")).try_cast("date")).where("day IS NOT NULL")
    tasks = dated.select(user, "day", F.posexplode(typed("array<variant>")).alias("place", "x")).where(is_object("x"))
    focus = flat.withColumn("week", F.regexp_extract("key", WEEK, 1)).where("week <> ''").where(is_object("value"))
    marks = of("calendar").select(user, F.explode(typed("map<string,variant>")).alias("day", "mark"))
    marked = F.coalesce(F.try_variant_get("mark", "$", "boolean"), F.lit(False))
    calendar = marks.where(marked & F.rlike("day", F.lit(r"^\d{4}-\d{2}-\d{2}$"))).select(user, F.col("day").try_cast("date").alias("day")).where("day IS NOT NULL").distinct()
    done = of("doneLedger").select(user, F.posexplode(typed("array<variant>")).alias("place", "x")).where(is_object("x")).select(user, "place", *read_fields(F.col("x"), DONE)).where("at IS NOT NULL")
    done = dedupe_last(done, [user, "text", "source", "at"], [-F.col("place")])
    parts = of("settings").select(user, F.col("value").alias("settings")).join(of("stats").select(user, F.col("value").alias("stats")), user, "full")
    free = lambda c: F.when(is_object(c), F.col(c)).otherwise(F.parse_json(F.lit("{}"))).alias(c)
    return Boards(
        strategy, cards, linked(tasks.select(user, "day", "place", *read_fields(F.col("x"), TASK))), focus.select(user, "week", *read_fields(F.col("value"), FOCUS)),
        calendar, linked(done), parts.select(user, *map(free, META)),
    )


def in_order(rows: Column) -> Column:
    """An array of structs with a place by that place, ties as they are; other fields need no order of their own."""
    return F.array_sort(rows, lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))


def as_json(value: Column, nulls: bool = True) -> Column:
    return F.parse_json(F.to_json(value, {"ignoreNullFields": str(not nulls).lower()}))


def rebuild(boards: Boards, user: str, prefix: str) -> DataFrame:
    """(user, document): one JSON object for each user with a row in any table, nested throughout. Cards, tasks and entries
    are in order of their places, entries of time first. What decompose gives of the result is what it was built from.
    Sections are written once and counted, so that more of them are dealt to more tasks."""
    lists = lambda rows, keys, fields, nulls=True: rows.groupBy(user, *keys).agg(F.transform(in_order(F.collect_list(F.struct("place", write_fields(fields).alias("x")))), lambda r: r["x"]).alias("x"))
    section = lambda df, key, value: df.select(user, (F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))
    held = None
    for df in (boards.strategy, boards.cards, boards.tasks, boards.focus, boards.calendar, boards.done, boards.meta):
        held = df.select(user) if held is None else held.unionByName(df.select(user))
    users = written(held.distinct())
    whole = lambda df, key, value, empty: section(users.join(df, user, "left"), key, F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit(empty)))
    live = lists(boards.cards.where("NOT shelved"), ["board_column"], CARD)
    kanban = live.groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("board_column", "x"))).alias("_held"))
    by_column = lambda c: F.coalesce(F.try_element_at("_held", F.lit(c)), F.from_json(F.lit("[]"), live.schema["x"].dataType)).alias(c)
    kanban = users.join(kanban, user, "left").select(user, F.struct(*map(by_column, COLUMNS)).alias("_all"))
    calendar = boards.calendar.groupBy(user).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("d"), F.lit(True).alias("on"))))).alias("_marks"))
    by_time = Window.partitionBy(user).orderBy("at", "place")
    done = lists(boards.done.withColumn("place", F.row_number().over(by_time)), [], DONE)
    text = lambda df, key, value, nulls: section(df, key, F.to_json(value, {"ignoreNullFields": nulls}))
    meta = users.join(boards.meta, user, "left")
    parts = [
        text(boards.strategy, "strategy", write_fields(STRATEGY), "false"), section(kanban, "kanban", F.to_json("_all", {"ignoreNullFields": "false"})),
        section(kanban, "parkingLot", F.to_json(F.col("_all")[COLUMNS[-1]], {"ignoreNullFields": "false"})), whole(lists(boards.cards.where("shelved"), [], CARD | SHELVED), "archive", F.col("x"), "[]"),
        whole(calendar, "calendar", F.col("_marks"), "{}"), text(boards.focus, F.concat(F.lit("weeklyFocus."), "week"), write_fields(FOCUS), "false"),
        text(lists(boards.tasks, ["day"], TASK), F.concat(F.lit("dailyTasks."), F.col("day").cast("string")), F.col("x"), "false"),
        section(users.join(done, user, "left"), "doneLedger", F.coalesce(F.to_json("x"), F.lit("[]"))),  # entries without a project lack its key
        *[section(meta, c, F.coalesce(F.to_json(c), F.lit("{}"))) for c in META],
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    entries = F.array_sort(F.collect_list(F.struct(F.concat(F.lit(prefix), "key").alias("key"), "value")))
    long = written(long)
    return dealt(long, long.count(), user).groupBy(user).agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.parse_json(e["value"]))))).alias("document"))
