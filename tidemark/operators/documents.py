"""Small document jobs: namespaced JSON, snapshot sync, session logs, reading time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, written
from .keys import dedupe_last, same_key

#: Columns of a board in order; cards that were put away from none of them come from the last.
COLUMNS = ("Ideas", "This Week", "Complete", "Parking Lot")


def decompose_documents(df: DataFrame, user: str, document: str) -> DataFrame:
    """(user, namespace, item, value) of a flat JSON object per user; the part after a key's first dot is the item. A null
    document, or one that is no object, gives no rows."""
    flat = df.select(user, F.explode(F.from_json(document, "map<string,string>")).alias("key", "value"))
    return flat.select(user, F.substring_index("key", ".", 1).alias("namespace"), F.when(F.contains("key", F.lit(".")), F.regexp_replace("key", r"^[^.]*\.", "")).alias("item"), "value")


def document_tables(df: DataFrame, user: str, document: str, prefix: str) -> dict[str, DataFrame]:
    """Typed tables of a flat JSON object per user whose keys start with `prefix`:

    cards (user, card, title, priority, board_column, archived): from kanban, a list per column, and archive, a list; of a
    card that is in several the archive counts, then the later column, then the later place. daily_tasks (user, day,
    place, text, done) from dailyTasks.DATE, weekly_focus (user, week, main, secondary, health) from weeklyFocus.WEEK,
    calendar (user, day) from calendar's marked days, done (user, text, source, day) from doneLedger. Keys of another form,
    columns that are none, cards without an id and values that cannot be read give no rows; a document holds all of a user.
    """
    flat = df.select(user, F.explode(F.from_json(document, "map<string,string>")).alias("key", "value")).where(F.startswith("key", F.lit(prefix))).withColumn("key", F.substring("key", F.lit(len(prefix) + 1), F.length("key")))
    of = lambda key: flat.where(F.col("key") == key)
    card = "struct<id:string,title:string,priority:string,archivedFromColumn:string>"
    field = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c)
    live = of("kanban").select(user, F.explode(F.from_json("value", f"map<string,array<{card}>>")).alias("board_column", "cards")).where(F.col("board_column").isin(*COLUMNS)).select(user, "board_column", F.posexplode("cards").alias("at", "x"))
    live = live.select(user, F.col("x.id").alias("card"), field("title"), field("priority"), "board_column", F.lit(False).alias("archived"), F.array_position(F.array(*map(F.lit, COLUMNS)), F.col("board_column")).alias("_c"), "at")
    kept = of("archive").select(user, F.posexplode(F.from_json("value", f"array<{card}>")).alias("at", "x"))
    kept = kept.select(user, F.col("x.id").alias("card"), field("title"), field("priority"), F.coalesce(F.nullif(F.col("x.archivedFromColumn"), F.lit("")), F.lit(COLUMNS[-1])).alias("board_column"), F.lit(True).alias("archived"), F.lit(99).cast("long").alias("_c"), "at")
    cards = dedupe_last(live.unionByName(kept).where("card IS NOT NULL AND card <> ''"), [user, "card"], [F.col("_c"), F.col("at")]).drop("_c", "at")
    dated = flat.withColumn("day", F.regexp_extract("key", r"^dailyTasks\.(\d{4}-\d{2}-\d{2})$", 1)).where("day <> ''")
    tasks = dated.select(user, "day", F.posexplode(F.from_json("value", "array<struct<text:string,done:boolean>>")).alias("place", "x")).select(user, F.col("day").try_cast("date").alias("day"), "place", field("text"), F.coalesce("x.done", F.lit(False)).alias("done")).where("day IS NOT NULL")
    weeks = flat.withColumn("week", F.regexp_extract("key", r"^weeklyFocus\.(\d{4}-\d{2})$", 1)).where("week <> ''").withColumn("x", F.from_json("value", "struct<main:string,secondary:string,health:string>")).where("x IS NOT NULL")
    marks = of("calendar").select(user, F.explode(F.from_json("value", "map<string,string>")).alias("day", "mark")).where("mark = 'true'").select(user, F.col("day").try_cast("date").alias("day")).where("day IS NOT NULL")
    done = of("doneLedger").select(user, F.explode(F.from_json("value", "array<struct<text:string,source:string,date:string>>")).alias("x")).select(user, field("text"), field("source"), F.col("x.date").try_cast("date").alias("day")).where("day IS NOT NULL")
    return {"cards": cards, "daily_tasks": tasks, "weekly_focus": weeks.select(user, "week", field("main"), field("secondary"), field("health")), "calendar": marks, "done": done}


def snapshot_sync(stored: DataFrame, incoming: DataFrame, key: list[str], value: str) -> DataFrame:
    """What turns stored into incoming for the users that incoming has: insert, update, delete or keep per key."""
    touched = stored.join(incoming.select(key[0]).distinct(), key[0], "left_semi")
    a, b = touched.select(*key, F.col(value).alias("old"), F.lit(True).alias("_a")), incoming.select(*key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return a.join(b, key, "full").select(*key, "old", "new", action.alias("action"))


def append_new(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored and one row for each key of incoming that it lacks. Null key parts count as equal; rows of incoming that
    repeat a key are taken to be alike; either side may be empty."""
    new = incoming.dropDuplicates(key)
    return stored.unionByName(new.join(stored.select(*key), same_key(new, stored, key), "left_anti"))


def replace_day(stored: DataFrame, incoming: DataFrame, days: DataFrame, user: str, day: str) -> DataFrame:
    """stored with the whole set of each (user, day) of `days` replaced by that of incoming; a day of `days` that incoming
    has no row for is emptied. Rows of incoming on other days are left out."""
    touched = days.select(user, day).distinct()
    return stored.join(touched, same_key(stored, touched, [user, day]), "left_anti").unionByName(incoming.join(touched, same_key(incoming, touched, [user, day]), "left_semi"))


def rebuild_documents(tables: dict[str, tuple[DataFrame, str, str]], user: str) -> DataFrame:
    """(user, document): one JSON object per user with a key per table, each an object of item to value in item order.
    tables: name -> (rows, item column, value column). A user without rows in a table lacks its key; null items are left
    out; of rows that repeat an item the greatest value stays. A document holds all rows of its user. The rows are written
    once and counted, so that more of them are dealt to more tasks, in one shuffle by user."""
    long = None
    for name, (df, item, value) in tables.items():
        part = df.where(F.col(item).isNotNull()).select(F.col(user), F.lit(name).alias("namespace"), F.col(item).cast("string").alias("item"), F.col(value).cast("string").alias("value"))
        long = part if long is None else long.unionByName(part)
    long = written(long)
    one = dealt(long, long.count(), user).groupBy(user, "namespace", "item").agg(F.max("value").alias("value"))
    spaces = one.groupBy(user, "namespace").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "value")))).alias("items"))
    by_name = lambda a, b: F.when(a["namespace"] < b["namespace"], -1).when(a["namespace"] > b["namespace"], 1).otherwise(0)
    return spaces.groupBy(user).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("namespace", "items")), by_name))).alias("document"))


def recent_sessions(df: DataFrame, user: str, at: str, seconds: str, mode: str, modes: list[str], tie: str, k: int = 500) -> DataFrame:
    """The newest k valid sessions of each user."""
    valid = df.where((F.col(seconds) >= 0) & F.col(mode).isin(*modes))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return valid.withColumn("place", place).where(F.col("place") <= k)


def reading_time(df: DataFrame, text: str, wpm: int = 200, image_seconds: int = 12) -> DataFrame:
    """Whole minutes, at least one: words outside table rows, and a time for each image."""
    prose = F.array_join(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("|"))), "\n")
    n_words = F.regexp_count(prose, F.lit(r"[^\x20\x09-\x0D]+"))
    n_images = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"!\[|<img"))
    minutes = F.greatest(F.lit(1), F.ceil((n_words * F.lit(60.0) / wpm + n_images * image_seconds) / 60))
    return df.withColumns({"n_prose_words": n_words.cast("long"), "minutes": minutes.cast("long")})
