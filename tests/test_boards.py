"""Planning documents: tables with their types, and the way back."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import storage
from tidemark.operators import boards

PREFIX = "plan."
CARD = {"id": "c1", "title": "One", "date": "2026-08-02", "description": "long é", "priority": "high", "subtasks": [{"id": "s1", "text": "do", "done": True}], "createdAt": "2026-08-01T10:00:00+00:00", "updatedAt": "2026-08-01T10:00:00.123000+00:00", "enteredThisWeekAt": None}
WHOLE = {
    "plan.strategy": {"title": "T", "principle": "P", "northStar": "N", "currentSeason": "S", "careerCompass": {"a": [1, 2.5, None, {"b": "x"}]}, "season": {"q": "\"quoted\""}, "rules": ["r1", {"r": 2}], "careerStory": {}, "longTermDirection": []},
    "plan.kanban": {"Ideas": [CARD, {**CARD, "id": "c2", "title": "Two", "subtasks": []}], "This Week": [], "Complete": [{**CARD, "id": "c3"}], "Parking Lot": [{**CARD, "id": "c4"}]},
    "plan.parkingLot": [{**CARD, "id": "c4"}],
    "plan.archive": [{**CARD, "id": "c9", "archivedAt": "2026-08-03T00:00:00+00:00", "archivedFromColumn": "Ideas"}],
    "plan.calendar": {"2026-08-01": True, "2026-08-05": True},
    "plan.weeklyFocus.2026-31": {"main": "m", "secondary": "", "health": "h"},
    "plan.dailyTasks.2026-08-01": [{"text": "b", "done": True, "projectId": "c2", "subtaskId": None}, {"text": "a", "done": False, "projectId": None, "subtaskId": "s1"}],
    "plan.doneLedger": [{"text": "x", "source": "kanban", "date": "2026-08-01T09:00:00+00:00", "projectId": "c1"}, {"text": "y", "source": "", "date": "2026-08-02T09:00:00+00:00"}],
    "plan.settings": {"theme": {"dark": True}}, "plan.stats": {"streak": 4},
}
EMPTY = {"plan.kanban": {c: [] for c in ("Ideas", "This Week", "Complete", "Parking Lot")}, "plan.parkingLot": [], "plan.archive": [], "plan.calendar": {}, "plan.doneLedger": [], "plan.settings": {}, "plan.stats": {}}


def taken(spark, docs):
    df = spark.createDataFrame([(u, d if isinstance(d, str) or d is None else json.dumps(d)) for u, d in docs.items()], "user string, document string")
    return boards.decompose(df, "user", "document", PREFIX)


def built(tables):
    return {r["user"]: json.loads(r["document"]) for r in boards.rebuild(tables, "user", PREFIX).collect()}


def test_rebuild_of_decompose_is_the_document(spark):
    second = {**EMPTY, "plan.settings": {"only": 1}}
    got = built(taken(spark, {"u": WHOLE, "w": second, "none": None, "list": "[1]", "bad": "{oops", "other": {"elsewhere": 1}}))
    assert got == {"u": WHOLE, "w": second}
    # nothing is a string of JSON
    text = json.dumps(got["u"])
    assert '{\\"' not in text.replace('"\\"quoted\\""', "")


def test_types(spark):
    tables = taken(spark, {"u": WHOLE})
    kinds = dict(tables.strategy.dtypes) | dict(tables.cards.dtypes) | {"settings": dict(tables.meta.dtypes)["settings"], "day": dict(tables.tasks.dtypes)["day"], "at": dict(tables.done.dtypes)["at"]}
    assert {kinds[c] for c in ("career_compass", "rules", "subtasks", "settings")} == {"variant"}
    assert (kinds["created_at"], kinds["day"], kinds["at"], kinds["title"]) == ("timestamp", "date", "timestamp", "string")
    card = tables.cards.where("card = 'c9'").first()
    assert (card["shelved"], card["archived_from"], card["board_column"]) == (True, "Ideas", "Ideas")
    assert tables.cards.where("card = 'c1'").selectExpr("variant_get(subtasks, '$[0].text', 'string') t").first()["t"] == "do"
    assert sorted((r["text"], r["project"], r["subtask"]) for r in tables.tasks.collect()) == [("a", None, "s1"), ("b", "c2", None)]


def test_odd_values(spark):
    doc = {
        "plan.kanban": {"Ideas": [{"id": "a", "title": 5, "subtasks": "no list"}, {"title": "no id"}, 7, {"id": "b", "createdAt": "2026-08-01T12:30:00+02:00"}], "Elsewhere": [{"id": "z"}], "Complete": [{"id": "a", "title": "later column"}], "This Week": "no list"},
        "plan.archive": [{"id": "b", "archivedFromColumn": ""}],
        "plan.calendar": {"2026-08-01": True, "2026-08-02": False, "2026-13-45": True, "day": True},
        "plan.dailyTasks.2026-02-30": [{"text": "no such day"}], "plan.dailyTasks.2026-08-01": [{"text": None, "projectId": "unknown"}, "no task"], "plan.dailyTasks.x": [{}],
        "plan.weeklyFocus.2026-1": {"main": "no"}, "plan.doneLedger": [{"text": "t", "date": "yesterday"}, {"text": "t", "date": "2026-08-01T00:00:00"}, {"text": "t", "date": "2026-08-01T00:00:00Z"}],
        "plan.settings": [1], "plan.stats": {"a": 1},
    }
    tables = taken(spark, {"u": doc})
    cards = {r["card"]: r for r in tables.cards.collect()}
    assert set(cards) == {"a", "b"} and cards["a"]["title"] == "later column" and cards["b"]["shelved"] and cards["b"]["board_column"] == "Parking Lot"
    assert tables.calendar.collect()[0]["day"] == datetime.date(2026, 8, 1) and tables.calendar.count() == 1
    (task,) = tables.tasks.collect()
    assert (task["text"], task["project"]) == ("", None) and tables.focus.count() == 0 and tables.done.count() == 1
    got = built(tables)["u"]
    assert got["plan.settings"] == {} and got["plan.stats"] == {"a": 1} and "plan.strategy" not in got
    again = taken(spark, {"u": got})
    assert built(again)["u"] == got


def test_no_documents(spark):
    tables = taken(spark, {"u": None})
    assert built(tables) == {}


def test_documents_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(document):
        seen.add(1)
        return document

    df = spark.createDataFrame([("u", json.dumps(WHOLE)), ("w", json.dumps(EMPTY))], "user string, document string").select("user", told("document").alias("document"))
    assert built(boards.decompose(df, "user", "document", PREFIX)) == {"u": WHOLE, "w": EMPTY}
    assert seen.value == 2


def test_more_rows_are_dealt_to_more_tasks(spark):
    df = spark.range(10)
    assert [storage.dealt(df, n, "id").rdd.getNumPartitions() for n in (0, 400_000, 2_000_001)] == [4, 4, 21]
