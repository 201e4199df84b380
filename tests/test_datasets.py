"""Datasets of countries: cohort, models side by side, description, refusals."""

import json
import statistics

import pytest

from tidemark.operators import datasets

PLAN = datasets.Plan("d", 3, {"power": ("p", "q"), "half": ("q",)}, {"p": ("a", "b"), "q": ("c",)}, {"a": (1, None), "b": (-1, None), "c": (1, "log10")}, "power", members=("x",), facts={"year": 2024})
RAW = {"w": (1.0, 5.0, 10.0), "x": (2.0, 4.0, 100.0), "y": (4.0, 1.0, 1000.0), "z": (8.0, 2.0, 1.0), "lost": (9.0, None, 1.0)}


def tables(spark, raw=RAW):
    values = spark.createDataFrame([(c, i, v, c == "z", 2020) for c, row in raw.items() for i, v in zip("abc", row, strict=True)], "country string, indicator string, raw double, estimated boolean, year int")
    countries = spark.createDataFrame([(c, c.upper(), "r") for c in raw], "country string, name string, region string")
    links = spark.createDataFrame([("x", "y", 10.006, 0.25, 2), ("x", "w", 30.0, 0.75, 1)], "country string, partner string, value double, share double, rank int")
    return values, countries, links


def by_hand(cohort):
    """Scores of both models from the definition: real values give mean and deviation, estimated ones are scored too."""
    import math

    x = {c: (RAW[c][0], RAW[c][1], math.log10(RAW[c][2])) for c in cohort}
    z = {}
    for k, turn in enumerate((1, -1, 1)):
        real = [v[k] for c, v in x.items() if c != "z"]
        for c, v in x.items():
            z[c, k] = round((v[k] - statistics.fmean(real)) / statistics.pstdev(real) * turn, 4)
    p = {c: round((z[c, 0] + z[c, 1]) / 2, 4) for c in cohort}
    return {c: {"power": round((p[c] + z[c, 2]) / 2, 4), "half": z[c, 2]} for c in cohort}, z


def test_whole_dataset(spark):
    values, countries, links = tables(spark)
    provisional, _ = by_hand(["w", "x", "y", "z"])
    chosen = sorted(sorted(provisional, key=lambda c: (-provisional[c]["power"], c))[:3])
    panel = spark.createDataFrame([("x", 1.5)], "country string, arms double")
    rows = {r["place"]: r for r in datasets.build_dataset(PLAN, values, countries, links, panel).collect()}
    meta = json.loads(rows[0]["document"])
    assert (meta["dataset"], meta["cohort_count"], meta["year"], meta["models"]["half"], meta["indicators"]["c"]) == ("d", 3, 2024, ["q"], {"direction": 1, "transform": "log10"})
    assert [rows[k]["country"] for k in (1, 2, 3)] == chosen and "x" in chosen
    want, z = by_hand(chosen)
    for k, c in enumerate(chosen, 1):
        doc = json.loads(rows[k]["document"])
        assert {m: v["score"] for m, v in doc["models"].items()} == pytest.approx(want[c], abs=1e-4)
        assert doc["models"]["power"]["components"]["p"]["inputs"]["b"] == {"raw": RAW[c][1], "estimated": c == "z", "year": 2020, "z": pytest.approx(z[c, 1], abs=1e-4)}
        assert doc["models"]["half"].keys() == {"score", "default_rank", "components"} and doc["models"]["half"]["components"].keys() == {"q"}
        assert doc["trade_links"] == ([{"partner": "w", "value": 30.0, "share": 0.75}, {"partner": "y", "value": 10.01, "share": 0.25}] if c == "x" else [])
        assert doc.get("military") == ({"arms": 1.5} if c == "x" else None)
    for model in PLAN.models:
        ranks = {r["country"]: json.loads(r["document"])["models"][model]["default_rank"] for k, r in rows.items() if k}
        assert sorted(ranks, key=ranks.get) == sorted(chosen, key=lambda c: (-want[c][model], c))


def test_too_few_or_a_member_missing(spark):
    values, countries, links = tables(spark)
    with pytest.raises(ValueError, match="are required"):
        datasets.build_dataset(PLAN, values.where("country < 'y'"), countries, links)
    with pytest.raises(ValueError, match="lacks x"):
        datasets.build_dataset(PLAN, values.where("country <> 'x'"), countries, links)
