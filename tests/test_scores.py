"""Game-event parsing and per-key scores (the reference's golden test)."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidepool.functions.parse import game_event_rejects, parse_game_event
from tidepool.functions.scalar import format_score
from tidepool.operators.scores import (group_values, merge_sorted, scores_by_field,
                                       total_score, user_score)

# Sample lines whose grouped scores are given; they must stay as
# they are.
GOLDEN = [
    "user3,team3,3,1447679463000,2015-11-16 13:11:03.921",
    "user4,team3,2,1447683063000,2015-11-16 14:11:03.921",
    "user1,team1,18,1447683063000,2015-11-16 14:11:03.921",
    "user1,team1,18,1447683063000,2015-11-16 14:11:03.921",
    "user2,team2,2,1447690263000,2015-11-16 16:11:03.955",
    "user3,team3,8,1447690263000,2015-11-16 16:11:03.955",
    "user3,team3,5,1447690263000,2015-11-16 16:11:03.959",
    "user4,team3,5,1447690263000,2015-11-16 16:11:03.959",
    "user1,team1,14,1447697463000,2015-11-16 18:11:03.955",
]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_golden_user_score(spark):
    out = user_score(lines(spark, GOLDEN), as_list=True).collect()
    got = {r["user"]: list(r["scores"]) for r in out}
    assert got == {"user1": [14, 18, 18], "user2": [2], "user3": [3, 5, 8], "user4": [2, 5]}


def test_golden_team_scores(spark):
    ev = parse_game_event(lines(spark, GOLDEN))
    got = {r["team"]: list(r["scores"]) for r in scores_by_field(ev, "team", as_list=True).collect()}
    assert got == {"team1": [14, 18, 18], "team2": [2], "team3": [2, 3, 5, 5, 8]}


def test_runs_form_equals_list_form(spark):
    ev = parse_game_event(lines(spark, GOLDEN))
    runs = {(r["user"], r["score"], r["n"]) for r in scores_by_field(ev, "user").collect()}
    assert ("user1", 18, 2) in runs and ("user1", 14, 1) in runs and len(runs) == 8


def test_event_time_is_exact_millis(spark):
    ev = parse_game_event(lines(spark, GOLDEN[:1]))
    r = ev.select(F.unix_millis("event_time").alias("ms")).first()
    assert r["ms"] == 1447679463000


def test_parse_rejects_and_accepts(spark):
    rows = ["", "bad,row", "a,b,1.5,5", "a,b,1_0,5", "a,b,3,x", "a,b,99999999999999999999,1",
            "a,b, 7 ,+5", '"a,b",c,4,5', "a,b,+5,6", "a,b,3,4"]
    obs = Observation("parse")
    ok = parse_game_event(lines(spark, rows), observation=obs).collect()
    assert sorted((r["user"], r["score"]) for r in ok) == [
        ("a", 3), ("a", 5), ("a", 7), ("a,b", 4)]
    assert obs.get["num_parse_errors"] == 6
    rej = {r["value"]: r["reason"] for r in game_event_rejects(lines(spark, rows)).collect()}
    assert rej == {"": "too_few_fields", "bad,row": "too_few_fields", "a,b,1.5,5": "bad_score",
                   "a,b,1_0,5": "bad_score", "a,b,3,x": "bad_time",
                   "a,b,99999999999999999999,1": "bad_score"}


def test_empty_fields_are_empty_strings(spark):
    ok = parse_game_event(lines(spark, [",,3,4"])).collect()
    assert ok[0]["user"] == "" and ok[0]["team"] == ""


def test_total_score_and_text(spark):
    ev = parse_game_event(lines(spark, GOLDEN))
    t = total_score(ev, "user").select(format_score(F.col("user"), F.col("total_score")).alias("t"))
    assert sorted(r["t"] for r in t.collect())[0] == "user: user1, total_score: 50"


def test_format_score_of_list(spark):
    out = user_score(lines(spark, GOLDEN), as_list=True).where("user = 'user1'")
    text = out.select(format_score(F.col("user"), F.col("scores"), "array<bigint>")).first()[0]
    assert text == "user: user1, total_score: [14, 18, 18]"


def test_merge_sorted_flattens_nested_lists(spark):
    df = spark.createDataFrame([("k", [[3, 1], [2]]), ("k", [[0]])],
                               "key string, v array<array<bigint>>")
    assert merge_sorted(df, "key", "v", as_list=True).first()["values"] == [0, 1, 2, 3]
    df1 = spark.createDataFrame([("k", [3, 1]), ("k", [2])], "key string, v array<bigint>")
    assert merge_sorted(df1, "key", "v", as_list=True).first()["values"] == [1, 2, 3]


def test_group_values_multiset(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in group_values(df, "k", "v").collect()) == [("a", 1, 2), ("b", 2, 1)]
