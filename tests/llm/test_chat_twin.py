"""The query and its SQL twin on conversations of many rows or many participants."""

import check_queries
import duckdb

from shelfwatch.llm import queries


def compare(spark, rows, folder):
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = queries.QUERIES["op1_chat_perspectives"](spark, str(folder)).toPandas()
    want = con.sql(queries.ORACLES["op1_chat_perspectives"]).df()
    assert check_queries.canonical(got) == check_queries.canonical(want)
    return got


def test_repeated_turn_numbers_give_pieces(spark, tmp_path):
    rows = [(1, i % 8, "user" if i % 2 else "bot", f"say {i:04}") for i in range(201)] + [(None, None, None, None), (None, 3, "<|x", "t<|y")]
    got = compare(spark, rows, tmp_path)
    assert sorted(got[got.conv_id == 1].piece) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_very_many_participants(spark, tmp_path):
    """Each in one conversation of a few turns besides, so that all of them are rendered over and over in no row."""
    rows = [(1, 0, f"p{i:06}", "hi") for i in range(60)] + [(2, 0, "system", "long " * 200_000), (2, 1, "user", "x")]
    got = compare(spark, rows, tmp_path)
    assert len(got) == 61 and got.text.str.len().max() > 900_000


def test_participants_are_rows(spark):
    """100,000 participants: the plan joins them, and no array holds them."""
    from shelfwatch.llm import chat

    ids = spark.range(100_000)
    turns = ids.selectExpr("1L AS conv_id", "id AS turn", "concat('p', id) AS role", "'hi' AS text")
    few = chat.perspectives(turns.where("turn < 64 OR turn >= 99968"))
    assert few.count() == 96 * 2 and "cast" not in few.columns
    assert "collect_set" not in few._jdf.queryExecution().optimizedPlan().toString()
