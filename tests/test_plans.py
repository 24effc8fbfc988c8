"""Costly steps stand once in their plans."""

from spanloom import fixtures
from spanloom.operators import windows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_become_words_once(spark):
    raw = spark.createDataFrame([(1, 0, "a b c."), (1, 1, "d, e"), (2, 0, " "), (2, 5, "f")], "video_id long, seg_idx int, text string")
    rows = fixtures.words(raw)
    assert plan(rows).count("Generate posexplode") == 1
    assert [(r.video_id, r.seg_idx, r.word_idx) for r in rows.orderBy("video_id", "start").collect()] == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 1, 1), (2, 5, 0)]


def test_replies_are_read_once(spark):
    given = [(1, 0, '{"title": "t", "scores": {"hook": 90}}'), (1, 1, '{"scores": [1]}'), (1, 2, "no"), (1, 3, None), (1, 4, '{"reason": "bare"}')]
    replies = spark.createDataFrame(given, "video_id long, window_idx int, reply_json string")
    spans = replies.selectExpr("video_id", "window_idx", "0.0 as start", "9.0 as end")
    rows = windows.read_window_replies(spans, replies)
    assert plan(rows).count("from_json(") == 2
    assert [(r.window_idx, r.title, r.scores["hook"]) for r in rows.orderBy("window_idx").collect()] == [(0, "t", 90), (2, "Untitled", 0), (4, "Untitled", 0)]
