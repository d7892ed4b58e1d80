import json

from narravane.sources import landed


def test_bot_list_logs_and_jobs(spark, tmp_path):
    (tmp_path / "bots.tsv").write_text("# list\n12\tspam\n\n 13 \t amp \n14\n\tx\n")
    assert sorted(tuple(r) for r in landed.bot_list(spark, str(tmp_path / "bots.tsv")).collect()) == [("12", "spam"), ("13", "amp")]
    (tmp_path / "log.jsonl").write_text('{"event": "seen", "post_id": "1"}\nnot json\n{"event": "new", "post_id": "2"}\n')
    assert sorted(r.post_id for r in landed.json_lines(spark, str(tmp_path / "log.jsonl"), landed.SIGHTING).collect()) == ["1", "2"]
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [{"narrative_name": "n", "platform": "x", "keywords": ["a", "b"], "limit": 5}]}, indent=1))
    (job,) = landed.jobs(spark, str(tmp_path / "jobs.json")).collect()
    assert (job.narrative_name, job.keywords, job.limit, job.rotation_strategy) == ("n", ["a", "b"], 5, None)


def _entry(post_id, author, text, **legacy):
    legacy = {"full_text": text, "created_at": "Wed Oct 10 20:19:24 +0000 2018"} | legacy
    return {"rest_id": post_id, "core": {"user_results": {"result": {"rest_id": author, "legacy": {"screen_name": f"@{author}"}}}}, "legacy": legacy}


def test_timeline_flattens_wrapped_and_nested_posts(spark):
    content = lambda r: {"itemContent": {"tweet_results": {"result": r}}}
    long = _entry("2", "b", "short") | {"note_tweet": {"note_tweet_results": {"result": {"text": "long form"}}}}
    retweet = _entry("3", "c", "rt", retweeted_status_result={"result": {"rest_id": "1", "core": {"user_results": {"result": {"rest_id": "a"}}}}}, quoted_status_id_str="9")
    entries = [
        {"entryId": "t1", "content": content(_entry("1", "a", "hello", in_reply_to_status_id_str="77", in_reply_to_user_id_str="z"))},
        {"entryId": "t2", "content": {"items": [{"item": content({"tweet": long})}, {"item": content(retweet)}]}},
        {"entryId": "gone", "content": content({"tombstone": {}})},
        {"entryId": "cursor", "content": {"cursorType": "Bottom", "value": "next"}},
    ]
    body = json.dumps({"data": {"search_by_raw_query": {"search_timeline": {"timeline": {"instructions": [{"entries": entries}]}}}}})
    frame = spark.createDataFrame([(body,), ("broken",)], "body string")
    posts = {r.external_id: r for r in landed.timeline(frame).collect()}
    assert sorted(posts) == ["1", "2", "3"] and posts["2"].text == "long form" and str(posts["1"].posted_at) == "2018-10-10 20:19:24"
    assert [r.cursor for r in landed.bottom_cursor(frame).collect()] == ["next"]
    edges = sorted((r.external_id, r.kind, r.target_post, r.target_author) for r in landed.interactions(landed.timeline(frame)).collect())
    assert edges == [("1", "reply", "77", "z"), ("3", "retweet", "1", "a")]
    assert [r.external_id for r in landed.missing_targets(landed.timeline(frame)).collect()] == ["77"]


def test_boosts_quota_and_first_seen(spark):
    schema = "id string, account struct<id: string>, content string, reblog struct<id: string, account: struct<id: string>, content: string>"
    rows = [("1", ("a",), "own", None), ("2", ("b",), "", ("9", ("z",), "original"))]
    got = sorted((r.external_id, r.author_id, r.boost_of) for r in landed.statuses_with_boosts(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "a", None), ("2", "b", "9"), ("9", "z", None)]
    seen = spark.createDataFrame([("p", 2, 0), ("p", 1, 0), ("q", 1, 1), ("r", 3, 0)], "external_id string, query int, pos int")
    assert [(r.external_id, r.query) for r in landed.first_seen(seen, ["query", "pos"], 2).collect()] == [("p", 1), ("q", 1)]
    assert landed.quota(seen, "external_id", ["query"], 1).count() == 3
    assert landed.synthetic_posts(spark, 20).select("author_id").distinct().count() == 7
