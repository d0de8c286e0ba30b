"""Prompt, request, response, pruning, choice; the call seam."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import model
from docloom.operators import enrichment


def parsed(spark, responses):
    df = spark.createDataFrame(list(enumerate(responses)), "i int, response string")
    entries = model.parse_response(F.col("response"))
    shown = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"), model.is_blank_value(e["value"]).alias("b")),
    )
    rows = sorted(df.select("i", shown.alias("e")).collect())
    return [None if r.e is None else [(x.k, x.v, x.b) for x in r.e] for r in rows]


def slow_parse(response):
    """The object at the first brace, by the standard decoder."""
    at = response.find("{")
    if at < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(response, at)[0]
    except ValueError:
        return None


PARSE_CASES = [
    'Here: {"a": 1} done',
    '{"a": "x", "b": [1, null], "c": {"d": true}}',
    "no json",
    '{"k": ',
    '{bad} {"a": 1}',
    "{}",
    '{"a": "", "b": null, "c": [], "d": {}, "e": 0, "f": false, "g": "{}", "h": "[]", "i": [null], "j": " "}',
    '{"a": 1, "b": 2, "a": 3}',
    '{"z": 1, "y": 1, "z": 2, "y": 2, "x": 0}',
    "{'a': 1}",
    '```json\n{"a": "é😀"}\n```',
    '{"a": 1} {"a": 2}',
    '{"a": "tab\tinside"}',
    '{"a": {"b": {"c": []}}}',
    "",
]


def test_parse_and_prune(spark):
    got = parsed(spark, PARSE_CASES)
    for response, entries in zip(PARSE_CASES, got):
        want = slow_parse(response)
        assert (entries is None) == (want is None), response
        if want is not None:
            assert [(k, json.loads(v)) for k, v, _ in entries] == list(want.items()), response
            kept = {k: v for k, v in want.items() if not (v is None or v == "" or v == [] or v == {})}
            assert [k for k, _, blank in entries if not blank] == list(kept), response


def test_parse_random_objects(spark):
    rng = random.Random(3)

    def value(depth):
        pick = rng.randrange(8 if depth else 6)
        return [None, "", "{}", rng.randrange(9), bool(pick), rng.choice("abc"), None, None][pick] if pick < 6 else (
            [value(depth - 1) for _ in range(rng.randrange(3))]
            if pick == 6
            else {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(3))}
        )

    def body():
        members = [(rng.choice("abcd"), value(2)) for _ in range(rng.randrange(6))]
        text = "{" + ", ".join(f'"{k}": {json.dumps(v)}' for k, v in members) + "}"
        return rng.choice(["", "So: "]) + text[: rng.choice([len(text)] * 4 + [len(text) // 2])] + rng.choice(["", " end", "}"])

    responses = [body() for _ in range(1500)]
    for response, entries in zip(responses, parsed(spark, responses)):
        want = slow_parse(response)
        if want is None:
            assert entries is None, response
        else:
            assert [(k, json.loads(v)) for k, v, _ in entries] == list(want.items()), response


def test_truncation_counts_characters(spark):
    texts = ["a" * 2000, "a" * 2001, "😀" * 2000, "😀" * 2001, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(model.truncate(F.col("t"))).collect()]
    assert got == [t if len(t) <= 2000 else t[:2000] + "\n[truncated]" for t in texts]


def test_request_body(spark):
    df = spark.createDataFrame([(1, 'Say "hi"\nÜ')], "doc_id int, cleaned_text string")
    body = json.loads(enrichment.requests(df).first().request)
    assert body["messages"][1]["content"].endswith('Document:\nSay "hi"\nÜ')
    assert body["messages"][0]["role"] == "system" and body["stream"] is False
    assert body["options"] == {"temperature": 0, "num_predict": 800, "num_ctx": 2048, "num_gpu": 99}
    assert body["keep_alive"] == "10m"


def stub():
    """A client factory that travels to the workers by value."""

    def factory():
        import json as j

        def client(body):
            text = j.loads(body)["messages"][1]["content"]
            if text.endswith("fail"):
                raise ConnectionError("down")
            return j.dumps({"said": text[-2:]})

        return client

    return factory


def requests(spark):
    rows = [(i, f"doc {i:02d}" if i % 3 else "will fail") for i in range(30)]
    return enrichment.requests(spark.createDataFrame(rows, "doc_id bigint, cleaned_text string"))


def test_failed_calls_give_null_and_go_on(spark):
    rows = enrichment.respond(requests(spark), stub(), concurrency=3).collect()
    got = {r.doc_id: r.response for r in rows}
    assert len(got) == 30
    assert all((got[i] is None) == (i % 3 == 0) for i in range(30))
    assert json.loads(got[7]) == {"said": "07"}


def test_answered_documents_are_not_asked_again(spark):
    first = spark.createDataFrame([(i, "{}") for i in range(25)], "doc_id bigint, response string")
    rows = enrichment.respond(requests(spark), stub(), answered=first).collect()
    assert sorted(r.doc_id for r in rows) == [25, 26, 27, 28, 29]


def test_choice_is_made_before_pruning(spark):
    docs = spark.createDataFrame(
        [(i, [("Name", "rule")]) for i in range(5)], "doc_id int, fields array<struct<key string, value string>>"
    )
    answers = spark.createDataFrame(
        [(0, '{"a": 1}'), (1, '{"a": ""}'), (2, "{}"), (3, None)], "doc_id int, response string"
    )
    rows = enrichment.choose_fields(docs, answers).orderBy("doc_id").select(
        "ai_extraction", "ai_fields", F.to_json(F.map_from_entries("key_fields")).alias("kv")
    ).collect()
    assert [tuple(r) for r in rows] == [
        (True, 1, '{"a":1}'),
        (True, 1, "{}"),
        (False, 0, '{"Name":"rule"}'),
        (False, 0, '{"Name":"rule"}'),
        (False, 0, '{"Name":"rule"}'),
    ]


def test_chat_client(monkeypatch):
    import io
    import urllib.request

    from docloom.sources.models import chat_client

    seen = {}

    def urlopen(post, timeout):
        seen.update(url=post.full_url, body=post.data, timeout=timeout)
        return io.BytesIO('{"message": {"content": " {\\"a\\": \\"é\\"} "}}'.encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    assert chat_client("http://model:1", timeout=5)()('{"x": "é"}') == ' {"a": "é"} '
    assert seen == {"url": "http://model:1/api/chat", "body": '{"x": "é"}'.encode(), "timeout": 5}


def test_slices_go_on_and_failed_calls_are_asked_again(spark, tmp_path):
    """The first call for a document fails; finished slices are not asked again."""
    calls, out = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    folder = str(calls)

    def factory():
        import os
        import uuid

        def client(body):
            before = [f for f in os.listdir(folder) if f.startswith(f"{body}-")]
            open(f"{folder}/{body}-{uuid.uuid4().hex}", "w").close()
            if not before:
                raise TimeoutError
            return f"answer {body}"

        return client

    requests = spark.range(12).selectExpr("id as doc_id", "cast(id as string) as request")
    first = enrichment.respond_in_slices(requests, factory, out, slices=3, concurrency=2)
    assert first.filter("response is null").count() == 12
    again = enrichment.respond_in_slices(requests, factory, out, slices=3, concurrency=2)
    assert again.filter("response is null").count() == 12 and len(list(calls.iterdir())) == 12
    third = enrichment.respond_in_slices(requests, factory, out, slices=3, max_attempts=2)
    assert {r.response for r in third.collect()} == {f"answer {i}" for i in range(12)}
    assert len(list(calls.iterdir())) == 24


def test_calls_in_flight_are_bounded_and_in_order(spark, tmp_path):
    """A slow client with some failing calls: answers in the order of requests, never more calls at once."""
    folder = str(tmp_path)

    def factory():
        import threading
        import time
        import uuid

        lock, state = threading.Lock(), {"now": 0, "most": 0, "tries": {}}

        def client(body):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                tries = state["tries"][body] = state["tries"].get(body, 0) + 1
            time.sleep(0.05 if int(body) % 5 else 0.15)
            with lock:
                state["now"] -= 1
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write(f"{body} {state['most']}")
            if int(body) % 7 == 3 and (tries < 3 or int(body) == 10):
                raise TimeoutError
            return f"answer {body}"

        return client

    requests = spark.range(40).coalesce(1).selectExpr("id as doc_id", "cast(id as string) as request")
    rows = enrichment.respond(requests, factory, in_flight=4, attempts=3, back_off_s=0.01).collect()
    assert [r.doc_id for r in rows] == list(range(40))
    assert {r.doc_id: r.response for r in rows} == {i: None if i == 10 else f"answer {i}" for i in range(40)}
    calls = [f.read_text().split() for f in tmp_path.iterdir()]
    tries = {i: sum(int(b) == i for b, _ in calls) for i in range(40)}
    assert tries == {i: 3 if i % 7 == 3 else 1 for i in range(40)}
    assert 2 <= max(int(most) for _, most in calls) <= 4
    with pytest.raises(ValueError):
        enrichment.respond(requests, factory, in_flight=0)


def test_slices_write_requests_once(spark, tmp_path):
    """Requests are computed in one job, whatever the slices and rounds; later ones are added."""
    out = str(tmp_path / "out")
    computed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        computed.add(1)
        return str(i)

    def factory():
        def client(body):
            raise TimeoutError

        return client

    requests = spark.range(20).select(F.col("id").alias("doc_id"), body("id").alias("request"))
    got = enrichment.respond_in_slices(requests, factory, out, slices=4, max_attempts=3, in_flight=2)
    assert got.count() == 20 and computed.value == 20
    more = spark.range(25).selectExpr("id as doc_id", "cast(id as string) as request")
    got = enrichment.respond_in_slices(more, lambda: lambda body: body, out, slices=4, max_attempts=2)
    assert {r.doc_id: r.response for r in got.collect()} == {i: str(i) for i in range(25)}
