"""The chat provider against scripted answers."""

import json

import pytest

from glossaflow.operators.chat import ChatProvider, ReplyError, parse_reply, service_provider
from glossaflow.plans.config import Settings

ROWS = [{"segment_id": "1", "source_text": "a"}]


def reply(content):
    return 200, json.dumps({"choices": [{"message": {"content": content}}]}), None


GOOD = json.dumps({"results": [{"id": "1", "translated_text": "甲"}]})


@pytest.fixture
def service(monkeypatch):
    monkeypatch.setenv("TEST_KEY", "k")

    def make(answers, **options):
        sent, waits, script = [], [], iter(answers)

        def send(url, key, body, timeout):
            sent.append(json.loads(json.dumps(body)))
            answer = next(script)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return ChatProvider("http://localhost/chat", "m", "TEST_KEY", send=send, sleep=waits.append, **options), sent, waits

    return make


def test_draft_and_revision(service):
    p, sent, _ = service([reply(f"```json\n{GOOD}\n```"), reply(GOOD)], settings=Settings({"style": "concise_cn"}))
    assert p.revise(ROWS, p.translate(ROWS, [{"source": "a"}]), []) == {"1": "甲"}
    first, second = (json.loads(s["messages"][1]["content"]) for s in sent)
    assert first["style_guide"] == "concise_zh_hans" and first["termbase_hits"] == [{"source": "a"}]
    assert second["segments"] == [{"id": "1", "source": "a", "draft": "甲"}]


def test_errors_are_fed_back_and_waited_for(service):
    p, sent, waits = service([reply("{}"), (429, "slow", None), (429, "slow", "9"), OSError("down"), reply(GOOD)])
    assert p.translate(ROWS, []) == {"1": "甲"}
    assert waits == [2.0, 8.0, 9.0, 16.0]
    assert "wrong" not in sent[0]["messages"][0]["content"] and "schema" in sent[1]["messages"][0]["content"]


def test_temperature_is_dropped_where_unsupported(service):
    p, sent, _ = service([(400, "Temperature is unsupported", None), reply(GOOD)], schema=False)
    assert p.translate(ROWS, []) == {"1": "甲"}
    assert "temperature" not in sent[1] and sent[1]["response_format"] == {"type": "json_object"}


def test_one_by_one(service):
    p, sent, _ = service([reply("甲")], one_by_one=True)
    assert p.revise(ROWS, p.translate(ROWS, []), []) == {"1": "甲"} and len(sent) == 1


def test_it_gives_up(service, monkeypatch):
    p, _, waits = service([(500, "x", None)] * 3, settings=Settings({"llm": {"max_retries": 3, "retry_backoff_seconds": [1, 5]}}))
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        p.translate(ROWS, [])
    assert waits == [1.0, 5.0, 5.0]
    monkeypatch.delenv("TEST_KEY")
    with pytest.raises(RuntimeError, match="TEST_KEY"):
        p.translate(ROWS, [])


@pytest.mark.parametrize("bad", ["no json", '{"results": 1}', '{"results": [{"id": "1"}]}', '{"results": [{"id": "1", "translated_text": 2}]}', '{"results": []}', json.dumps({"results": [{"id": "1", "translated_text": "x"}] * 2})])
def test_unfit_replies(bad):
    with pytest.raises(ReplyError):
        parse_reply(bad, ["1"])


def test_a_schema_is_given_up_where_unsupported(service):
    p, sent, _ = service([(400, "json_schema is unsupported", None), reply(GOOD)])
    assert p.translate(ROWS, []) == {"1": "甲"}
    assert [s["response_format"]["type"] for s in sent] == ["json_schema", "json_object"]


@pytest.mark.parametrize(
    "service,model,schema,single",
    [
        ("openai", "any", True, False), ("deepseek", "any", False, False), ("dashscope", "qwen-plus-latest", True, False), ("dashscope", "qwen3-turbo", True, False),
        ("dashscope", "qwen-mt-plus", False, True), ("dashscope-mt", "Qwen-MT-flash", False, True), ("dashscope", "llama", False, False),
    ],
)
def test_services_by_model(service, model, schema, single):
    p = service_provider(service, model, Settings())
    assert (p.schema or single) == (schema or single) and p.one_by_one is single
    assert p.url.endswith("/chat/completions") and p.key_name.endswith("_API_KEY")
