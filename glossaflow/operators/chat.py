"""A provider for services with a chat-completions interface.

Where the service is, which model it runs and where its key is found are
parameters. It runs inside the tasks of ``translate``; a reply that is no whole
JSON is asked for again with what was wrong with it.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from glossaflow.functions.text import REVISE_GUIDES, TRANSLATE_GUIDES
from glossaflow.plans.config import Settings, known_style

Answer = tuple[int, str, str | None]  # status, body, Retry-After
COMPLETIONS = "/chat/completions"


@dataclass(frozen=True)
class Service:
    """Where a service is, the environment variable of its key, and what its models take."""

    url: str
    key_name: str
    schema: Callable[[str], bool]
    one_by_one: Callable[[str], bool] = lambda model: False


def _is_pure_translator(model: str) -> bool:
    return "qwen-mt" in model.lower()


def _follows_schema(model: str) -> bool:
    """Whether a model of the family takes a JSON schema, by the parts of its name."""
    model = model.lower()
    named = any(model in known or known in model for known in SCHEMA_MODELS)
    return named or "qwen" in model and "mt" not in model and any(size in model for size in ("max", "plus", "turbo"))


# Public services with this interface, and models known to take a JSON schema.
SCHEMA_MODELS = ("qwen-max", "qwen-plus", "qwen-turbo", "qwen2.5-72b-instruct", "qwen2.5-vl-72b-instruct")
SERVICES = {
    "openai": Service("https://api.openai.com/v1", "OPENAI_API_KEY", lambda model: True),
    "deepseek": Service("https://api.deepseek.com/v1", "DEEPSEEK_API_KEY", lambda model: False),
    "dashscope": Service("https://dashscope.aliyuncs.com/compatible-mode/v1", "DASHSCOPE_API_KEY", _follows_schema, _is_pure_translator),
    "dashscope-mt": Service("https://dashscope.aliyuncs.com/compatible-mode/v1", "DASHSCOPE_API_KEY", _follows_schema, _is_pure_translator),
}
RULES = (
    "Translate into simplified Chinese, faithfully and in full. Answer with JSON of the given schema and nothing else. "
    "Keep every token of the form ⟦PH:000000⟧ as it is and as often. Use the given terms; those with force are binding, "
    "and a target with its source in brackets keeps the brackets."
)
SCHEMA = {
    "type": "object", "required": ["results"], "additionalProperties": False,
    "properties": {"results": {"type": "array", "items": {"type": "object", "required": ["id", "translated_text"], "additionalProperties": False, "properties": {"id": {"type": "string"}, "translated_text": {"type": "string"}}}}},
}


class ReplyError(ValueError):
    """A reply that isn't what was asked for."""


def parse_reply(content: str, expected: list[str]) -> dict[str, str]:
    text = content.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].strip().removesuffix("```")
    try:
        results = json.loads(text)["results"]
        pairs = [(str(r["id"]), r["translated_text"]) for r in results]
    except (ValueError, KeyError, TypeError) as e:
        raise ReplyError(f"not of the schema: {e}") from e
    if any(not i or not isinstance(t, str) for i, t in pairs):
        raise ReplyError("id or translated_text is missing")
    if len(dict(pairs)) < len(pairs):
        raise ReplyError("an id occurs twice")
    if set(dict(pairs)) != set(expected):
        raise ReplyError("the ids are not those that were sent")
    return dict(pairs)


def post(url: str, key: str, body: dict, timeout: float) -> Answer:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode(), None
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace"), e.headers.get("Retry-After")


@dataclass
class ChatProvider:
    url: str
    model: str
    key_name: str  # environment variable that holds the key
    schema: bool = True  # ask for the JSON schema, else for JSON
    one_by_one: bool = False  # a text a call, plain text back: for pure translation models
    settings: Settings = field(default_factory=Settings)
    key: str = field(default="", repr=False)  # else the environment's
    send: Callable[[str, str, dict, float], Answer] = post
    sleep: Callable[[float], None] = time.sleep

    def translate(self, rows: list[dict], hits: list[dict]) -> dict[str, str]:
        if self.one_by_one:
            return {r["segment_id"]: self._ask([{"role": "user", "content": r["source_text"]}], lambda c: c, {"translation_options": {"source_lang": "auto", "target_lang": "Chinese"}}) for r in rows}
        shown = [{"id": r["segment_id"], "text": r["source_text"]} for r in rows]
        return self._batch("draft_translate", TRANSLATE_GUIDES, shown, hits)

    def revise(self, rows: list[dict], drafts: dict[str, str], hits: list[dict]) -> dict[str, str]:
        if self.one_by_one:
            return drafts
        shown = [{"id": r["segment_id"], "source": r["source_text"], "draft": drafts.get(r["segment_id"], "")} for r in rows]
        return self._batch("revise_translation", REVISE_GUIDES, shown, hits)

    # The names in a request.
    def _batch(self, task: str, guides: dict[str, str], shown: list[dict], hits: list[dict]) -> dict[str, str]:
        payload = {"task": task, "style_guide": guides[known_style(self.settings["style"])], "termbase_hits": hits, "segments": shown, "source_lang": "auto", "target_lang": "Simplified Chinese"}
        messages = [{"role": "system", "content": RULES}, {"role": "user", "content": json.dumps(payload, ensure_ascii=False)}]
        form = {"type": "json_schema", "json_schema": {"name": "results", "strict": True, "schema": SCHEMA}} if self.schema else {"type": "json_object"}
        return self._ask(messages, lambda c: parse_reply(c, [s["id"] for s in shown]), {"response_format": form})

    def _ask(self, messages: list[dict], read: Callable, extra: dict):
        key = self.key or os.environ.get(self.key_name)
        if not key:
            raise RuntimeError(f"{self.key_name} is not set")
        body = {"model": self.model, "messages": messages, "temperature": self.settings["llm.temperature"], **extra}
        backoff, wrong = self.settings["llm.retry_backoff_seconds"] or [1], ""
        attempts = self.settings["llm.max_retries"]
        for i in range(attempts):
            if wrong and messages[0]["role"] == "system":
                body["messages"] = [{"role": "system", "content": f"{messages[0]['content']} The last reply was wrong: {wrong}"}, *messages[1:]]
            wait = float(backoff[min(i, len(backoff) - 1)])
            try:
                status, text, after = self.send(self.url, key, body, self.settings["llm.timeout_seconds"])
                if status == 400 and "temperature" in text.lower() and "unsupported" in text.lower() and "temperature" in body:
                    del body["temperature"]
                    status, text, after = self.send(self.url, key, body, self.settings["llm.timeout_seconds"])
                if status == 400 and "json_schema" in text.lower() and "unsupported" in text.lower() and self.schema:
                    body["response_format"] = {"type": "json_object"}
                    status, text, after = self.send(self.url, key, body, self.settings["llm.timeout_seconds"])
                if status < 300:
                    return read(json.loads(text)["choices"][0]["message"]["content"])
                wrong = f"status {status}: {text[:300]}"
                if status == 429:
                    wait = float(after) if after else max(wait, 2.0 ** (i + 2))
            except (OSError, ValueError, KeyError, IndexError) as e:
                wrong = str(e)
            self.sleep(wait)
        raise RuntimeError(f"no fit reply after {attempts} attempts: {wrong}")


def key_of(service: str) -> str:
    """The key of a service, from the environment."""
    name = SERVICES[service].key_name
    if not os.environ.get(name):
        raise RuntimeError(f"{name} is not set")
    return os.environ[name]


def service_provider(service: str, model: str, settings: Settings, key: str = "") -> ChatProvider:
    """A provider for a service by its name; what the request looks like follows from the model."""
    s = SERVICES[service]
    return ChatProvider(s.url + COMPLETIONS, model, s.key_name, s.schema(model), s.one_by_one(model), settings, key)
