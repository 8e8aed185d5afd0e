"""The boundary to language models: a backend protocol, a registry, and operators that call it in batches.

A backend is made once per partition from its configuration. A call that fails gives an empty reply and its error; what an answer then says is the caller's to state. Tasks may be run again, so a prompt may be sent twice; backends of temperature 0 or with a
store of answers make that harmless.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkg.schema import KG

#: The extraction prompt; ``{text}`` is the only slot.
EXTRACT_PROMPT = (
    "Extract the entities and the relations between them from the text below. Reply with one JSON object only:\n"
    '{"entities": [{"name": "...", "type": "..."}], "relations": [{"head": "...", "relation": "...", "tail": "..."}]}\nText:\n{text}'
)
EXTRACT_SYSTEM = "You extract information precisely."
ANSWER_SYSTEM = "You answer questions about disasters from a knowledge graph."
ANSWER_PROMPT = "Answer the question from the known facts only, and say so where they don't suffice.\nQuestion: {question}\nKnown facts:\n{context}\nAnswer:"
JSON_TEMPERATURE = 0.1


class Backend(Protocol):
    def chat(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str: ...


class OfflineBackend:
    """Deterministic, without a network: extraction finds months, answers repeat the first line of the facts and read no more of them."""

    first_line = True

    def __init__(self, config: dict) -> None:
        self.config = config

    def chat(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        if json_mode:
            text = prompt.split("\nText:\n", 1)[-1]
            names = dict.fromkeys(re.findall("[0-9]{4}年[0-9]{1,2}月", text))
            return json.dumps({"entities": [{"name": n, "type": "时间"} for n in names], "relations": []}, ensure_ascii=False)
        return prompt.split("\nKnown facts:\n", 1)[-1].removesuffix("\nAnswer:").split("\n")[0]


class HttpBackend:
    """A chat-completions service; address, model and the name of the key's environment variable come from the configuration, the key from the environment only."""

    def __init__(self, config: dict) -> None:
        from strandkg.sources.readers import secret

        if not config.get("url"):
            raise ValueError("the configuration of a service needs its url")
        self.config, self.key = config, secret(config.get("key_name", "LLM_API_KEY"))

    def body(self, prompt: str, system: str | None, json_mode: bool) -> dict:
        kind = {"response_format": {"type": "json_object"}} if json_mode else {}
        return {"model": self.config.get("model_name", ""), "messages": message_list(prompt, system), "temperature": JSON_TEMPERATURE if json_mode else self.config.get("temperature", 0.1)} | kind

    def headers(self) -> dict:
        return {"Authorization": f"Bearer {self.key}"}

    def reply(self, answer: dict) -> str:
        return answer["choices"][0]["message"]["content"]

    def chat(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        import urllib.request

        request = urllib.request.Request(self.config["url"], json.dumps(self.body(prompt, system, json_mode)).encode(), {"Content-Type": "application/json"} | self.headers())
        with urllib.request.urlopen(request, timeout=self.config.get("timeout", 120)) as reply:
            return self.reply(json.load(reply))


class FoldedHttpBackend(HttpBackend):
    """A generate-content service without a system role: the system message goes in front of the prompt, and the temperature is the service's own, whatever the configuration says."""

    TEMPERATURE = 0.7

    def body(self, prompt: str, system: str | None, json_mode: bool) -> dict:
        settings = {"temperature": JSON_TEMPERATURE if json_mode else self.TEMPERATURE, "responseMimeType": "application/json" if json_mode else "text/plain"}
        return {"contents": [{"role": "user", "parts": [{"text": folded(prompt, system)}]}], "generationConfig": settings}

    def headers(self) -> dict:
        return {self.config.get("key_header", "x-goog-api-key"): self.key}

    def reply(self, answer: dict) -> str:
        return "".join(part.get("text", "") for part in answer["candidates"][0]["content"]["parts"])


BACKENDS: dict[str, Callable[[dict], Backend]] = {"offline": OfflineBackend, "http": HttpBackend, "http_folded": FoldedHttpBackend}


def check_provider(config: dict) -> None:
    """An error here, where the configuration is read, rather than in the tasks."""
    if (name := config.get("provider", "offline")) not in BACKENDS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(BACKENDS))}; register a backend of that name in chat.BACKENDS, or run with the offline stand-ins")


def make_backend(config: dict) -> Backend:
    check_provider(config)
    return BACKENDS[config.get("provider", "offline")](config)


def reads_first_line(config: dict, **prompts: str) -> bool:
    """Whether the answers of the backend depend on nothing but the first line of a context, so that the others need not be made. Other prompts than the built-in one may show more of it."""
    check_provider(config)
    return "prompt" not in prompts and getattr(BACKENDS[config.get("provider", "offline")], "first_line", False)


def folded(prompt: str, system: str | None = None) -> str:
    """One text where a service has no system role."""
    return f"System: {system}\nUser: {prompt}" if system else prompt


def message_list(prompt: str, system: str | None = None) -> list[dict]:
    return [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]


def messages(prompt: Column, system: Column) -> Column:
    """The message list as a column: the system message first, where there is one."""
    user = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.when(system.isNotNull() & (system != ""), F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), user)).otherwise(user)


def fill(template: str, **columns: Column) -> Column:
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def chat(prompts: DataFrame, key: str, config: dict, json_mode: bool = False, system: str | None = None) -> DataFrame:
    """(key, reply, latency, error) of ``prompts`` (key, prompt); ``error`` is null where the call went well."""
    check_provider(config)
    factory = BACKENDS[config.get("provider", "offline")]  # sent along, so that registering one at the driver is enough

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = None
        for batch in batches:
            backend = backend or factory(config)
            replies, took, errors = [], [], []
            for prompt in batch.column("prompt").to_pylist():
                began, error = time.monotonic(), None
                try:
                    replies.append(backend.chat(prompt or "", system, json_mode) or "")
                except Exception as e:  # noqa: BLE001 - whatever a service does, the other rows go on
                    replies.append("")
                    error = f"{type(e).__name__}: {e}"
                took.append(time.monotonic() - began)
                errors.append(error)
            columns = [batch.column(key), pa.array(replies, pa.string()), pa.array(took, pa.float64()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "reply", "latency", "error"])

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, "prompt").mapInArrow(run, f"`{key}` {kind}, reply string, latency double, error string")


def parse_extraction(reply: Column) -> Column:
    """The extraction result of a reply: empty arrays where it can't be read or has no such part."""
    found = F.from_json(reply, KG)
    empty_e, empty_r = F.array().cast(KG["entities"].dataType), F.array().cast(KG["relations"].dataType)
    return F.struct(F.coalesce(found["entities"], empty_e).alias("entities"), F.coalesce(found["relations"], empty_r).alias("relations"))


def extract(texts: DataFrame, config: dict, prompt: str = EXTRACT_PROMPT, system: str = EXTRACT_SYSTEM, fallback: DataFrame | None = None) -> DataFrame:
    """(doc_id, extraction_result, latency, status) of texts (doc_id, text).

    ``status`` is ``ok``, or ``empty`` where no entity was found. Then the result is that of ``fallback`` (one row: entities, relations), where given, and the status ``fallback``.
    """
    asked = texts.select("doc_id", fill(prompt, text=F.col("text")).alias("prompt"))
    found = chat(asked, "doc_id", config, json_mode=True, system=system).select("doc_id", parse_extraction(F.col("reply")).alias("extraction_result"), "latency")
    empty = F.size("extraction_result.entities") == 0
    if fallback is None:
        return found.select("*", F.when(empty, "empty").otherwise("ok").alias("status"))
    instead = F.from_json(F.lit(fallback.select(F.to_json(F.struct("entities", "relations"))).first()[0]), KG)  # one row
    return found.select("doc_id", F.when(empty, instead).otherwise(F.col("extraction_result")).alias("extraction_result"), "latency", F.when(empty, "fallback").otherwise("ok").alias("status"))


def answer(contexts: DataFrame, config: dict, prompt: str = ANSWER_PROMPT, system: str = ANSWER_SYSTEM, failed: str = "") -> DataFrame:
    """(qid, draft_answer) of contexts (qid, text, context, status); a question without context is answered by its sentinel, not by the model, one whose call failed by ``failed``."""
    asked = contexts.where("status = 'ok'").select("qid", fill(prompt, question=F.col("text"), context=F.col("context")).alias("prompt"))
    replied = chat(asked, "qid", config, system=system).select("qid", F.when(F.col("error").isNull(), F.col("reply")).otherwise(F.lit(failed)).alias("draft_answer"))
    return replied.unionByName(contexts.where("status <> 'ok'").select("qid", F.col("context").alias("draft_answer")))
