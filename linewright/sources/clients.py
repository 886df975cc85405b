"""Clients of services: a model that answers prompts, a tagger of lines.

Both are plain callables that go to the workers.  Requests have a timeout and are tried again
on errors of the network, of the server (5xx) and of its limits (429); when the tries are used up
the answer is empty, which the plan treats as missing lines.  Nothing is sent that the caller did not give.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


class ServiceError(Exception):
    """A request that trying again does not help."""


def post(url: str, body: dict, headers: dict[str, str], timeout: float, tries: int, wait: float) -> dict | None:
    """The answer as JSON; None if all tries fail."""
    data = json.dumps(body).encode()
    for k in range(tries):
        try:
            request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429:
                raise ServiceError(f"status {e.code}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError):
            pass
        if k + 1 < tries:
            time.sleep(wait * 2**k)
    return None


@dataclass(frozen=True)
class ChatModel:
    """Prompts to a chat service: (number, jsonl, attempt) -> text, from the prompt that the plan made."""

    url: str
    model: str
    key: str = field(default="", repr=False)
    timeout: float = 120.0
    tries: int = 3
    wait: float = 0.5
    system: str = ""

    def ask(self, prompt: str, max_tokens: int) -> str:
        said = [{"role": "system", "content": self.system}] if self.system else []
        body = {"model": self.model, "messages": [*said, {"role": "user", "content": prompt}], "max_tokens": max_tokens}
        answer = post(self.url, body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout, self.tries, self.wait)
        try:
            return answer["choices"][0]["message"]["content"] or ""
        except (TypeError, KeyError, IndexError):
            return ""

    def __call__(self, number: int, jsonl: str, attempt: int) -> str:
        return self.ask(jsonl, 12_000)


def ask_all(batches: DataFrame, model: ChatModel, at_once: int = 4) -> DataFrame:
    """batches (prompt, max_tokens, ...) plus response, with so many requests of a task at a time."""

    def call(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                get = lambda n: part.column(part.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
                out = list(pool.map(model.ask, get("prompt"), get("max_tokens")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "response"])

    return batches.mapInArrow(call, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema) + ", response string")


@dataclass(frozen=True)
class TagService:
    """Entities of lines from a service: POST {"texts": [...]} answers {"results": [[{text, label, score, start, end}]]}."""

    url: str
    timeout: float = 60.0
    tries: int = 3
    wait: float = 0.5

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(self.url.rstrip("/") + "/health", timeout=self.timeout) as r:
                return 200 <= r.status < 300
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            return False

    def entities(self, lines: Sequence[str]) -> list[list[dict]]:
        """One list a line; a request that fails for good gives empty lists."""
        try:
            answer = post(self.url.rstrip("/") + "/predict", {"texts": list(lines)}, {}, self.timeout, self.tries, self.wait)
            found = answer["results"]
        except (ServiceError, TypeError, KeyError):
            return [[] for _ in lines]
        return found if len(found) == len(lines) else [[] for _ in lines]


def service_entities(lines: DataFrame, service: TagService, key: str = "doc_id", size: int = 16) -> DataFrame:
    """key, line_no, text, label, score, start and end of the entities of lines."""
    from pyspark.sql import functions as F

    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("score", pa.float32()), ("start", pa.int32()), ("end", pa.int32())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            found = [e for k in range(0, len(texts), size) for e in service.entities(texts[k : k + size])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=[key, "line_no", "e"])

    rows = lines.select(key, "line_no", "line")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, line_no bigint, e array<struct<text:string,label:string,score:float,start:int,end:int>>"
    return rows.withColumn("line_no", F.col("line_no").cast("long")).mapInArrow(tag, schema).select(key, "line_no", F.explode("e").alias("e")).select(key, "line_no", "e.*")
