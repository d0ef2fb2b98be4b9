"""Model adapters: something that answers a request. Payloads are never logged."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, functions as F

from ..plans.errors import AdapterError
from ..shipping import ship

TIMEOUT_MS, RETRIES, DELAY_MS = 15_000, 1, 200
RESPONSES = "chunk_index int, schema_name string, response_text string, provider string, error string"


@dataclass(frozen=True)
class Request:
    prompt: str
    schema_name: str
    schema_version: str = "v1"
    timeout_ms: int = TIMEOUT_MS


@dataclass(frozen=True)
class Response:
    text: str
    provider: str
    model: str | None = None
    raw: Any = None


class Adapter(Protocol):
    def generate(self, request: Request) -> Response: ...


Transport = Callable[[str, dict, dict, float], tuple[int, str]]


def http_post(url: str, body: dict, headers: dict, timeout_s: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def _body(model: str, prompt: str, form: str) -> dict:
    return {"model": model, "messages": [{"role": "user", "content": prompt}]} if form == "messages" else {"model": model, "prompt": prompt}


@dataclass(frozen=True)
class LocalHttpAdapter:
    """A local server: reads `response`; tries again on errors, other statuses, no JSON, and blank answers."""

    endpoint: str
    model: str
    headers: dict = field(default_factory=dict)
    body_format: str = "prompt"
    attempts: int = 6
    delay_ms: int = 500
    transport: Transport = http_post

    def generate(self, request: Request) -> Response:
        last = "no attempt"
        for k in range(self.attempts):
            if k:
                time.sleep(self.delay_ms / 1000)
            try:
                status, text = self.transport(self.endpoint, {**_body(self.model, request.prompt, self.body_format), "stream": False}, self.headers, request.timeout_ms / 1000)
                if not 200 <= status < 300:
                    last = f"HTTP {status}"
                    continue
                body = json.loads(text)
                answer = body.get("response") if isinstance(body, dict) else None
                if isinstance(answer, str) and answer.strip():
                    return Response(answer, "local-http", self.model, body)
                last = "blank response"
            except Exception as e:  # noqa: BLE001  anything the transport raises is tried again
                last = type(e).__name__
        raise AdapterError(f"local adapter failed after {self.attempts} attempts: {last}")


@dataclass(frozen=True)
class HostedHttpAdapter:
    """A hosted service, asked once with a bearer key: reads `text`, else `output`, else the whole body."""

    endpoint: str
    api_key: str
    model: str
    headers: dict = field(default_factory=dict)
    body_format: str = "prompt"
    transport: Transport = http_post

    def generate(self, request: Request) -> Response:
        headers = {"authorization": f"Bearer {self.api_key}", **self.headers}
        status, text = self.transport(self.endpoint, _body(self.model, request.prompt, self.body_format), headers, request.timeout_ms / 1000)
        if not 200 <= status < 300:
            raise AdapterError(f"hosted adapter HTTP {status}")
        try:
            body = json.loads(text)
        except ValueError as e:
            raise AdapterError("hosted adapter response is not valid JSON") from e
        answer = next((body[k] for k in ("text", "output") if isinstance(body, dict) and isinstance(body.get(k), str)), None)
        return Response(answer if answer is not None else json.dumps(body, separators=(",", ":"), ensure_ascii=False), "hosted-http", self.model, body)


def with_timeout(call: Callable[[], Response], timeout_ms: int) -> Response:
    box: list = []

    def run() -> None:
        try:
            box.append((call(), None))
        except Exception as e:  # noqa: BLE001  handed to the caller
            box.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(timeout_ms / 1000)
    if not box:
        raise TimeoutError(f"timeout after {timeout_ms}ms")
    if box[0][1] is not None:
        raise box[0][1]
    return box[0][0]


def generate_with_retry(adapter: Adapter, request: Request, retries: int = RETRIES, delay_ms: int = DELAY_MS) -> Response:
    """The adapter's answer within request.timeout_ms, tried again `retries` times after a fixed delay."""
    last: Exception | None = None
    for k in range(retries + 1):
        if k:
            time.sleep(delay_ms / 1000)
        try:
            return with_timeout(lambda: adapter.generate(request), request.timeout_ms)
        except Exception as e:  # noqa: BLE001  the last one is reported
            last = e
    raise AdapterError(f"LLM generation failed after {retries + 1} attempts: {type(last).__name__}: {last}")


#: Calls at a time where neither the responses nor a configuration say.
PARALLEL = 4


@dataclass(frozen=True)
class AdapterResponses:
    """Answers a requests relation through an adapter; errors become rows.

    A task makes `parallel` calls at a time, as many as the configuration's maxParallel says where it is None.
    """

    adapter: Adapter
    timeout_ms: int = TIMEOUT_MS
    retries: int = RETRIES
    delay_ms: int = DELAY_MS
    parallel: int | None = None

    def within(self, max_parallel: int) -> AdapterResponses:
        return self if self.parallel is not None else replace(self, parallel=max_parallel)

    def respond(self, requests: DataFrame, key: str = "transcript_id") -> DataFrame:
        ship(requests.sparkSession)
        me = self

        def ask(row) -> tuple:
            try:
                r = generate_with_retry(me.adapter, Request(row.prompt, row.schema_name, row.schema_version, me.timeout_ms), me.retries, me.delay_ms)
                return r.text, r.provider, None
            except Exception as e:  # noqa: BLE001  one row's failure is that row's
                return None, None, str(e)

        def run(batches: Iterator) -> Iterator:
            with ThreadPoolExecutor(me.parallel or PARALLEL) as pool:
                for pdf in batches:
                    answers = list(pool.map(ask, pdf.itertuples(index=False)))
                    out = pdf[[key, "chunk_index", "schema_name"]].copy()
                    for i, name in enumerate(("response_text", "provider", "error")):
                        out[name] = [a[i] for a in answers]
                    yield out

        kind = dict(requests.dtypes)[key]
        return requests.mapInPandas(run, f"`{key}` {kind}, {RESPONSES}")


@dataclass(frozen=True)
class ResponseTable:
    """Answers from a relation (transcript_id, chunk_index, schema_name, response_text): offline and repeatable."""

    table: DataFrame

    def respond(self, requests: DataFrame, key: str = "transcript_id") -> DataFrame:
        on = [key, "chunk_index", "schema_name"]
        answers = self.table.select(*on, "response_text")
        missing = F.when(F.col("response_text").isNull(), F.lit("no response in the table"))
        return requests.select(*on).join(answers, on, "left").select(*on, "response_text", F.lit("table").alias("provider"), missing.alias("error"))
