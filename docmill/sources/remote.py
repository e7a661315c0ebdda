"""Remote services: settings, requests, streamed replies, and jobs that are polled. No service is named here; what
talks to one is passed in."""

from __future__ import annotations

import base64
import json
import os
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

#: States in which a job has ended; only the first has results.
ENDED = ("SUCCESS", "FAILED", "TIMEOUT_EXCEEDED", "CANCELLED")
#: New characters of a streamed reply after which it is looked at again.
LOOK_AGAIN = 1500


class Incomplete(RuntimeError):
    """Some pages of a document have no text; done holds those that do."""

    def __init__(self, message: str, done: Mapping[int, str] | None = None) -> None:
        super().__init__(message)
        self.done = dict(done or {})


class Interrupted(Incomplete):
    """Stopped on request, with what was done by then."""


@dataclass(frozen=True)
class Settings:
    """How a service is asked. Numbers that can't be read fall back on these defaults."""

    base_url: str = ""
    api_key: str = field(default="", repr=False)
    ca_bundle: str | None = None
    engine: str = ""
    model: str | None = None
    dpi: int = 200
    concurrency: int = 8
    retries: int = 5
    backoff: float = 2.0
    timeout: float = 180.0
    connect_timeout: float = 15.0
    stream: bool = True
    text_layer: bool = True
    token_field: str = "max_tokens"

    @classmethod
    def read(cls, prefix: str, env: Mapping[str, str] | None = None) -> Settings:
        """From variables PREFIX_NAME; an engine that is not named follows from whether a base address is."""
        env = os.environ if env is None else env
        got: dict[str, Any] = {}
        for name, f in cls.__dataclass_fields__.items():
            raw = (env.get(f"{prefix}_{name.upper()}") or "").strip()
            if not raw:
                continue
            default = f.default
            if isinstance(default, bool):
                got[name] = raw.lower() not in ("0", "false", "no", "off")
            elif isinstance(default, int | float):
                try:
                    got[name] = type(default)(raw)
                except ValueError:
                    continue
            else:
                got[name] = raw
        out = cls(**got)
        url = out.base_url.strip().rstrip("/").removesuffix("/v1").rstrip("/")
        return cls(**{**out.__dict__, "base_url": url, "engine": out.engine or ("vlm" if url else "hosted")})

    def verify(self) -> str | bool:
        """What certificates are checked against; they always are."""
        if self.ca_bundle and not os.path.exists(self.ca_bundle):
            raise FileNotFoundError(f"no certificates at {self.ca_bundle}")
        return self.ca_bundle or True

    def headers(self) -> dict[str, str]:
        if not self.api_key and self.engine == "hosted":
            raise PermissionError("a hosted service needs a key")
        return {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}


def chat_request(settings: Settings, prompt: str, image: bytes, max_tokens: int, mime: str = "image/png", history: list[dict] | None = None, stream: bool = False) -> dict:
    """The body of a request about one picture; a history goes before it."""
    parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(image).decode()}"}}]
    body = {"model": settings.model, "temperature": 0.1, settings.token_field: max_tokens, "messages": [*(history or ()), {"role": "user", "content": parts}]}
    return body | ({"stream": True} if stream and settings.stream else {})


def read_stream(lines: Iterable[str], stop_when: Callable[[str], bool], deadline: float | None = None, clock: Callable[[], float] = time.monotonic) -> str:
    """The text of a streamed reply, cut off as soon as stop_when holds for what has come; a reply that is not
    streamed is read whole. Past the deadline a TimeoutError is raised, which is worth another try."""
    text, looked, other = "", 0, []
    for raw in lines:
        if deadline is not None and clock() > deadline:
            raise TimeoutError("the reply took too long")
        line = raw.strip()
        if not line.startswith("data:"):
            other.append(raw)
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            break
        try:
            delta = json.loads(data)["choices"][0].get("delta", {}).get("content") or ""
        except (ValueError, LookupError):
            continue
        text += delta
        if len(text) - looked >= LOOK_AGAIN:
            looked = len(text)
            if stop_when(text):
                return text
    if text:
        return text
    try:
        return json.loads("".join(other))["choices"][0]["message"]["content"] or ""
    except (ValueError, LookupError):
        return ""


class BatchService(Protocol):
    """A service that takes many requests as one job."""

    def submit(self, requests: list[dict]) -> str: ...

    def status(self, job: str) -> str: ...

    def cancel(self, job: str) -> None: ...

    def results(self, job: str) -> list[dict]: ...


def run_job(service: BatchService, requests: list[dict], every: float = 10.0, limit: float = 7200.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """Submit a job, look at it until it ends, and give its results; those of jobs that did not succeed are none.

    A job over the limit is cancelled. The results are rows (custom_id, ...) that come back into Spark by
    ingest.batch_results or ingest.vision_results.
    """
    if not requests:
        return []
    job, began = service.submit(requests), clock()
    while (state := service.status(job)) not in ENDED:
        if clock() - began >= limit:
            service.cancel(job)
            return []
        sleep(every)
    return service.results(job) if state == ENDED[0] else []


def paged(get: Callable[[int, int], list[dict]], size: int = 100) -> list[dict]:
    """All rows of a listing that is read page by page (start, size) until a page is short."""
    out: list[dict] = []
    while True:
        rows = get(len(out), size)
        out += rows
        if len(rows) < size:
            return out
