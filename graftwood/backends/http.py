"""A chat-completions endpoint, with the standard library only."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from ..functions.replies import extract_json, message_text
from .base import Answer

# Fixed values, kept for compatibility: tries of a request, seconds before the second one, seconds until one is given up, and how often a reply is asked for that is JSON.
TRIES = 5
FIRST_PAUSE = 3.0
TIMEOUT = 300.0
JSON_TRIES = 3
_FIX = "That was not valid JSON. Answer again with nothing but the JSON value."


class HttpError(Exception):
    def __init__(self, status: int | None, text: str) -> None:
        super().__init__(f"{status}: {text}")
        self.status, self.text = status, text


def _post(url: str, headers: dict, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.read().decode("utf-8", "replace")) from e
    except OSError as e:
        raise HttpError(None, str(e)) from e


class HttpBackend:
    """Retries with doubling pauses; options that an endpoint refuses are left out from then on; replies that aren't JSON are asked for again."""

    def __init__(self, base_url: str, api_key: str, model: str, rps: float, json_mode: bool = False, post: Callable = _post, sleep: Callable = time.sleep) -> None:
        self.url = base_url.rstrip("/") + "/chat/completions"
        self.headers = {"Authorization": f"Bearer {api_key}", "Content-Type": "application/json"}
        self.model, self.gap, self.options = model, 1.0 / max(rps, 1e-9), {"response_format": {"type": "json_object"}} if json_mode else {}
        self._post, self._sleep, self._lock, self._next = post, sleep, threading.Lock(), 0.0

    def _wait(self) -> None:
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next)
            self._next = at + self.gap
        if at > now:
            self._sleep(at - now)

    def _chat(self, messages: list[dict], max_tokens: int) -> str:
        last: Exception | None = None
        for k in range(TRIES):
            self._wait()
            sent = dict(self.options)
            try:
                answer = self._post(self.url, self.headers, {"model": self.model, "messages": messages, "max_tokens": max_tokens, **sent})
                choices = answer.get("choices") or [{}]
                return message_text(choices[0].get("message"))
            except HttpError as e:
                last = e
                if e.status == 400:
                    refused = [o for o in sent if o in e.text]
                    if not refused:
                        raise
                    for o in refused:
                        self.options.pop(o, None)
                    continue
                self._sleep(FIRST_PAUSE * 2**k)
        raise RuntimeError(f"no answer after {TRIES} tries: {last}")

    def ask(self, kind: str, system: str, user: str, max_tokens: int) -> Answer:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        calls = 0
        try:
            for k in range(JSON_TRIES):
                text = self._chat(messages, max_tokens)
                calls += 1
                try:
                    return Answer(json.dumps(extract_json(text), ensure_ascii=False), calls, None)
                except ValueError:
                    if k + 1 == JSON_TRIES:
                        raise
                    messages += [{"role": "assistant", "content": text}, {"role": "user", "content": _FIX}]
        except Exception as e:
            return Answer(None, calls, str(e))
        raise AssertionError
