"""Models behind the chat protocol over HTTP, by the standard library alone."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
import uuid

from docmill.operators.inference import TIMEOUT_SECONDS, Model

#: Variable with the key of models that name none (fixed value).
DEFAULT_KEY_VARIABLE = "HF_TOKEN"


class RateLimitError(RuntimeError):
    """The model was asked too often."""


class AuthenticationError(RuntimeError):
    """The key wasn't accepted."""


class HttpChat:
    """A provider: posts a chat to ``<base_url>/chat/completions``.

    ``base_url`` is for models that have none of their own. Errors come as the types that
    :func:`docmill.operators.inference.error_category` tells apart.
    """

    def __init__(self, base_url: str | None = None, timeout: float = TIMEOUT_SECONDS):
        self.base_url, self.timeout = base_url or os.environ.get("DOCMILL_BASE_URL"), timeout

    def __call__(self, model: Model, prompt: str) -> str:
        return self.chat(model, [{"role": "user", "content": prompt}])

    def chat(self, model: Model, messages: list[dict], image: str | None = None) -> str:
        """The answer to a chat; ``image`` is a PNG in base64 that goes with the last turn."""
        base = model.base_url or self.base_url
        if not base:
            raise ValueError(f"model {model.name} has no base_url")
        turns = [{"role": m["role"], "content": m["content"]} for m in messages]
        if image:
            picture = {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}"}}
            turns[-1]["content"] = [{"type": "text", "text": turns[-1]["content"]}, picture]
        headers = {"Content-Type": "application/json", "X-Request-ID": str(uuid.uuid4())}
        if key := model.api_key or os.environ.get(model.key_variable or DEFAULT_KEY_VARIABLE):
            headers["Authorization"] = f"Bearer {key}"
        if model.bill_to:
            headers["X-HF-Bill-To"] = model.bill_to
        name = f"{model.name}:{model.provider}" if model.provider else model.name
        body = json.dumps({"model": name, "messages": turns, **model.extra}).encode()
        request = urllib.request.Request(f"{base.rstrip('/')}/chat/completions", body, headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                found = json.load(reply)
        except urllib.error.HTTPError as e:
            kind = {401: AuthenticationError, 403: AuthenticationError, 429: RateLimitError}.get(e.code, RuntimeError)
            raise kind(f"{e.code}: {e.read(500).decode(errors='replace')}") from e
        except TimeoutError:
            raise
        except OSError as e:
            late = isinstance(getattr(e, "reason", None), TimeoutError)
            raise (TimeoutError if late else ConnectionError)(str(e)) from e
        choices = found.get("choices") if isinstance(found, dict) else None
        if not choices:
            raise RuntimeError(f"model {model.name} gave no choices")
        return (choices[0].get("message") or {}).get("content") or ""
