"""A language model behind an HTTP address, as the callable that distilling and synthesis take."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from ..functions.notes import endpoint


#: Fixed value: the version that the `messages` format asks for in its header.
MESSAGES_VERSION = "2023-06-01"


@dataclass(frozen=True)
class HttpModel:
    """Called with (system, user) it returns the answer's text. style is `chat` (a list of messages with the system's first) or `messages` (the system apart). It is
    picklable, so tasks can call it; a refusal becomes an error that names its status."""

    base: str
    token: str
    model: str
    style: str = "chat"
    max_tokens: int = 8192
    seconds: int = 120

    def __call__(self, system: str, user: str) -> str:
        if self.style not in ("chat", "messages"):
            raise ValueError(f"no message format {self.style!r}")
        if not (self.base and self.token and self.model):
            raise ValueError("the model needs an address, a token and a name")
        said = [{"role": "user", "content": user}]
        body: dict = {"model": self.model, "max_tokens": self.max_tokens}
        if self.style == "messages":
            path, headers = "/v1/messages", {"x-api-key": self.token, "anthropic-version": MESSAGES_VERSION}
            body |= {"system": system, "messages": said}
        else:
            path, headers = "/v1/chat/completions", {"Authorization": f"Bearer {self.token}"}
            body["messages"] = [{"role": "system", "content": system}, *said]
        headers["Content-Type"] = "application/json"
        request = urllib.request.Request(endpoint(self.base, path), json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.seconds) as answer:
                got = json.load(answer)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from e
        if self.style == "messages":
            return "".join(part.get("text", "") for part in got["content"])
        return got["choices"][0]["message"]["content"]
