"""Who decides what a template is: a pluggable interface.

The default needs no network. The HTTP client speaks the common chat
completion protocol to a server of the user's choice.
"""

from __future__ import annotations

import json
import re
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

from logloom.functions import align


class Oracle(Protocol):
    def extract(self, message: str) -> str:
        """A template for the message."""

    def is_constant(self, message: str, token: str) -> bool:
        """Whether a token of the message is constant text."""

    def same(self, first: str, second: str) -> bool:
        """Whether two templates stand for one event."""


class Heuristic:
    """Tokens with digits vary, words are constant, templates only merge by rule."""

    def extract(self, message: str) -> str:
        return align.heuristic(message).template

    def is_constant(self, message: str, token: str) -> bool:
        return token.isalpha()

    def same(self, first: str, second: str) -> bool:
        return False


@dataclass
class Recorded:
    """Replays given answers; what was not recorded goes to another oracle."""

    templates: dict[str, str] = field(default_factory=dict)
    constants: dict[tuple[str, str], bool] = field(default_factory=dict)
    merges: dict[tuple[str, str], bool] = field(default_factory=dict)
    other: Oracle = field(default_factory=Heuristic)

    def extract(self, message: str) -> str:
        return self.templates.get(message) or self.other.extract(message)

    def is_constant(self, message: str, token: str) -> bool:
        known = self.constants.get((message, token))
        return self.other.is_constant(message, token) if known is None else known

    def same(self, first: str, second: str) -> bool:
        known = self.merges.get((first, second))
        return self.other.same(first, second) if known is None else known


class Chat:
    """A chat completion client: one user message, temperature 0, the reply trimmed."""

    def __init__(self, base_url: str, model: str | None = None, timeout: float = 60.0) -> None:
        self.base_url, self.timeout = base_url.rstrip("/"), timeout
        self.model = model or self._get("/models")["data"][0]["id"]

    def _get(self, path: str, body: dict | None = None) -> dict:
        data = json.dumps(body).encode() if body else None
        req = urllib.request.Request(self.base_url + path, data=data, headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=self.timeout) as reply:
            return json.load(reply)

    def ask(self, prompt: str, max_tokens: int = 512) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": max_tokens, "n": 1}
        return self._get("/chat/completions", body)["choices"][0]["message"]["content"].strip()


def connect(url: str | None) -> Chat | None:
    """A client that has answered once; None without a URL or on any failure."""
    if not url:
        return None
    try:
        chat = Chat(url)
        chat.ask("hello")
    except (OSError, ValueError, KeyError, IndexError):
        return None
    return chat


@dataclass
class Http:
    """Asks one server for templates and one for verdicts; a failed extraction falls back to the heuristic."""

    extraction: Chat
    verdicts: Chat

    def extract(self, message: str) -> str:
        try:
            return self.extraction.ask(message)
        except (OSError, ValueError, KeyError, IndexError):
            return align.heuristic(message).template

    def is_constant(self, message: str, token: str) -> bool:
        meaning = self.verdicts.ask(_filled(MEANING_PROMPT, message, token))
        return says_constant(self.verdicts.ask(_filled(CONSTANT_PROMPT, message, token, meaning)))

    def same(self, first: str, second: str) -> bool:
        return says_yes(self.verdicts.ask(_filled(SAME_PROMPT, first, second)))


#: Prompts, in the pieces between which values stand.
MEANING_PROMPT = ("Log message:\n", "\n\nIn one sentence, what does the part `", "` of it mean?")
CONSTANT_PROMPT = ("Log message:\n", "\n\nAbout the part `", "`: ", "\n\nIs this part constant text of the logging statement or the value of a variable? Reply with the one word constant or variable.")
SAME_PROMPT = ("Two log templates, `<*>` stands for a variable part:\n1. ", "\n2. ", "\n\nDo both come from one logging statement? End with a line `Answer: yes` or `Answer: no`.")


def _filled(prompt: tuple[str, ...], *values: str) -> str:
    return prompt[0] + "".join(v + piece for v, piece in zip(values, prompt[1:], strict=True))


def says_yes(reply: str) -> bool:
    return "yes" in reply.lower().rpartition("answer:")[2]


def says_constant(reply: str) -> bool:
    low = reply.lower()
    return "constant" in low and not re.search(r"not\s+(?:a\s+)?constant", low)
