"""Requests to a chat service: their bodies, a streaming client, and what is done when one fails or is too long."""

from __future__ import annotations

import json
import random
import time
import traceback
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators.chat import clip

# What is left free of a model's limit when a request was too long, a time more for each time.
RESERVE = 512
#: Seconds to wait before a request is sent again, and after the last try.
WAIT, LAST_WAIT = (5, 20), 5
DONE, PREFIX = "data: [DONE]", "data: "


class TooLong(Exception):
    """The service finds a request longer than its model takes."""


def body(model: Column, messages: Column, temperature: Column | None = None, top_p: Column | None = None) -> Column:
    """A request's JSON; temperature and top_p are 1 where they aren't given."""
    one = F.lit(1.0)
    parts = (model.alias("model"), messages.alias("messages"), F.coalesce(temperature if temperature is not None else one, one).alias("temperature"), F.coalesce(top_p if top_p is not None else one, one).alias("top_p"), F.lit(True).alias("stream"))
    return F.to_json(F.struct(*parts))


def headers(key: str) -> dict[str, str]:
    if not key:
        raise ValueError("the service needs a key")
    return {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}


def deltas(lines: Iterable[bytes | str]) -> Iterator[str]:
    """The pieces of an answer; lines of other kinds, and those that aren't JSON of the right shape, give none."""
    for line in lines:
        text = line.decode("utf-8", "replace") if isinstance(line, bytes) else line
        text = text.rstrip("\r\n")
        if not text.startswith(PREFIX) or text == DONE:
            continue
        try:
            piece = json.loads(text[len(PREFIX) :])["choices"][0]["delta"]["content"]
        except (ValueError, LookupError, TypeError):
            continue
        if isinstance(piece, str):
            yield piece


#: Takes address, headers and body; gives the lines of the answer.
Opener = Callable[[str, dict[str, str], bytes], Iterable[bytes | str]]


def opened(url: str, head: dict[str, str], data: bytes) -> Iterator[bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, data, head)) as answer:  # noqa: S310
        yield from answer


@dataclass
class Client:
    """An adapter for chat.transform(): one request a prompt, its streamed answer put together."""

    url: str
    model: str
    key: str
    temperature: float = 1.0
    top_p: float = 1.0
    opener: Opener = opened
    #: Gets an answer as far as it came.
    observe: Callable[[str], None] | None = None

    def __call__(self, prompt: str, system: str, history: list[str] | None = None) -> str:
        turns = [("system", system)] if system else []
        turns += [(("user", "assistant")[i % 2], h) for i, h in enumerate(history or ())]
        messages = [{"role": r, "content": c} for r, c in (*turns, ("user", prompt))]
        data = {"model": self.model, "messages": messages, "temperature": self.temperature, "top_p": self.top_p, "stream": True}
        answer = ""
        for piece in deltas(self.opener(self.url, headers(self.key), json.dumps(data, ensure_ascii=False).encode())):
            answer += piece
            if self.observe:
                self.observe(answer)
        return answer


@dataclass
class Patient:
    """An adapter around another: it waits and tries again, clips what was too long, and gives errors as answers."""

    inner: Callable[..., str]
    limit: int
    retries: int = 2
    pause: Callable[[float], None] = time.sleep
    states: list[str] = field(default_factory=list)

    def __call__(self, prompt: str, system: str, history: list[str] | None = None) -> str:
        said, left, over, history = "", self.retries, 0, list(history or ())
        while True:
            try:
                answer = self.inner(prompt, system, history) if history else self.inner(prompt, system)
                self.states.append("done")
                return answer
            except TooLong as e:
                over += 1
                prompt, history = clip(prompt, history, self.limit - RESERVE - RESERVE * over)
                self.states.append("clipped")
                if not prompt and not any(history):
                    return f"{said}[Local Message] {e}"
            except Exception:  # noqa: BLE001
                said += f"[Local Message] Traceback:\n\n```\n{traceback.format_exc()}```\n\n"
                if not left:
                    self.states.append("failed")
                    self.pause(LAST_WAIT)
                    return said
                left -= 1
                self.states.append("waiting")
                self.pause(random.randint(*WAIT))  # noqa: S311
