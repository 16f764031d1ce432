"""Raw answers of a model, read inside the call so that a bad one moves on to the next rung.

The same rules as ``quality.normalise_responses``, ``repetition_gate`` and ``echoes_own_prompt`` have
for finished tables.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from ..settings import InferenceSettings
from .quality import ECHO_WORDS, MIN_JUDGED_CHARS, TAGGED, TAGGED_NONE

_TAGGED, _TAGGED_NONE = re.compile(TAGGED), re.compile(TAGGED_NONE)
_WORD = re.compile(r"\w+")


class DegenerateError(Exception):
    """The answer is unusable; repeating the same call will not help."""


@dataclass
class Answer:
    """What a model said before anything is read into it: text, or parts with ``type`` and ``text``."""

    content: str | list | None
    finish_reason: str | None = None
    forced_language: str | None = None


def content_text(content: object) -> str:
    """The text of plain content, or of the text parts of content given as parts."""
    if isinstance(content, list):
        texts = [p.get("text") for p in content if isinstance(p, dict) and p.get("type", "text") == "text"]
        content = "".join(t for t in texts if isinstance(t, str))
    if not isinstance(content, str):
        raise DegenerateError("answer has no text content")
    return content


def _from_json(content: object) -> str:
    try:
        found = json.loads(content) if isinstance(content, str) else None
    except ValueError:
        found = None
    if not isinstance(found, dict) or list(found) != ["transcript"] or not isinstance(found["transcript"], str):
        raise DegenerateError("answer is not the asked JSON object")
    return found["transcript"]


def _from_tagged(content: str, forced: str | None) -> tuple[str, str | None]:
    hit = _TAGGED.match(content)
    name, tail = (hit[1].strip(), hit[2].strip()) if hit else (None, None)
    if forced is not None:
        if hit and name.casefold() != forced.casefold():
            raise DegenerateError("answer is in another language than the forced one")
        return (tail if hit else content), forced
    if hit and name.casefold() != "none":
        return tail, name or None
    if hit and tail:
        raise DegenerateError("answer has text but no language")
    if hit or _TAGGED_NONE.match(content):
        return "", None
    raise DegenerateError("answer is not of the tagged form")


def echoes(text: str, prompt: str | None, n: int = ECHO_WORDS) -> bool:
    """Whether a run of ``n`` words of the prompt stands in the text."""
    runs = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (_WORD.findall((t or "").casefold()) for t in (text, prompt))]
    return bool(runs[0] & runs[1])


def read_answer(answer: Answer, settings: InferenceSettings, prompt: str | None, metrics: dict) -> tuple[str, str | None]:
    """(text, detected language) of a usable answer, '' for no speech; else ``DegenerateError``."""
    metrics.setdefault("finish_reason", answer.finish_reason)
    if answer.finish_reason == "length":
        raise DegenerateError("answer reached its token limit")
    if answer.content is None:
        raise DegenerateError("answer has no content")
    language = None
    if settings.response_mode == "json":
        text = _from_json(answer.content)
    elif settings.response_mode == "tagged":
        text, language = _from_tagged(content_text(answer.content), answer.forced_language)
    else:
        text = content_text(answer.content)
    text = text.strip()
    if len(text) >= MIN_JUDGED_CHARS:
        ratio = len(raw := text.encode()) / len(zlib.compress(raw))
        metrics["compression_ratio"] = round(ratio, 3)
        if ratio > settings.compression_ratio_threshold:
            raise DegenerateError("answer looks like a repetition loop")
    if prompt and echoes(text, prompt):
        raise DegenerateError("answer repeats the instruction prompt")
    return text, language
