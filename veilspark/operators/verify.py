"""The verification layer by a language model: requests, replies, findings, and a verifier for de-identification. Sending is a function of its own, so that workers, tests and gateways can bring theirs."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

# Addresses and headers of the two public interfaces.
PATHS = {"anthropic": "/v1/messages", "openai": "/v1/chat/completions"}
VERSION = "2023-06-01"
MOST_TOKENS, TIMEOUT = 1024, 30.0

INSTRUCTION = (
    "You check clinical text that has been de-identified. List every identifier of a person that is still in it: names, places smaller than a state, dates other than years, numbers and addresses of any kind. "
    'Answer with a JSON array only. Each element is an object with "text", "category", "start" and "confidence" (0 to 1). Answer [] if nothing is left. Placeholders in square brackets are not identifiers.'
)

Send = Callable[[str, dict[str, str], dict[str, Any], float], dict[str, Any]]


def request(text: str, provider: str, model: str, api_key: str, base_url: str) -> tuple[str, dict[str, str], dict[str, Any]]:
    """(address, headers, body) of a request about a text."""
    if provider not in PATHS:
        raise ValueError(f"unknown provider {provider}")
    ask = {"role": "user", "content": f"The text:\n\n{text}"}
    body: dict[str, Any] = {"model": model, "max_tokens": MOST_TOKENS}
    if provider == "anthropic":
        headers = {"x-api-key": api_key, "anthropic-version": VERSION}
        body |= {"system": INSTRUCTION, "messages": [ask]}
    else:
        headers = {"Authorization": f"Bearer {api_key}"}
        body |= {"messages": [{"role": "system", "content": INSTRUCTION}, ask]}
    return base_url.rstrip("/") + PATHS[provider], {"Content-Type": "application/json", **headers}, body


def reply_text(provider: str, reply: Any) -> str:
    """The text of a reply, "" for any other shape."""
    steps = ("content", 0, "text") if provider == "anthropic" else ("choices", 0, "message", "content")
    for step in steps:
        try:
            reply = reply[step]
        except (KeyError, IndexError, TypeError):
            return ""
    return reply if isinstance(reply, str) else ""


def findings(text: str) -> list[dict[str, Any]]:
    """The array between the first [ and the last ], whatever prose is around it; elements that are no objects are left out. Broken JSON raises ValueError."""
    a, b = text.find("["), text.rfind("]")
    if a < 0 or b < a:
        return []
    blank = {"text": "", "category": "UNKNOWN", "start": -1, "confidence": 0.5}
    out = [blank | {k: v for k, v in x.items() if k in blank and v is not None} for x in json.loads(text[a : b + 1]) if isinstance(x, dict)]
    return [x | {"confidence": float(x["confidence"])} for x in out]


def post(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float) -> dict[str, Any]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:  # noqa: S310
        return json.load(r)


def verifier(provider: str, model: str, base_url: str, api_key: str = "", send: Send = post, timeout: float = TIMEOUT) -> Callable[[str], tuple[str, list[dict]]]:
    """For Config(verifier=...): ("skipped", []) without a key, ("error", []) if the call or its reply fails, else "clean" or "findings"."""

    def check(text: str) -> tuple[str, list[dict]]:
        if not api_key:
            return "skipped", []
        if not text.strip():
            return "clean", []
        try:
            found = findings(reply_text(provider, send(*request(text, provider, model, api_key, base_url), timeout)))
        except Exception:  # noqa: BLE001  any failure of the service is the same to the record
            return "error", []
        return ("findings" if found else "clean"), found

    return check
