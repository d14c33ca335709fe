"""Which failures of an embedding provider are worth another attempt."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FATAL_CODES = ("billing_hard_limit_reached", "insufficient_quota", "invalid_api_key", "invalid_request_error", "model_not_found")
_REFUSED = tuple(f"{w} {n}" for n in (400, 401, 403) for w in ("http", "status"))
FATAL_WORDS = (*_REFUSED, "bad request", "billing", "incorrect api key", "invalid api key", "invalid_request_error", "model not found", "quota exceeded")
#: (code, words of a message that mean it), in the order in which they are looked for.
KNOWN_CODES = (
    ("invalid_api_key", ("invalid_api_key", "invalid api key")),
    ("rate_limit_exceeded", ("rate_limit_exceeded", "rate limit")),
    ("model_not_found", ("model_not_found", "model not found")),
)


class EmbeddingError(Exception):
    def __init__(self, message: str, transient: bool, status: int | None = None, code: str | None = None) -> None:
        super().__init__(message)
        self.transient, self.status, self.code = transient, status, code

    @property
    def kind(self) -> str:
        return "transient" if self.transient else "permanent"


def transient_status(status: int) -> bool:
    return status == 429 or not 400 <= status < 500


def transient_message(message: str) -> bool:
    """What is known to be fatal is; anything else may pass."""
    said = message.lower()
    return not any(w in said for w in FATAL_WORDS)


def transient_code(code: str | None, message: str) -> bool:
    said = (code or "").lower()
    if any(c in said for c in FATAL_CODES):
        return False
    return said == "rate_limit_exceeded" or transient_message(message)


def status_in(message: str) -> int | None:
    """The three digits after the first "http ", else after the first "status "."""
    for marker in ("http ", "status "):
        _, found, rest = message.lower().partition(marker)
        digits = re.match("[0-9]*", rest)[0]
        if found and len(digits) == 3:
            return int(digits)
    return None


def code_in(message: str) -> str | None:
    said = message.lower()
    for code, words in KNOWN_CODES:
        if any(w in said for w in words):
            return code
    _, found, _ = said.partition('"code":"')
    at = said.find('"code":"') + 8
    value, closed, _ = message[at:].partition('"')
    return value if found and closed and value else None


def from_message(message: str) -> EmbeddingError:
    return EmbeddingError(message, transient_message(message), status_in(message), code_in(message))


def from_response(status: int, body: str) -> EmbeddingError:
    """From an HTTP answer; a provider's own error object says more than the status."""
    message = f"HTTP {status}: {body[:500]}"
    try:
        error = json.loads(body).get("error")
    except (ValueError, AttributeError):
        error = None
    if isinstance(error, dict) and error.get("code"):
        code, text = str(error["code"]), str(error.get("message", ""))
        return EmbeddingError(message, transient_code(code, text or message), status, code)
    return EmbeddingError(message, transient_status(status), status, code_in(body))


# the same as columns ------------------------------------------------------------------------------------------


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def status_is_transient(status: Column) -> Column:
    return (status == 429) | ~status.between(400, 499)


def message_is_transient(message: Column) -> Column:
    return ~_any([F.lower(message).contains(w) for w in FATAL_WORDS])


def status_column(message: Column) -> Column:
    def after(marker: str) -> Column:
        digits = F.regexp_extract(F.lower(message), f"(?s)^(?:(?!{marker}).)*{marker}([0-9]*)", 1)
        return F.when(F.length(digits) == 3, digits.cast("int"))

    return F.coalesce(after("http "), after("status "))


def code_column(message: Column) -> Column:
    said = F.lower(message)
    out = None
    for code, words in KNOWN_CODES:
        hit = _any([said.contains(w) for w in words])
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    value = F.regexp_extract(message, r'(?is)^(?:(?!"code":").)*"code":"([^"]*)"', 1)
    return out.otherwise(F.when(value != "", value))
