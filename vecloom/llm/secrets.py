"""Secret scan: keywords by Aho-Corasick, anchored expressions near hits, embedded checksums.

One automaton holds the literal keywords of all rules, and one pass of it over a text gives
the few places worth a look. Only there a rule's regular expression is tried, anchored at
the keyword (``match`` at a position, never a search through the text). Where a kind of
secret carries a check (CRC-32 in GitHub and npm tokens, the Luhn digit of card numbers,
mod 97 of IBANs, the JSON header of JWTs), a match that fails
it is dropped; kinds without one must have the entropy of random text, PEM blocks both their markers.
Card numbers and IBANs need no word before them: the prefixes of card issuers and the country codes
are keywords too. One in ten of other numbers with such a prefix and 13 to 19 digits passes the Luhn check by chance.

Defined results
* null or empty text has no findings; a null id is reported as null;
* repeated rows are each scanned, so their findings repeat;
* an empty table gives an empty result; other columns are ignored by :func:`scan` and kept by :func:`redact`;
* texts are scanned whole at any length; offsets count characters, the end is exclusive;
* every rule reads a bounded stretch from each keyword, so time is in proportion to length; an assigned value of more than 512 characters is data, not a secret;
* where findings of several rules overlap, the one that starts first stays, then the longest, then the rule listed first.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .frames import texts

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _tail_crc(secret: str) -> bool:
    body = secret.split("_", 1)[1]
    return crc62(body[:-6]) == body[-6:]


def luhn(secret: str) -> bool:
    digits = [int(c) for c in secret if c.isdigit()]
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and total % 10 == 0 and len(set(digits)) > 1


def iban(secret: str) -> bool:
    s = re.sub(r"\s", "", secret)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def jwt(secret: str) -> bool:
    head = secret.split(".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def entropy(secret: str) -> float:
    """Bits per character."""
    n = len(secret)
    return -sum(c / n * math.log2(c / n) for c in Counter(secret).values())


def _random(least: float) -> Callable[[str], bool]:
    return lambda secret: entropy(secret) >= least


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched ``back`` characters before a keyword at most; its group ``s``, if any, is the secret."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool] | None = None
    back: int = 0


def _cases(*words: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v for w in words for v in (w.lower(), w.upper(), w.capitalize())))


#: Length of an IBAN by country (ISO 13616).
_IBANS = dict(
    (x[:2], int(x[2:]))
    for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27
    GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30
    NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()
)
#: Prefixes of card numbers: Visa, Mastercard, American Express, Diners, JCB, Discover, UnionPay, Maestro, Mir.
_ISSUERS = ("4", *[str(n) for n in range(50, 59)], "6", "34", "35", "36", "37", "38", "39", *[str(n) for n in range(300, 306)], *[str(n) for n in range(2200, 2205)], *[str(n) for n in range(2221, 2721)])
_CARD = f"(?<![0-9])(?={'|'.join(_ISSUERS)})"


def _bare_iban(country: str, length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return country + "[0-9]{2}(?: ?[A-Z0-9]{4}){%d}" % groups + (" ?[A-Z0-9]{%d}" % rest if rest else "")


RULES: tuple[Rule, ...] = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _tail_crc),
    Rule("npm_token", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _tail_crc),
    Rule("aws_access_key", ("AKIA", "ASIA"), r"(?<![A-Z0-9])A[KS]IA[A-Z2-7]{16}(?![A-Za-z0-9])", _random(2.5)),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxs-", "xoxr-"), r"xox[bpasr]-[0-9]{8,20}-[0-9A-Za-z-]{12,512}", _random(3.0)),
    Rule("stripe_key", ("sk_live_", "rk_live_", "sk_test_"), r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", _random(3.0)),
    Rule("google_key", ("AIza",), r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", _random(3.0)),
    Rule("private_key", ("-----BEGIN ",), r"-----BEGIN (?P<k>[A-Z ]{0,30}PRIVATE KEY)-----(?:[\sA-Za-z0-9+/=:,]|-(?!----))+-----END (?P=k)-----"),
    Rule("jwt", ("eyJ",), r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}", jwt),
    Rule("iban", _cases("iban"), r"(?i:iban)[\s:=#]{0,4}(?P<s>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
    Rule("card_number", _cases("card", "visa", "mastercard", "amex"), r"(?i:[a-z]*(?: (?:no|number|nr))?)[\s.:=#]{0,4}(?P<s>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])", luhn),
    Rule("iban", tuple(f"{c}{d}" for c in _IBANS for d in range(10)), rf"(?<![A-Za-z0-9])(?:{'|'.join(_bare_iban(*x) for x in _IBANS.items())})(?![A-Za-z0-9])", iban),
    Rule("card_number", _ISSUERS, _CARD + r"(?:[0-9]{13,19}|[0-9]{4}(?P<g>[ -])(?:[0-9]{4}(?P=g)){2}[0-9]{1,7}|[0-9]{4}(?P<h>[ -])[0-9]{6}(?P=h)[0-9]{4,5})(?![0-9])", luhn),
    Rule("card_number", _ISSUERS, _CARD + r"[0-9]{4}(?P<g>[ -])(?:[0-9]{4}(?P=g)){3}[0-9]{1,3}(?![0-9])", luhn),
    Rule(
        "assigned_secret",
        _cases("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_key", "private_key", "client_secret"),
        r"(?<![A-Za-z0-9])[A-Za-z0-9]{0,24}_?(?i:token|secret|password|passwd|api_?key|access_key|auth_key|private_key|client_secret)[\"']?\s{0,4}(?:=|:|:=|=>)\s{0,4}(?P<q>[\"']?)(?P<s>[A-Za-z0-9+/_.=-]{16,512})(?P=q)(?![A-Za-z0-9+/_.=-])",
        _random(3.0),
        back=25,
    ),
)


class Scanner:
    """The compiled rules; one per Python worker."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.patterns = [re.compile(r.pattern) for r in rules]
        by_word: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            for w in r.keywords:
                by_word.setdefault(w, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for w, ks in by_word.items():
            self.automaton.add_word(w, (len(w), tuple(ks)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(rule, start, end, checked) without overlaps, by start. checked: the kind has an embedded check."""
        found = []
        for end, (n, ks) in self.automaton.iter(text):
            for k in ks:
                rule, pattern, m = self.rules[k], self.patterns[k], None
                at = end + 1 - n
                for start in range(max(0, at - rule.back), at + 1):
                    if (m := pattern.match(text, start)) and m.end() > at:
                        break
                if m is None:
                    continue
                group = "s" if "s" in pattern.groupindex else 0
                if rule.check is None or rule.check(m.group(group)):
                    found.append((m.start(group), -m.end(group), k))
        out, last = [], 0
        for start, end, k in sorted(set(found)):
            if start >= last:
                out.append((self.rules[k].name, start, -end, self.rules[k].name in CHECKED))
                last = -end
        return out


CHECKED = frozenset({"github_token", "npm_token", "iban", "card_number", "jwt"})
_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = scanner().find
    for batch in batches:
        rows: list[tuple] = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text:
                rows += [(i, *f) for f in find(text)]
        at, rule, start, end, checked = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(rule, pa.string()),
                pa.array(start, pa.int64()),
                pa.array(end, pa.int64()),
                pa.array(checked, pa.bool_()),
            ],
            ["doc_id", "rule", "start", "end", "checked"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rule, start, end, checked: a row for each secret found. One pass, no shuffle."""
    return texts(docs, id_col, text_col).mapInArrow(_scan_batches, "doc_id long, rule string, start long, end long, checked boolean")


def _redacted(column: pa.Array) -> pa.Array:
    find, out = scanner().find, []
    for text in column.to_pylist():
        for rule, start, end, _ in reversed(find(text) if text else []):
            text = f"{text[:start]}[{rule}]{text[end:]}"
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by its rule's name in brackets; other columns stay."""
    return docs.withColumn(text_col, F.arrow_udf(_redacted, StringType())(F.col(f"`{text_col}`").cast("string")))
