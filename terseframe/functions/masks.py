"""Masks for secrets and personal data: ordered patterns, two of them validated.

One Arrow function applies the whole chain: expressed as columns, every step's count and replacement
would both repeat all steps before it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow

# Name, pattern and mask, in order of application.
PATTERNS = (
    ("pem_private_key", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+ PRIVATE KEY-----", "[REDACTED:PRIVATE_KEY]"),
    ("bearer_token", r"(?i)(Authorization\s*[:=]\s*Bearer\s+)([\w\-\.]{20,})", "[REDACTED:BEARER]"),
    ("sk_key", r"\b(sk-[A-Za-z0-9\-_]{32,})\b", "[REDACTED:API_KEY]"),
    ("github_pat", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", "[REDACTED:GITHUB_TOKEN]"),
    ("slack_token", r"\b(xox[baprs]-[A-Za-z0-9\-]{10,})\b", "[REDACTED:SLACK_TOKEN]"),
    ("aws_access_key", r"\b(AKIA[0-9A-Z]{16})\b", "[REDACTED:AWS_KEY]"),
    ("aws_secret", r"(?i)(aws[_\-]?secret[_\-]?access[_\-]?key\s*[=:]\s*)([A-Za-z0-9/+]{40})", "[REDACTED:AWS_SECRET]"),
    ("connection_string", r"(?i)(postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9_\-\.%]+:[^@\s]{1,128}@[^\s\"']{1,256}", "[REDACTED:CONN_STRING]"),
    ("password_kv", r"(?i)(?:\"password\"\s*:\s*\"|password\s*[=:]\s*[\"']?)([^\"'\s,}{]{6,})", "[REDACTED:PASSWORD]"),
    ("credit_card", r"\b(?:\d[ \-]?){13,19}\b", "[REDACTED:CC]"),
    ("ssn", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", "[REDACTED:SSN]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED:EMAIL]"),
)
ENTROPY_RUN, ENTROPY_LEAST, ENTROPY_MASK = r"[A-Za-z0-9+/=_\-]{40,}", 4.5, "[REDACTED:HIGH_ENTROPY]"
#: What a text must hold, in lower case, for a pattern to match at all; a digit stands for any.
_NEEDS = {"pem_private_key": "private key-----", "bearer_token": "bearer", "sk_key": "sk-", "github_pat": "gh", "slack_token": "xox", "aws_access_key": "akia", "aws_secret": "aws", "connection_string": "://", "password_kv": "password", "email": "@"}
_COMPILED = tuple((name, re.compile(p), mask) for name, p, mask in PATTERNS)
_DIGIT = re.compile(r"\d")
_RUN = re.compile(ENTROPY_RUN)


def luhn(text: str) -> bool:
    total = 0
    for i, d in enumerate(int(c) for c in reversed(text) if c.isdigit()):
        total += d if i % 2 == 0 else sum(divmod(d * 2, 10))
    return total % 10 == 0


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def mask(text: str) -> tuple[str, dict[str, int]]:
    hits: Counter[str] = Counter()

    def put(name: str, new: str, valid):
        def one(m: re.Match) -> str:
            if not valid(m[0]):
                return m[0]
            hits[name] += 1
            return new

        return one

    low, digit = text.lower().replace("ſ", "s"), _DIGIT.search(text)  # the long s is an s where case is ignored
    for name, pattern, new in _COMPILED:
        # masks only add capital letters, so what the text lacks at first it lacks later
        if not (_NEEDS[name] in low if name in _NEEDS else digit):
            continue
        text = pattern.sub(put(name, new, luhn if name == "credit_card" else bool), text)
    text = _RUN.sub(put("high_entropy", ENTROPY_MASK, lambda s: entropy(s) >= ENTROPY_LEAST), text)
    return text, dict(hits)


@arrow("struct<text:string,hits:map<string,int>>")
def scrub(texts: pd.Series) -> pd.DataFrame:
    done = [(None, None) if t is None else mask(t) for t in texts]
    return pd.DataFrame({"text": [t for t, _ in done], "hits": [h for _, h in done]})


def luhn_ok(digits: Column) -> Column:
    """Luhn test of a digit string in plain expressions."""
    n = F.length(digits)

    def step(s, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def entropy_bits(text: Column) -> Column:
    """Shannon entropy in bits a character, in plain expressions."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.length(text)
    return F.aggregate(F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda s, x: s + x)
