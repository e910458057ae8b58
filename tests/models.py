"""Plain-Python models that the Spark operators are compared with, on small inputs."""

import math
import random
import re
from collections import Counter

ALPHABET = list("abzAZ09 _-=:;'\"{}()[]<>.,/\\@#$%&*+?!|~^\n\t") + ["é", "ß", "İ", "ſ", "😀", "日", "١", " ", "\x1c"]
WORDS = [
    "token", "password", "AKIA", "var x=", "https://", "docs.", "function(e){", "color: #fff", "schemas.android.com",
    "=\"", "\":\"", "{0}", "test_", "${a.b}", "Math.floor", "true", "class=", "ghp_", "\\n", "api_key", "secret", "192.168.0.1",
]


def random_text(rng: random.Random, size: int) -> str:
    return "".join(rng.choice(WORDS) if rng.random() < 0.25 else rng.choice(ALPHABET) for _ in range(size))


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def matches(pattern: str, body: str):
    """(line, column, offset, text) of every match."""
    for m in re.compile(pattern, re.I | re.M).finditer(body):
        before = body[: m.start()]
        yield before.count("\n") + 1, m.start() - before.rfind("\n"), m.start(), m.group(0)


def split(text: str, groups):
    """(variable, value) of a match."""
    from leakframe import fixed_values as fv

    found = re.search(fv.JSON_VALUE, text, re.I)
    if found:
        key = re.search(fv.JSON_KEY, text)
        return (key.group(1).upper() if key else None), found.group(1)
    found = re.search(fv.CONNECTION_PASSWORD, text, re.I)
    if found:
        return "DB_PASSWORD", found.group(1)
    found = re.match(fv.ASSIGNMENT, text.strip(), re.I)
    if found:
        return found.group(1).upper(), found.group(2)
    full = [g for g in groups if g]
    names = [g for g in full if re.match(fv.IDENTIFIER, g)]
    values = [g for g in full if not re.match(fv.IDENTIFIER, g)]
    return (names[0].upper() if names else None), (values[0] if values else None)
