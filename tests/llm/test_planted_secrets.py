"""Keys as they are made, planted among words, and harmless strings that look like them."""

import base64
import random
import string

from folioquarry.llm import secret_scan

rng = random.Random(20)
_ALNUM = string.ascii_letters + string.digits
pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
MAKERS = {
    "alphanumeric": lambda: pick(_ALNUM, 40),
    "base64": lambda: base64.b64encode(rng.randbytes(30)).decode(),
    "urlsafe": lambda: base64.urlsafe_b64encode(rng.randbytes(33)).decode(),
    "prefixed": lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(_ALNUM, 36),
    "signed token": lambda: ".".join(base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=") for n in (27, 60, 32)),
    "upper-case hex": lambda: pick("0123456789ABCDEF", 40),
    "short hex": lambda: pick("0123456789abcdef", 28),
    "short": lambda: pick(_ALNUM, 18),
}
HARMLESS = [
    "123e4567-e89b-12d3-a456-426614174000", "internationalisation-of-words-and-more", "1234567890123456789012345", "2024-01-31T10:20:30.000", "src/main/java/org/example/Application2.java",
    "http://www.example.com/2024/05/some-title-of-a-page", "org.apache.spark.sql.functions", "version-1.2.3-beta4", "ThisIsACamelCaseIdentifierName", "CONSTANT_NAME_OF_A_SETTING", "====================", "abababababababab12121212",
    "transformation16", "user_name_2_first_last", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "AB12-CD34-EF56-GH78", "+49-30-1234567-890123", "supercalifragilisticexpialidocious",
]


def test_planted_keys_are_found():
    for kind, make in MAKERS.items():
        keys = [make() for _ in range(200)]
        texts = [f"the key is {rng.choice(['', chr(34), '('])}{k}{rng.choice(['', '.', ',', chr(34)])} so keep it" for k in keys]
        found = [any(t[a:b] == k or k.startswith(t[a:b]) and b - a >= len(k) - 2 for a, b, _ in x + y) for t, k, (x, y) in zip(texts, keys, secret_scan.find(texts), strict=True)]
        assert sum(found) / len(found) >= (0.9 if kind.startswith("short") else 0.97), kind


def test_harmless_strings_are_not():
    texts = [f"see {x} for more" for x in HARMLESS]
    assert [(t, y) for t, (x, y) in zip(texts, secret_scan.find(texts), strict=True) if y] == []
