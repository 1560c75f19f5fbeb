"""Keys of more encodings, and runs that look like keys and are none."""

from __future__ import annotations

import random

import pytest

from tessera.llm import secret_scan

HEX = "0123456789abcdef"
R = random.Random(11)


def pick(alphabet, n):
    return "".join(R.choices(alphabet, k=n))


def cased(n):
    return "".join(c.upper() if R.random() < 0.5 else c for c in pick(HEX, n))


KEYS = {
    "mixed hex": lambda: cased(40), "0x and capital hex": lambda: "0x" + pick(HEX.upper(), 40), "0X and mixed hex": lambda: "0X" + cased(40), "digits": lambda: pick("0123456789", 32),
    "product keys": lambda: "-".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 5) for _ in range(5)), "grouped base 36": lambda: "-".join(pick("abcdefghijklmnopqrstuvwxyz0123456789", 8) for _ in range(4)),
}


@pytest.mark.parametrize("name", KEYS)
def test_nearly_all_keys_are_found(name):
    found = 0
    for _ in range(300):
        text = f"the key is {KEYS[name]()} here"
        n, spans = secret_scan.scan(text)[2], secret_scan.scan(text)[4]
        found += bool(n or "random" in spans)
    assert found >= 285, found


@pytest.mark.parametrize("run", [
    "szczebrzeszynskichrzaszczbrzmi", "zwyczajnymisrodkamiprzymusu", "qwertyuiopasdfghjklzxcvbnm", "abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789ABCDEFabcdef", "deadbeefdeadbeefDEADBEEFdeadbeef",
    "SOME-LONG-PRODUCT-NAME-2020-EDITION", "2021-01-01-2021-02-02-2021-03", "PART-0001-0002-0003-0004-A", "order-12345-item-67890-line-3", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "0x00000000000000000000FFFFFFFF",
])
def test_runs_that_are_no_keys(run):
    assert secret_scan.scan(f"see {run} there")[4] == ""


def test_the_encoding_of_a_run():
    names = {"1" * 20: "digits", "1a" * 12: "hex", "1aF" * 12: "mixed hex", "0x1aF" + "1aF" * 8: "mixed hex", "ABCDE-12345-FGHIZ": "grouped base36", "1f-2f-3f": "grouped hex", "abz": "letters", "aBz_": "base64", "a.b": "none"}
    assert {r: secret_scan.infer(r)[0] for r in names} == names
    assert secret_scan.infer("0x1a==")[1] == [1, 10]
