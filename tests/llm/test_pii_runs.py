"""Pseudonyms of long runs of digit groups, of addresses beyond ASCII, and of spellings with many blanks."""

from __future__ import annotations

import re
import time

from terrado.llm import pii

KEY = "a key of the tests"


def shown(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonym_report(frame, key=KEY).collect(), key=lambda r: r.doc_id)]


def test_addresses_and_secrets_of_any_spelling(spark):
    texts = ["José@example.com", "bob@exämple.com", "a@x.x.x.x.x.x.x.x.x.com.5", "api_key:    abcdefgh12345", "a.b@c.com."]
    made = shown(spark, *texts)
    assert all(re.match(r"u[0-9a-f]{20}@pseudonym\.invalid", t) for t in (made[0], made[1], made[2], made[4]))
    assert made[3].startswith("secret-")
    assert made[2].endswith(".5") and made[4].endswith(".")


def luhn(text):
    digits = [int(c) for c in re.sub("[^0-9]", "", text)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0


def test_cards_in_runs_keep_their_format(spark):
    texts = ["4111 1111 1111 1111 378282246310005", "4 1 1 1-1111 1111 1111", "0000 0000 0000 0000", "1 " * 30, "12345678901234567890123 4111111111111111", "6011-1111-1111-1117 7"]
    made = shown(spark, *texts)
    for text, new in zip(texts, made, strict=True):
        assert re.sub("[0-9]", "9", text) == re.sub("[0-9]", "9", new)
    assert luhn(made[0][:19]) and luhn(made[0][20:]) and made[0][:19] != texts[0][:19] and made[0][20:] != texts[0][20:]
    assert luhn(made[1]) and made[1] != texts[1]
    assert made[2] == texts[2]
    assert made[4][:23] == texts[4][:23] and luhn(made[4][24:])
    assert luhn(made[5][:19]) and made[5] != texts[5]


def test_many_single_digits_in_time(spark):
    began = time.time()
    text = "1 " * 50_000
    assert shown(spark, text) == [text]
    assert time.time() - began < 40
