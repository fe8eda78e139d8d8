"""Licence spans of texts that repeat one line: against spans taken one by one, and in time."""

from __future__ import annotations

import time

from terrado.llm import licenses


def scanner():
    return licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES, licenses.MIN_RUN, licenses.MAX_GAP, licenses.MIN_COVER)


def test_spans_never_overlap_and_none_is_missing():
    text = "Licensed under CC BY 4.0. " * 40 + "some other words here " * 3 + "Licensed under CC BY 4.0"
    n, _, spans = scanner().scan(text.lower().encode())
    by_label = {}
    for label, start, end, _ in spans:
        by_label.setdefault(label, []).append((start, end))
    for found in by_label.values():
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert found[-1][1] <= n
    one = scanner().scan(b"licensed under cc by 4.0")[2]
    assert {s[0] for s in one} == set(by_label)
    assert all(len(found) == 41 for found in by_label.values())


def test_a_line_that_fills_five_megabytes():
    text = ("licensed under cc by 4.0 " * 200_000).encode()
    began = time.time()
    spans = scanner().scan(text)[2]
    assert time.time() - began < 60
    assert len(spans) >= 200_000
