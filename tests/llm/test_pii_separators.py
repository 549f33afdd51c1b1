"""Number words parted by separators of any length, in time linear in the text."""

import time

import pytest

from provenant.llm import pii

DIGITS = "four one five five five five two six seven one".split()


@pytest.mark.parametrize("gap", [" ", " - ", "  - ", "   - ", " \n\n\n ", " " * 40, " -" * 20, "." * 400 + " "])
def test_separators(gap):
    text = "call plus" + gap + gap.join(DIGITS) + " now"
    base, added = pii.find_spans(text)
    assert base == [] and added == [("phone", 5, len(text) - 4)]
    assert pii.redact(text) == "call [PHONE] now"


def test_a_word_between_ends_a_run():
    assert pii.find_spans("call plus " + " and ".join(DIGITS)) == ([], [])


def test_time_is_linear():
    def seconds(n):
        began = time.process_time()
        for text in ("one " + " - " * n, ("one" + " " * 50) * (n // 50), "plus" + " " * n, ("dot" + " " * 30) * (n // 30), "one" + "." * n + "two" + "." * n):
            pii.find_spans(text)
        return time.process_time() - began

    seconds(1000)
    small, large = seconds(30_000), seconds(240_000)
    assert large < 8 * 4 * max(small, 0.02)
