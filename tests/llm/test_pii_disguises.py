"""Disguises beside brackets and spelled digits: entities, spaced-out signs, underscores, other spaces, letters among digits; and what only looks like them."""

import time

import pytest

from touchline.llm import pii


@pytest.mark.parametrize(
    "whole",
    [
        "joe&#64;example.com", "joe&#x40;example&#46;com", "joe&commat;example&period;com", "joe%40example.com", "joe @ example.com", "joe @ mail.example.com", "joe@ example . com", "joe @ example . co . uk",
        "joe_at_example_dot_com", "joe_at_mail.example dot com", "joe at example dot com", "joe (at) example.com", "+1 4l5 555 O123", "+1 415 555 2671", "4539 l488 O343 6467", "+l 415 555 2671 I",
    ],
)
def test_more_disguises(whole):
    text = f"write or call: {whole}; thanks"
    got = [text[a:b] for _, a, b in pii.spans(text)[1]]
    if whole.startswith("+l"):  # the sign and a letter: no number begins so
        assert whole not in got
    else:
        assert whole in got


@pytest.mark.parametrize("text", ["eggs @ 2.50 each and milk @ 1.10", "lunch @ noon . then home", "data_at_rest.txt", "100%40 of 3.5", "a & b; c # 64; d", "10l of O2 in l0 bags", "see @ . for it", "at_dot_at_dot"])
def test_what_is_no_identifier(text):
    assert pii.spans(text) == ([], [])


def test_base_spans_stay_and_long_texts_take_time_in_proportion():
    for text in ("a @ b.com " * 3, "x&#64;y.org and z@w.org", "1.2.3.4 @ 5.6.7.8"):
        base, every = pii.spans(text)
        assert base == pii.identifiers(text) and set(base) <= set(every)
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        assert len(pii.spans("joe @ example.com, 4l5 &#64; %40 _at_ x . y " * n)[1]) >= n
        took.append(time.time() - began)
    assert took[1] < 12 * took[0]
