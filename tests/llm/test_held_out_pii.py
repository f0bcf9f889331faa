"""Sentences that no template was made from and that nothing was tuned on, and the calibration."""

import numpy as np

from gridloom.llm import pii

#: (before, span, after)
PRIVATE = [
    ("Ask for Dana, phone ", "(212) 555-0187", ", after nine."), ("Our fax is ", "030 9018 2245", " as before."), ("Send it to the office: mail ", "jo.stone (at) harbour.org", " please."),
    ("Contact me, ", "lee[at]northbank[dot]com", " works best."), ("The login came from host ", "10[.]42[.]7[.]19", " last night."), ("you can call ", "415-555-0133", " any day"),
    ("mobile ", "01 44 71 90 22", " thanks"), ("My number is ", "555 0199 23", "."), ("Paid with card ", "378282246310005", " on Monday"),
    ("Tel. ", "0044 20 7946 0958", ", Mrs Hill"), ("write to ", "press {at} museum.net", " for photos"), ("server ", "172 dot 16 dot 4 dot 9", " is down"),
]
CLEAN = [
    "The meeting on 2023-11-05 was moved to 06/12/2023.", "They call it the 1998 2004 2010 series.", "Version 10.15.7 replaced 10.14.6 last year.", "The prize is 2500000 dollars this time.",
    "Call for papers 2025-03-01 closes soon.", "In total 1048576 rows were read.", "See pages 112-118 and 245-251.", "The text has 4500000 characters in it.", "Lunch at noon. Then we go on.",
    "A ratio of 3.1415926 is close enough.", "Order number 88213 4471 shipped.", "We met at home. Net gains were small.", "The years 1914-1918 and 1939-1945 were hard.", "Reach 3000000 people with one message.",
]


def test_held_out_sentences():
    """The figures that README states."""
    model, thresholds = pii.trained()
    found = pii.all_spans([b + s + a for b, s, a in PRIVATE], model, thresholds)
    whole = sum(any((a, e) == (len(b), len(b) + len(s)) for _, a, e in spans) for (b, s, _), (_, spans) in zip(PRIVATE, found))
    flagged = sum(bool(spans) for _, spans in pii.all_spans(CLEAN, model, thresholds))
    print("held out:", whole, "of", len(PRIVATE), "whole;", flagged, "of", len(CLEAN), "clean flagged")
    assert whole >= 8 and flagged <= 3


def test_thresholds_come_from_calibration():
    _, thresholds = pii.trained()
    assert len(set(thresholds.values())) == 4 and all(0 < t < 1 for t in thresholds.values())


def test_isotonic():
    draw = np.random.default_rng(1)
    score = draw.random(4000).round(2)
    y = (draw.random(4000) < score**2).astype(float)
    least, share = pii.isotonic(score, y)
    assert (np.diff(least) > 0).all() and (np.diff(share) > 0).all()
    assert np.isclose(np.mean(share[np.searchsorted(least, score, side="right") - 1]), y.mean())
    assert np.abs(share[np.searchsorted(least, score, side="right") - 1] - score**2).mean() < 0.06
