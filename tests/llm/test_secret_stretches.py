from __future__ import annotations

import random
import string

import numpy as np

from quire.llm import secrets_scan


def masked(text, model):
    data = np.frombuffer(text.encode(), np.uint8)
    got = secrets_scan.scan_batch(data, np.array([0, len(data)]), model)
    hidden = np.zeros(len(data), bool)
    for s, _, e in got.get(0, ()):
        hidden[s:e] = True
    return hidden


def test_keys_glued_to_ordinary_text_are_found():
    model = secrets_scan.MarkovPair.train(secrets_scan.labelled_samples())
    r = random.Random(5)
    heads = ["AWS_SECRET_ACCESS_KEY=", "/account/profile/settings/", "service/library/download/version/container/", "token=abcdefgh/"]
    for head in heads:
        for n in (24, 40):
            keys = ["".join(r.choices(string.ascii_letters + string.digits, k=n)) for _ in range(200)]
            caught = np.mean([masked(f"see {head}{k} end", model)[4 + len(head) : 4 + len(head) + n].all() for k in keys])
            print("FIG", head, n, caught)
            assert caught > 0.9, (head, n, caught)


def test_a_second_key_beside_a_base_span_is_found():
    model = secrets_scan.MarkovPair.train(secrets_scan.labelled_samples())
    text = "x " + "0a1b2c3d4e5f" * 3 + "_9fK2mQ8xZr4Lw7Tp1Vb6Nc3Hd5Js0Ga"
    assert masked(text, model)[2:].sum() >= len(text) - 3


def test_ordinary_identifiers_have_no_stretches():
    model = secrets_scan.MarkovPair.train(secrets_scan.labelled_samples())
    held = [t.encode() for t, y in secrets_scan.labelled_samples(1500, 99) if not y]
    share = np.mean([bool(model.stretches(t)) for t in held])
    print("FIG false", share)
    assert share < 0.01
