"""A run that a rule's span overlaps is scored in the pieces beside it."""

import random

import numpy as np
from quadloom.llm import secrets


def test_pieces_beside_the_rules_spans():
    model = np.full((257, 256), 9.0)
    text = "AKIA" + "B" * 16 + "/" + "x" * 40
    assert secrets.markov_spans(text, model, secrets.base_spans(text)) == [(20, 61, "markov")]
    rnd = random.Random(4)
    for _ in range(300):
        text = " ".join("k" * rnd.randint(10, 90) for _ in range(3))
        taken = sorted((a, a + rnd.randint(1, 30), "x") for a in (rnd.randrange(len(text)) for _ in range(rnd.randint(0, 5))))
        free = "".join(" " if any(a <= i < b for a, b, _ in taken) else c for i, c in enumerate(text))
        want, at = [], 0
        for piece in free.split(" "):
            if len(piece) >= secrets.RUN:
                want.append((at, at + len(piece), "markov"))
            at += len(piece) + 1
        assert secrets.markov_spans(text, model, taken) == want
