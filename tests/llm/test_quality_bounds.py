"""A text's probability does not depend on the texts beside it."""

import numpy as np
from quadloom.llm import quality


def test_texts_score_alone_as_among_others():
    rnd = np.random.default_rng(5)
    model = quality.Model(rnd.normal(size=3 << quality.BITS).astype(np.float32), 0.1, 1.0, 0.0)
    texts = ["alpha beta gamma", "", "x", "ab", "délta zeta eta theta iota kappa lambda mu nu xi", " ", "one", "two words"]

    def scored(some):
        raw = [t.encode() for t in some]
        offsets = np.cumsum([0, *map(len, raw)])
        return model.probabilities(quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets)[0]).tolist()

    alone = [scored([t])[0] for t in texts]
    assert scored(texts) == alone and scored(texts[::-1]) == alone[::-1]
