"""The scorer that decodes only tokens which may reach a rule, against decoding every token."""

import random

import numpy as np
import pyarrow as pa
from attrmill.llm import toxicity as T

WORDS = ["blorgit", "assess", "zannok", "hello", "tooth", "été", "слово", "ab", "wrackle", "ssl", "oo", "gg", "naïve"]
SIGNS = {"o": "0", "i": "1", "e": "3", "a": "@4*", "s": "$5", "t": "7+", "l": "1|£", "g": "69"}


def model():
    text = " ".join(WORDS * 20)
    (b,) = T._trigrams(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])]))
    total = np.full(T._BASE**3, 0.01)
    total[b.column(0).to_numpy()] += b.column(1).to_numpy()
    cube = total.reshape(T._BASE, T._BASE, T._BASE)
    return np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)


def disguise(rng, word):
    out = []
    for c in word:
        c = rng.choice(SIGNS[c]) if c in SIGNS and rng.random() < 0.3 else c.upper() if rng.random() < 0.1 else c
        out.append(c * rng.choice([1, 1, 1, 2, 3, 4, 6]))
        if rng.random() < 0.15:
            out.append(rng.choice([".", "-", "_", "'", "²", "…", "8", "!", "("]))
    return rng.choice(["", "", "(", "<0", "!!", "\"", "…"]) + "".join(out) + rng.choice(["", "", "!!", ")", "$", "0", ".", "s"])


def test_equal_to_decoding_every_token():
    rng = random.Random(11)
    m = model()
    rules = {"=blorgit": 0.9, "zan": 0.85, "=ab": 0.6, "=слово": 0.7, "été"[:3]: 0.65, "wrackle": 0.95, "=ssl": 0.5, "too": 0.4, "=oo": 0.3, "na": 0.2}
    score = T.Scorer(rules, m)
    found = 0
    for _ in range(4000):
        token = disguise(rng, rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS)]))
        want = max((rules.get(f, 0.0) for w in T.restored_words(token, m) for f in T.features(w)), default=0.0)
        assert score.token(token) == want, token
        found += want > 0
    assert found > 1000


def test_odd_texts():
    m = model()
    score = T.Scorer({"=blorgit": 0.9}, m)
    assert score(None) == score("") == score(" \n\t") == score("²½ 0000 ****") == T.LEAST_SCORE
    assert score("x" * 1_000_000 + " blorgit") == 0.9
    assert T.Scorer({}, m)("blorgit") == T.LEAST_SCORE
