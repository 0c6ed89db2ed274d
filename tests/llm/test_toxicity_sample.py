"""Which labelled texts the weights of the toxicity model are fitted to."""

import random

from pagemill.llm import toxicity


def test_long_texts_are_drawn_like_short_ones(spark, monkeypatch):
    """Texts are taken in the order of a hash until the room is used up: none is passed over for its length."""
    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows = [(i, some(400 if i % 4 == 0 else 10), i % 2) for i in range(200)]
    fitted = {}

    def fit(found, toxic, ratios, *_):
        fitted["sizes"], fitted["toxic"] = [len(x) for x in found], toxic.tolist()
        return ratios.astype("float32"), 0.0

    monkeypatch.setattr(toxicity, "_fit", fit)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.train_toxicity(docs, least_documents=1, least_ratio=0.0)
    whole = [(t, n) for t, n in zip(fitted["toxic"], fitted["sizes"], strict=True)]
    assert len(whole) == 200
    room = 40_000
    toxicity.train_toxicity(docs, least_documents=1, least_ratio=0.0, fit_features=2 * room)
    part = [(t, n) for t, n in zip(fitted["toxic"], fitted["sizes"], strict=True)]
    for label in (0, 1):
        every, some_of_them = [n for t, n in whole if t == label], [n for t, n in part if t == label]
        assert some_of_them == every[: len(some_of_them)] and sum(some_of_them) <= room
        assert len(some_of_them) == len(every) or sum(every[: len(some_of_them) + 1]) > room
    assert len(part) < 200
