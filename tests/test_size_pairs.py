import random
import re

import pytest

from lexweave.operators import corpus


@pytest.mark.parametrize("collide", [False, True])
def test_sets_meet_in_small_chunks(spark, monkeypatch, collide):
    monkeypatch.setattr(corpus, "CHUNK_DOCS", 2)
    monkeypatch.setattr(corpus, "SKETCH", 4)
    rng = random.Random(3)
    texts = []
    for k in range(12):
        own = [f"{'abcdefghij'[rng.randrange(10)]}{'klmnop'[rng.randrange(6)]}x" for _ in range(20)]
        texts += [" ".join(own), " ".join(own), " ".join(own[:-1] + ["zz"]), " ".join(own + own[:2])]
    texts += ["", None, "12", "a"]
    if collide:  # as if two types had one hash
        monkeypatch.setattr(corpus.F, "min", lambda c, m=corpus.F.min: m(c) if isinstance(c, str) else m(c) - 1)
    docs = spark.createDataFrame([(i, t, None if i == 2 else "de" if i % 5 == 4 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    sets = {i: set(re.findall(r"[a-z]+", re.sub(r"\d+", " ", t))) for i, t in enumerate(texts) if t and re.findall(r"[a-z]+", t)}
    want = {(i, j): round(len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])), 6) for i in sets for j in sets if lang[i] is not None and lang[i] == lang[j] and (len(texts[i]), i) < (len(texts[j]), j) and len(texts[j]) < 1.2 * len(texts[i]) and len(sets[i] & sets[j]) * 100 > 85 * min(len(sets[i]), len(sets[j]))}
    assert len(want) > 20 and {(r.i, r.j): r.overlap for r in corpus.overlap_pairs(docs).collect()} == want
