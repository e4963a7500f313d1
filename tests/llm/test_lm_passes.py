"""Training of the window network looks at every window of every text."""

import numpy as np

from lodestone.llm import lm_score


def test_a_round_passes_over_every_window(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.zipf(1.5, rng.integers(0, 300)).clip(max=9999))) for _ in range(300)]
    of, _ = lm_score.classes(np.bincount(lm_score.words(texts)[0], minlength=lm_score.BUCKETS))
    seen = []
    weights = lm_score.start_weights(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    monkeypatch.setattr(lm_score, "gradients", lambda w, x, target: (seen.append(np.column_stack([x, target])), (0.0, [np.zeros_like(v) for v in w]))[1])
    monkeypatch.setattr(lm_score, "LEAST_STEPS", 1)
    monkeypatch.setattr(lm_score, "CHUNK", 5000)
    trainer = lm_score.train(weights, iter([texts[:100], [], texts[100:]]), of, 0.001, 1)
    want = np.concatenate([np.column_stack(w) for w in lm_score.windows(texts, of)])
    got = np.concatenate(seen)
    assert trainer.seen == len(want) == len(got) and sorted(map(tuple, got.tolist())) == sorted(map(tuple, want.tolist()))
    seen.clear()
    monkeypatch.setattr(lm_score, "LEAST_STEPS", 40)
    trainer = lm_score.train(weights, iter([texts[:20]]), of, 0.001, 1)
    some = len(lm_score.words(texts[:20])[0])
    assert trainer.step >= 40 and trainer.seen == some and sum(map(len, seen)) % some == 0
