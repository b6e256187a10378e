"""The window network's batch forms against plainer ones."""

import random

import numpy as np
import pyarrow as pa

from quillward.llm import common, lm_score


def network(seed=3):
    r = np.random.default_rng(seed)
    keys = np.unique(r.integers(1, 1 << 62, 3000).astype(np.uint64))
    vocabulary = lm_score.Vocabulary(keys, np.sort(r.integers(1, 500, len(keys)))[::-1].copy(), 900_000, 50)
    net = lm_score.WindowNetwork(vocabulary, 8, seed)
    n = 700
    cls = r.integers(0, len(vocabulary.prior), n).astype(np.int32)
    return vocabulary, net, r.integers(0, vocabulary.edge + 1, (4, n)), cls, r.integers(0, lm_score.MEMBERS, n).astype(np.int32)


def test_softmax_calls_do_not_grow_with_classes(monkeypatch):
    _, net, ctx, cls, member = network()
    calls, whole = [], lm_score.WindowNetwork.log_softmax
    monkeypatch.setattr(lm_score.WindowNetwork, "log_softmax", staticmethod(lambda z, at: calls.append(z.shape) or whole(z, at)))
    got = net.log_p(ctx, cls, member)
    assert len(calls) == 2  # one by class, one of the members of all classes: 33 when each class had its own
    alone = np.concatenate([net.log_p(ctx[:, i : i + 1], cls[i : i + 1], member[i : i + 1]) for i in range(len(cls))])
    assert np.allclose(got, alone, atol=1e-5)


def test_step_follows_the_gradient():
    _, net, ctx, cls, member = network()
    sums, before = [np.zeros_like(p) for p in net.params], [p.copy() for p in net.params]
    net.step(ctx, cls, member, sums, 0.1)
    after, net.params = net.params, [p.astype(np.float64) for p in before]
    r = random.Random(2)
    for i in range(len(before)):
        flat, total = net.params[i].ravel(), sums[i].ravel()
        for at in r.sample(range(flat.size), min(12, flat.size)):
            was, sides = flat[at], []
            for way in (1e-3, -1e-3):
                flat[at] = was + way
                sides.append(-float(np.mean(net.log_p(ctx, cls, member))))
            flat[at] = was
            slope = (sides[0] - sides[1]) / 2e-3
            assert abs(np.sqrt(total[at]) - abs(slope)) < 2e-4
            want = was - 0.1 * slope / np.sqrt(slope**2 + 1e-8)
            assert abs(slope) < 1e-3 or abs(after[i].ravel()[at] - want) < 2e-2
    assert all((s >= 0).all() for s in sums)


def test_marks_equal_the_general_hashes():
    r = random.Random(7)
    texts = ["".join(r.choice(["a", "bc ", "é", "!", "?!", "...", "\n", "A", "-"] if k % 2 else ["word ", "x", "é ", "!", "(a)"]) for _ in range(r.randint(0, 60))) for k in range(400)] + ["", None, "!", "!!", "a!", "!" * 5000, "plain words only " * 300]
    for part in [texts, ["plain"] * 50 + ["! end.", ".start", "", "."], ["!"] * 3, [None], []]:
        data, offsets = common.raw_bytes(pa.array(part, pa.string()))
        for got, want in zip(lm_score.marks_of(data, offsets), common.word_hashes(data, offsets, lm_score._MARK, lm_score._PLAIN), strict=True):
            assert np.array_equal(got, want)
