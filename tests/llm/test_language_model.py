"""The recurrent model: gradients against differences, scores against a plain recomputation, held-out texts against word counts."""
import numpy as np

from fieldgauge.llm import lm_score
from fieldgauge.llm.store import table


def sequences(seed=2):
    draw = np.random.default_rng(seed)
    sizes = [7, 0, 12, 3]
    return draw.integers(1, lm_score.CLASSES, sum(sizes)).astype(np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def mean_loss(net, classes, word_at):
    inputs, targets, starts, active, _, _ = lm_score.lanes_of(classes, word_at)
    states, _ = lm_score._forward(net, inputs, starts, active, np.zeros((inputs.shape[1], lm_score.HIDDEN), np.float32), False)
    logs, n0 = lm_score._log_softmax(net, states).astype(np.float64), states.shape[1]
    real = (np.arange(n0)[None, :] < np.asarray(active)[:, None]).ravel()
    return -logs[np.arange(len(logs)), targets[:, :n0].ravel()][real].mean()


def test_gradients_match_differences():
    classes, word_at = sequences()
    start = lm_score.Net.fresh()
    learner = lm_score.Learner(lm_score.Net.of(start.flat()))
    learner.learn(classes, word_at)  # one window: nothing is cut off
    assert learner.steps == 1
    draw = np.random.default_rng(4)
    for name in lm_score.Net.NAMES:
        found = learner.first[name] / 0.1
        places = [np.unravel_index(i, found.shape) for i in np.argsort(-np.abs(found), axis=None)[:12]] + [tuple(draw.integers(0, s) for s in found.shape) for _ in range(8)]
        mine, want = [], []
        for at in places:
            net = lm_score.Net.of(start.flat())
            a = getattr(net, name)
            a[at] += 0.02
            up = mean_loss(net, classes, word_at)
            a[at] -= 0.04
            want.append((up - mean_loss(net, classes, word_at)) / 0.04)
            mine.append(float(found[at]))
        mine, want = np.array(mine), np.array(want)
        scale = (mine @ want) / (want @ want)  # large gradients are scaled down before the step
        assert 0 < scale <= 1.02 and np.abs(mine - scale * want).max() < 0.03 * np.abs(mine).max() + 1e-5, name


def test_scores_match_a_plain_recomputation():
    """One step at a time in 64 bits; over all next classes each step's probabilities sum to one."""
    classes, word_at = sequences(7)
    net, h = lm_score.Net.fresh(3), lm_score.HIDDEN
    prior = np.random.default_rng(1).dirichlet(np.ones(lm_score.CLASSES))
    x, u, c, v, b = (getattr(net, n).astype(np.float64) for n in lm_score.Net.NAMES)
    want = []
    for a, z in zip(word_at, word_at[1:]):
        state, total, last = np.zeros(h), 0.0, 0
        for k in [*classes[a:z].tolist(), 0]:
            gates, own = x[last], state @ u
            update, reset = (1 / (1 + np.exp(-(gates[i:i + h] + own[i:i + h]))) for i in (0, h))
            new = np.tanh(gates[2 * h:] + reset * (own[2 * h:] + c))
            state = (1 - update) * new + update * state
            e = np.exp(state @ v + b)
            p = 0.98 * e / e.sum() + 0.02 * prior
            assert abs(p.sum() - 1) < 1e-9
            total, last = total + np.log10(p[k]), k
        want.append(total)
    assert np.allclose(lm_score.class_scores(net, classes, word_at, prior), want, atol=1e-4)


def test_held_out_texts_score_above_word_counts(spark):
    rows = lm_score.lm_scores(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out AND n_tokens > 20").collect()
    assert len(rows) > 50 and sum(r["score"] > r["base_score"] for r in rows) >= 0.9 * len(rows)
