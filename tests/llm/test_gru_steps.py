"""The network's hand-written steps against plain ones, and scores that do not depend on which texts lie side by side."""

import platform

import numpy as np
import pytest

from pagemill.llm import gru_lm as g


def plain_loss(flat, inputs, target, weight):
    """Mean negative log probability in double precision, one token after another."""
    w = {k: v.astype(np.float64) for k, v in g.Shape.views(flat).items()}
    h, loss = np.zeros((inputs.shape[1], g.HIDDEN)), 0.0
    for t in range(len(inputs)):
        x, u = w["embed"][inputs[t]] @ w["w_x"] + w["b_x"], h @ w["w_h"]
        z, r = (1 / (1 + np.exp(-(x + u)[:, i * g.HIDDEN : (i + 1) * g.HIDDEN])) for i in (0, 1))
        n = np.tanh(x[:, 2 * g.HIDDEN :] + r * u[:, 2 * g.HIDDEN :])
        h = n + z * (h - n)
        for i in np.flatnonzero(weight[t]):
            c = min(target[t, i] // g.PER_CLASS, g.CLASSES)
            for logits, k in [(h[i] @ w["w_c"] + w["b_c"], c)] + ([(h[i] @ w["w_o"][c] + w["b_o"][c], target[t, i] - c * g.PER_CLASS)] if c < g.CLASSES else []):
                loss -= logits[k] - np.log(np.exp(logits).sum())
    return loss / weight.sum()


def example(scale=1.0):
    rng = np.random.default_rng(3)
    flat = g.initial_weights(np.arange(g.VOCABULARY, 0, -1), 50)
    flat = ((flat + rng.normal(0, 0.2, len(flat))) * scale).astype(np.float32)
    lines = [rng.choice([*range(200), 4000, g.RARE], n).astype(np.int16) for n in (9, 7, 3, 1)]
    return flat, lines


def test_gradient_is_that_of_the_loss():
    flat, lines = example()
    columns = g._columns(lines, 9)
    trainer = g.Trainer(flat, 0.0)
    trainer.window(*columns, np.zeros((4, g.HIDDEN), dtype=np.float32))
    gradient, rng = trainer.g.astype(np.float64), np.random.default_rng(1)
    gradient *= 1 / np.linalg.norm(gradient)  # the trainer bounds it
    norm = None
    for name, view in g.Shape.views(np.arange(len(flat))).items():
        places = view.reshape(-1)
        way = np.zeros(len(flat))
        way[places] = rng.normal(size=len(places)) * (gradient[places] != 0)
        step = 1e-4
        slope = (plain_loss(flat + step * way, *columns) - plain_loss(flat - step * way, *columns)) / (2 * step)
        told = gradient @ way
        norm = slope / told if norm is None else norm
        assert abs(slope - norm * told) <= 1e-2 * abs(slope) + 1e-3, name


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_scores_are_those_of_plain_steps(scale):
    flat, lines = example(scale)
    want = [-plain_loss(flat, *g._columns([x], len(x))) * len(x) for x in lines]
    assert np.allclose(g.network_scores(flat, lines, window=4), want, rtol=1e-3)
    assert np.allclose([g.network_scores(flat, [x], window=4)[0] for x in lines], want, rtol=1e-3)


def test_texts_of_many_batches_are_scored_together(monkeypatch):
    """Side by side lie as many texts as their tokens allow, not 2,000 at most."""
    assert g.TOGETHER >= 1_000_000
    trainer = g.Trainer(example()[0], 0.01)
    before = trainer.room
    trainer.step()
    assert trainer.room is before  # no new vectors of all weights a step


def test_windows_of_a_batch_hold_every_token_once():
    """Windows come from one flat array; before, each was put together line by line."""
    rng = np.random.default_rng(5)
    lines = sorted((rng.integers(0, g.RARE + 1, n).astype(np.int16) for n in (1, 32, 33, 70, 7, 64, 1)), key=len, reverse=True)
    batch, seen, before = g.Batch(lines), [[] for _ in lines], [[] for _ in lines]
    for t in range(0, 70, 32):
        inputs, target, there = batch.window(t, 32)
        assert inputs.shape == target.shape == there.shape and len(inputs) == min(32, 70 - t)
        for i in range(inputs.shape[1]):
            seen[i] += target[there[:, i], i].tolist()
            before[i] += inputs[there[:, i], i].tolist()
    assert seen == [x.tolist() for x in lines]
    assert before == [[g.START, *x[:-1].tolist()] for x in lines]


def test_steps_take_their_inputs_when_they_come():
    """Whether the input part of words lies there as (T, B, 3H) or is looked up step by step, states are the same."""
    flat, lines = example()
    w = g.Shape.views(flat)
    inputs, h = g.Batch(lines).window(0, 9)[0], np.zeros((4, g.HIDDEN), dtype=np.float32)
    table = w["embed"] @ w["w_x"] + w["b_x"]
    there, kept = g._steps(w, table[inputs], h, True)
    looked, _ = g._steps(w, g.Looked(table, inputs), h, False)
    assert (there == looked).all() and kept[0].shape == (9, 4, g.HIDDEN)


def test_windows_do_not_fetch_new_memory():
    """What a window's arrays leave is used for the next; before, each window met thousands of new pages."""
    resource = pytest.importorskip("resource")
    if not platform.libc_ver()[0].startswith("glibc"):
        pytest.skip("tells how this C library keeps memory")
    rng = np.random.default_rng(7)
    lines = [rng.integers(0, g.RARE + 1, 320).astype(np.int16) for _ in range(256)]
    trainer = g.Trainer(example()[0], 0.01)
    g.learn(trainer, lines, 32, 256)
    before, steps = resource.getrusage(resource.RUSAGE_SELF).ru_minflt, trainer.t
    g.learn(trainer, lines, 32, 256)
    assert trainer.t == steps + 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 10 * 100


def test_rows_of_classes_are_grouped_whole():
    classes = [(0, slice(0, 3000)), (1, slice(3000, 3001)), (5, slice(3001, 3900)), (9, slice(3900, 4100))]
    groups = g._grouped(classes)
    assert all(x[-1][1].stop - x[0][1].start <= g.BLOCK for x in groups)
    assert [k for x in groups for c, at in x for k in range(at.start, at.stop)] == list(range(4100))
    assert {c: sum(at.stop - at.start for x in groups for k, at in x if k == c) for c, _ in classes} == {0: 3000, 1: 1, 5: 899, 9: 200}


def test_a_step_is_that_of_adam():
    """Whatever part of the weights is worked on at once."""
    trainer, rng = g.Trainer(example()[0], 0.015), np.random.default_rng(2)
    want, m, v = trainer.flat.astype(np.float64), 0.0, 0.0
    for t in range(1, 4):
        gradient = rng.normal(0, 1e-3 if t < 3 else 1, len(want))
        trainer.g[:] = gradient
        trainer.step()
        gradient /= max(1, np.linalg.norm(gradient))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        want -= 0.015 / (1 - 0.9**t) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    assert np.allclose(trainer.flat, want, atol=1e-5)
