"""A bidirectional LSTM over characters with CRF transitions, in numpy.

Inputs are batches of windows of one length as symbol numbers; 0 fills up. Tags are BIO tags
of the kinds of personal data. Training maximises the likelihood of whole tag sequences;
decoding takes scores per character, joined over overlapping windows by the caller.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 12, 16

# Symbols: letters without case, all digits as one, ASCII punctuation, and three rests.
_LETTER, _DIGIT, _PUNCT = 1, 27, 28
SYMBOLS = _PUNCT + 33 + 4


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 128)]


def _table() -> np.ndarray:
    table = np.full(129, SYMBOLS - 1, np.int64)  # beyond ASCII
    mark = _PUNCT
    for code in range(128):
        c = chr(code)
        if c.isalpha():
            table[code] = _LETTER + ord(c.lower()) - ord("a")
        elif c.isdigit():
            table[code] = _DIGIT
        elif c in "\t\n\v\f\r" or code < 32:
            table[code] = SYMBOLS - 2
        elif code < 127:
            table[code] = mark
            mark += 1
    return table


_TABLE = _table()


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_parameters(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED))}
    for way in "fb":
        p[f"w{way}"] = rng.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        p[f"c{way}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates open
    p["out"] = rng.normal(0, 0.25, (2 * HIDDEN, TAGS))
    p["bias"] = np.zeros(TAGS)
    p["moves"] = np.zeros((TAGS, TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def forbidden() -> np.ndarray:
    """Minus a large number where one tag can't follow another: inside needs its own kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside - 1, inside):
                out[before, inside] = -1e4
    return out


FORBIDDEN = forbidden()


def _lstm(x, w, bias, keep):
    """States of one direction; x is (time, batch, embed). ``keep`` collects for training."""
    steps, batch, _ = x.shape
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    projected = x @ w[:EMBED] + bias
    inner = w[EMBED:]
    for t in range(steps):
        z = projected[t] + h @ inner
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        squashed = np.tanh(c)
        if keep is not None:
            keep.append((h, before, f, i, o, g, squashed))
        h = o * squashed
        out[t] = h
    return out


def _lstm_back(x, w, kept, grad):
    """Gradients of (x, w, bias) from those of the states."""
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
    dh = dc = np.zeros_like(kept[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, c, f, i, o, g, squashed = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate(
            [dc * c * f * (1 - f), dc * g * i * (1 - i), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1
        )
        dw[:EMBED] += x[t].T @ dz
        dw[EMBED:] += h.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w[:EMBED].T
        dh = dz @ w[EMBED:].T
        dc = dc * f
    return dx, dw, db


def emissions(p: dict, windows: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """(batch, time, tags) scores of each character's tags."""
    x = p["embed"][windows.T]
    keep_f, keep_b = ([], []) if kept is not None else (None, None)
    states = np.concatenate(
        [_lstm(x, p["wf"], p["cf"], keep_f), _lstm(x[::-1], p["wb"], p["cb"], keep_b)[::-1]], axis=2
    )
    if kept is not None:
        kept.update(x=x, f=keep_f, b=keep_b, states=states)
    return (states @ p["out"] + p["bias"]).transpose(1, 0, 2)


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _both_ways(scores: np.ndarray, m: np.ndarray):
    """(scores of all prefixes, of all suffixes, of all sequences) by their last or next tag."""
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    steps = scores.shape[1]
    for t in range(1, steps):
        ahead[:, t] = scores[:, t] + _logsumexp(ahead[:, t - 1, :, None] + m, 1)
    for t in range(steps - 2, -1, -1):
        back[:, t] = _logsumexp(m + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    return ahead, back, _logsumexp(ahead[:, -1], 1)


def marginals(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability of each tag at each place, over all sequences.

    Messages are scaled at every step, and the tags of each place to one, so that a stretch may
    be of any length.
    """
    scores, m = scores.astype(np.float64), (moves + FORBIDDEN).astype(np.float64)
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    steps = scores.shape[1]
    for t in range(steps):
        here = scores[:, t] + (_logsumexp(ahead[:, t - 1, :, None] + m, 1) if t else 0)
        ahead[:, t] = here - _logsumexp(here, 1)[:, None]
    for t in range(steps - 2, -1, -1):
        here = _logsumexp(m + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = here - _logsumexp(here, 1)[:, None]
    both = ahead + back
    return np.exp(both - _logsumexp(both, 2)[:, :, None])


def crf_gradients(scores: np.ndarray, tags: np.ndarray, moves: np.ndarray):
    """(mean loss, gradients of the scores, gradients of the moves) of true tag sequences."""
    batch, steps, _ = scores.shape
    m = moves + FORBIDDEN
    ahead, back, total = _both_ways(scores, m)
    grad = np.exp(ahead + back - total[:, None, None])
    rows, times = np.arange(batch)[:, None], np.arange(steps)
    truth = scores[rows, times, tags].sum(axis=1) + m[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    grad[rows, times, tags] -= 1
    pairs = np.exp(
        ahead[:, :-1, :, None] + m + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    ).sum(axis=(0, 1))
    np.subtract.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
    return float((total - truth).mean()), grad / batch, pairs / batch


def train(windows: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, seed: int = 5) -> dict:
    """Adam on batches drawn in a fixed order."""
    p = start_parameters(seed)
    if not len(windows):
        p["bias"][0] = 10.0  # nothing learned: everything is outside
        return p
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), min(batch, len(windows)))
        kept: dict = {}
        scores = emissions(p, windows[rows], kept)
        _, d_scores, d_moves = crf_gradients(scores, tags[rows], p["moves"])
        d = d_scores.transpose(1, 0, 2).astype(np.float32)
        flat, states = d.reshape(-1, TAGS), kept["states"].reshape(-1, 2 * HIDDEN)
        g = {"out": states.T @ flat, "bias": flat.sum(axis=0), "moves": d_moves}
        d_states = d @ p["out"].T
        dx, g["wf"], g["cf"] = _lstm_back(kept["x"], p["wf"], kept["f"], d_states[:, :, :HIDDEN])
        back, g["wb"], g["cb"] = _lstm_back(kept["x"][::-1], p["wb"], kept["b"], d_states[::-1, :, HIDDEN:])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], windows[rows].T, dx + back[::-1])
        rate = 0.02 * (1 - step / (steps + 1))
        for k in p:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag sequence of each row of (batch, time, tags)."""
    batch, steps, _ = scores.shape
    m = moves + FORBIDDEN
    best, came = scores[:, 0], np.empty((steps, batch, TAGS), np.int8)
    for t in range(1, steps):
        through = best[:, :, None] + m
        came[t] = through.argmax(axis=1)
        best = through.max(axis=1) + scores[:, t]
    out = np.empty((batch, steps), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = came[t][np.arange(batch), out[:, t]]
    return out
