"""A hidden Markov model over the lines of texts: prose, list, table or junk.

Emissions come from a softmax over a line's statistics, divided by the classes' shares among the
training lines; transitions are counted. Only texts are labelled, not lines, so the model is fitted
by turns: lines of a text labelled L may be prose or L, lines of a prose text are mostly prose; the
best path under that constraint gives the lines' labels for the next turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from geoloom.llm.line_features import Lines

LABELS = ("prose", "list", "table", "junk")

#: Lines drawn for a step of the fit; its cost does not depend on the number of training lines.
DRAWN = 2048
#: Prose texts that each other text is joined with, and the least probability of a step between labels.
MIXED, LEAST_STEP = 2, 0.01


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class LineModel:
    weights: list[np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    log_share: np.ndarray
    log_start: np.ndarray
    log_step: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.shift) * self.scale
        hidden, out = self.weights
        h = np.maximum(x @ hidden, 0)
        return _log_softmax(np.concatenate([x, h], 1) @ out) - self.log_share

    def label(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best path of each text; ``text`` is not falling."""
        return best_paths(self.emissions(features), text, self.log_start, self.log_step)


def best_paths(emit: np.ndarray, text: np.ndarray, log_start: np.ndarray, log_step: np.ndarray) -> np.ndarray:
    """Viterbi paths of all texts at once: one step for the t-th lines of all texts that have one."""
    n, k = emit.shape
    if not n:
        return np.empty(0, np.int64)
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    length = np.diff(np.append(begin, n))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts with a t-th line
    back = np.zeros((n, k), np.int8)
    score = log_start + emit[begin]
    ends = np.empty((len(begin), k), score.dtype)
    for t in range(1, length[0]):
        going = alive[t]
        ends[going : len(score)] = score[going:]
        via = score[:going, :, None] + log_step
        best = via.argmax(axis=1)
        back[begin[:going] + t] = best
        score = np.take_along_axis(via, best[:, None, :], 1)[:, 0] + emit[begin[:going] + t]
    ends[: len(score)] = score
    path = np.empty(n, np.int64)
    state = ends.argmax(axis=1)
    path[begin + length - 1] = state
    for t in range(length[0] - 1, 0, -1):
        going = alive[t]
        state[:going] = back[begin[:going] + t, state[:going]]
        path[begin[:going] + t - 1] = state[:going]
    return path


def _fit_softmax(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int, weights, rounds: int, decay: float, rate: float = 0.02) -> list[np.ndarray]:
    """A softmax over the inputs and a layer of rectified units, by Adam over drawn rows."""
    rng = np.random.default_rng(11)
    width, k = x.shape[1], len(LABELS)
    if weights is None:
        weights = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)).astype(np.float32), np.zeros((width + hidden, k), np.float32)]
    drawn = np.random.default_rng(5).choice(len(x), (rounds, DRAWN), p=weight / weight.sum())
    mean, var = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step, rows in enumerate(drawn, 1):
        xs = x[rows]
        pre = xs @ weights[0]
        both = np.concatenate([xs, np.maximum(pre, 0)], 1)
        error = np.exp(_log_softmax(both @ weights[1]))
        error[np.arange(DRAWN), y[rows]] -= 1
        error /= DRAWN
        g_out = both.T @ error + decay * weights[1]
        g_hidden = xs.T @ ((error @ weights[1][width:].T) * (pre > 0)) + decay * weights[0]
        for i, g in enumerate((g_hidden, g_out)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            weights[i] = weights[i] - rate * (1 - step / (rounds + 1)) * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
    return weights


def mixtures(labels: np.ndarray, size: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Pairs of texts, one of them prose, to be put end to end: contexts that single texts lack.

    Each text that is no prose meets MIXED prose texts, before it or behind it; texts of ``longest``
    characters or more meet none.
    """
    rng = np.random.default_rng(3)
    prose = np.flatnonzero((labels == 0) & (size < longest))
    out = []
    for other in np.flatnonzero((labels > 0) & (size < longest)):
        for p in rng.choice(prose, MIXED) if len(prose) else ():
            out.append((int(p), int(other)) if rng.random() < 0.5 else (int(other), int(p)))
    return out


def fit(
    texts: list[str], label_of_text: np.ndarray, common: np.ndarray, longest_mixed: int = 20_000, turns: int = 3, hidden: int = 12, rounds: int = 200
) -> LineModel:
    """A model from labelled texts; ``label_of_text`` are numbers of LABELS, ``common`` as of ``common_hashes``."""
    k = len(LABELS)
    single = Lines(pa.array(texts, pa.string()), common)
    pairs = mixtures(label_of_text, single.text_chars, longest_mixed)
    mixed = Lines(pa.array([texts[a] + "\n" + texts[b] for a, b in pairs], pa.string()), common)
    # a mixture has the lines of its parts, in order
    first = np.searchsorted(single.text, np.arange(len(texts) + 1))
    source = np.concatenate([np.arange(first[t], first[t + 1]) for pair in pairs for t in pair] or [np.empty(0, np.int64)])
    if len(source) != len(mixed.text):
        raise AssertionError("a mixture has other lines than its parts")
    text, chars = single.text, single.chars
    features = np.concatenate([single.features, mixed.features])
    own = label_of_text[text]
    shift, spread = features.mean(axis=0), features.std(axis=0)
    shift[spread < 1e-6] = 0
    scale = np.where(spread < 1e-6, 1, 1 / np.maximum(spread, 1e-6)).astype(np.float32)
    x = ((features - shift) * scale).astype(np.float32)
    # a long text shall not outweigh the rest
    size = np.bincount(text, chars, len(texts))
    base = chars / np.sqrt(np.maximum(size[text], 1))
    if len(pairs):
        mixed_size = np.array([size[a] + size[b] for a, b in pairs])[mixed.text]
        base = np.append(base, mixed.chars / np.sqrt(np.maximum(mixed_size, 1)) / MIXED)
    allowed = np.full((len(text), k), -1e3)
    allowed[np.arange(len(text)), own] = 0
    allowed[:, 0] = np.maximum(allowed[:, 0], -1.0)
    allowed[own == 0, 1:] = -3.0
    labels, weights = own.copy(), None
    for turn in range(turns):
        every = np.append(labels, labels[source])
        mass = np.maximum(np.bincount(every, base, k), 1e-9)
        weight = base * (1 / np.sqrt(mass / mass.sum()))[every]
        weights = _fit_softmax(x, every, weight, hidden, weights, rounds, 1e-3)
        share = np.bincount(every, weight, k) + 0.01 * weight.sum()
        share /= share.sum()
        same = text[1:] == text[:-1]
        step = np.full((k, k), 1.0) + 20 * np.eye(k)
        np.add.at(step, (labels[:-1][same], labels[1:][same]), 1)
        step /= step.sum(axis=1, keepdims=True)
        start = 2 + np.bincount(labels[np.append(True, ~same)], minlength=k)
        model = LineModel(
            weights, shift, scale, np.log(share), np.log(start / start.sum()), np.log(np.maximum(step, LEAST_STEP))
        )
        emit = model.emissions(single.features)
        labels = _at_least_half(best_paths(emit + allowed, text, model.log_start, model.log_step), emit, text, chars, own)
    return model


def _at_least_half(labels: np.ndarray, emit: np.ndarray, text: np.ndarray, chars: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gives the likeliest lines of a text its label until they hold over half of its characters."""
    gain = emit[np.arange(len(own)), own] - np.where(own == 0, emit[:, 1:].max(axis=1), emit[:, 0])
    order = np.lexsort((-gain, labels != own, text))
    upto = np.cumsum(chars[order])
    first = np.searchsorted(text[order], text[order], "left")
    before = upto - chars[order] - np.append(0, upto)[first]
    total = np.bincount(text, chars)[text[order]]
    out = labels.copy()
    short = order[before <= 0.55 * total]
    out[short] = own[short]
    return out
