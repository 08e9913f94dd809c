"""A small causal self-attention model over subword ids, trained and run in numpy.

One head over windows of ``WINDOW`` ids, a residual, a hidden layer, and the class of the next id; the id is then drawn from
its class given the class of the id before. Classes come from the ids' neighbours.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
"""Ids that a window reads."""

CONTEXT = 8
"""Ids at the start of every window but a text's first that are read as context and scored by the window before."""

SIZE = 16
HIDDEN = 32
CLASSES = 64
STEPS = 700
"""Steps that a model takes on one run of ids, or before it meets the whole corpus."""

BATCH = 128
RATE = 0.01

FAR = 60
"""Exponents up to which no maximum needs to be taken away first: one member of each sum not below ``-FAR`` keeps it above nought."""


COMMON = 512
"""Most frequent ids that count as neighbours of their own; all others are one neighbour."""

SIDES = 2 * (COMMON + 1)
"""Neighbours before and behind an id."""


def neighbour_places(counts: np.ndarray) -> np.ndarray:
    """The place of every id among the neighbours."""
    common = np.argsort(-counts, kind="stable")[:COMMON]
    place = np.full(len(counts), COMMON)
    place[common] = np.arange(len(common))
    return place


def neighbour_keys(before: np.ndarray, behind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``id * SIDES + neighbour`` for both ids of each pair."""
    return np.concatenate([behind * SIDES + place[before], before * SIDES + COMMON + 1 + place[behind]])


def projection(rng: np.random.Generator) -> np.ndarray:
    return rng.normal(size=(SIDES, 48)).astype(np.float32)


def projected(around: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Points of ids from how often each neighbour stands beside them."""
    return np.sqrt(around / np.maximum(1, around.sum(axis=1, keepdims=True))).astype(np.float32) @ by


def grouped_classes(counts: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A class for every id: the most frequent ids are classes of their own, the others are grouped by their points (one per id with a count)."""
    seen = np.flatnonzero(counts)
    common = np.argsort(-counts, kind="stable")[:COMMON]
    alone = CLASSES // 2
    groups = CLASSES - alone
    weight = counts[seen].astype(np.float64)
    rest = np.flatnonzero(~np.isin(seen, common[:alone]))
    out = np.full(len(counts), CLASSES - 1)
    out[common[:alone]] = np.arange(min(alone, len(common[:alone])))
    if len(rest):
        points, weight = around[rest], weight[rest]
        centres = points[np.argsort(-weight, kind="stable")[:groups]].copy()
        for _ in range(12):
            nearest = np.argmin((centres ** 2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)
            for group in range(len(centres)):
                mine = nearest == group
                if mine.any():
                    centres[group] = np.average(points[mine], axis=0, weights=weight[mine])
        out[seen[rest]] = alone + nearest
    return out.astype(np.int16)


def neighbour_classes(ids: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Classes of the ids of one long run."""
    counts = np.bincount(ids, minlength=size)
    seen = np.flatnonzero(counts)
    row = np.full(size, len(seen))
    row[seen] = np.arange(len(seen))
    keys = neighbour_keys(ids[:-1], ids[1:], neighbour_places(counts))
    around = np.zeros((len(seen), SIDES), np.float32)
    np.add.at(around, (row[keys // SIDES], keys % SIDES), 1)
    return grouped_classes(counts, projected(around, projection(rng)))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these many ids to score, each window's text, its first place in the text and its first scored place.

    The first window of a text scores all its places, every other those behind its ``CONTEXT``, so each is scored once.
    """
    step = WINDOW - CONTEXT
    count = np.maximum(1, -(-(lengths - CONTEXT) // step)) * (lengths > 0)
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, number * step, np.where(number > 0, number * step + CONTEXT, 0)


class Model:
    """Weights and tables; ``scores`` gives natural log probabilities of ids given those before them in their windows."""

    def __init__(self, size: int, classes: np.ndarray, inside: np.ndarray, rng: np.random.Generator):
        self.classes, self.inside = classes, inside
        normal = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.weights = {
            "ids": normal(size, SIZE, scale=0.3), "places": normal(WINDOW, SIZE, scale=0.05),
            "q": normal(SIZE, SIZE, scale=SIZE ** -0.5), "k": normal(SIZE, SIZE, scale=SIZE ** -0.5),
            "v": normal(SIZE, SIZE, scale=SIZE ** -0.5), "o": normal(SIZE, SIZE, scale=SIZE ** -0.5),
            "hidden": normal(SIZE, HIDDEN, scale=SIZE ** -0.5), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, CLASSES, scale=HIDDEN ** -0.5), "out_bias": np.zeros(CLASSES, np.float32)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def forward(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for a batch of windows: ids (windows, WINDOW)."""
        w = self.weights
        x = w["ids"][ids] + w["places"]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(SIZE ** -0.5)
        a += self.mask
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        mixed = a @ v
        h = x + mixed @ w["o"]
        u = np.maximum(h @ w["hidden"] + w["hidden_bias"], 0)
        logits = u @ w["out"] + w["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "mixed": mixed, "h": h, "u": u, "logits": logits}

    def gradients(self, ids: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the next ids' classes and its gradient: ``forward`` and back, all places of all windows in one product where they can be."""
        w, shape, flat = self.weights, (*ids.shape, SIZE), target.size
        one, ones, row = np.ones(CLASSES, np.float32), np.ones(flat, np.float32), np.arange(flat)
        scale = np.float32(SIZE ** -0.5)
        into = np.concatenate([w["q"] * scale, w["k"], w["v"]], axis=1)
        x = np.take(w["ids"], ids, axis=0)
        x += w["places"]
        x = x.reshape(-1, SIZE)
        q, k, v = (part.reshape(shape) for part in np.split(x @ into, 3, axis=1))
        a = q @ k.transpose(0, 2, 1)
        self.soften(a)
        mixed = a @ v
        h = mixed.reshape(-1, SIZE) @ w["o"]
        h += x
        u = h @ w["hidden"]
        u += w["hidden_bias"]
        np.maximum(u, 0, out=u)
        p = u @ w["out"]
        p += w["out_bias"]
        if p.max() > FAR or p[:, 0].min() < -FAR:
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        total, wanted = p @ one, target.ravel()
        loss = -np.log(np.maximum(p[row, wanted] / total, 1e-12)).mean()
        p *= (1 / (total * np.float32(flat)))[:, None]
        p[row, wanted] -= np.float32(1 / flat)
        g = {"out": u.T @ p, "out_bias": ones @ p}
        du = p @ w["out"].T
        du *= u > 0
        g |= {"hidden": h.T @ du, "hidden_bias": ones @ du}
        dx = du @ w["hidden"].T
        g["o"] = mixed.reshape(-1, SIZE).T @ dx
        dm = (dx @ w["o"].T).reshape(shape)
        dv = a.transpose(0, 2, 1) @ dm
        da = dm @ v.transpose(0, 2, 1)
        da -= ((dm * mixed).reshape(-1, SIZE) @ one[:SIZE]).reshape(*ids.shape, 1)
        da *= a
        back = np.concatenate([da @ k, da.transpose(0, 2, 1) @ q, dv], axis=2).reshape(-1, 3 * SIZE)
        g["q"], g["k"], g["v"] = np.split(x.T @ back, 3, axis=1)
        g["q"] = g["q"] * scale
        dx += back @ into.T
        g["places"] = dx.reshape(shape).sum(axis=0)
        g["ids"] = (ids.ravel(), dx)
        return float(loss), g

    def soften(self, a: np.ndarray) -> None:
        """Turns products of queries and keys into the shares of the places up to each, in place; the queries may be those of the last places alone."""
        first = WINDOW - a.shape[1]
        if a.max() > FAR or a.min() < -FAR:
            a += self.mask[first:]
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= self.seen[first:]
        total = a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)
        a /= total.reshape(*a.shape[:2], 1)

    def train(self, ids: np.ndarray, steps: int, rng: np.random.Generator) -> None:
        """Adam over random windows of a long run of ids."""
        if len(ids) <= WINDOW:
            return
        adam, places = Adam(self), np.arange(WINDOW + 1)
        for step in range(1, steps + 1):
            at = rng.integers(0, len(ids) - WINDOW, BATCH)[:, None] + places
            adam.step(ids[at], RATE * min(1, step / 50) * (1 - 0.9 * step / steps))

    def scores(self, ids: np.ndarray, target: np.ndarray, first: int = 0) -> np.ndarray:
        """Log probability of the id behind each place from ``first`` on of a batch of windows: ``forward`` with fewer passes over memory.

        The places before ``first`` are looked at by the others, but what comes behind them is not worked out.
        """
        w, shape = self.weights, (*ids.shape, SIZE)
        x = np.take(w["ids"], ids, axis=0)
        x += w["places"]
        into = np.concatenate([w["k"], w["v"]], axis=1)
        k, v = (part.reshape(shape) for part in np.split(x.reshape(-1, SIZE) @ into, 2, axis=1))
        x = np.ascontiguousarray(x[:, first:]).reshape(-1, SIZE)
        ids, target = ids[:, first:], target[:, first:]
        q = (x @ (w["q"] * np.float32(SIZE ** -0.5))).reshape(*ids.shape, SIZE)
        a = q @ k.transpose(0, 2, 1)
        self.soften(a)
        x += (a @ v).reshape(-1, SIZE) @ w["o"]
        u = x @ w["hidden"]
        u += w["hidden_bias"]
        np.maximum(u, 0, out=u)
        logits = u @ w["out"]
        logits += w["out_bias"]
        if logits.max() > FAR or logits[:, 0].min() < -FAR:
            logits -= logits.max(axis=1, keepdims=True)
        wanted = self.classes[target]
        chosen = logits[np.arange(target.size), wanted.ravel()].reshape(target.shape)
        np.exp(logits, out=logits)
        return chosen - np.log(logits @ np.ones(CLASSES, np.float32)).reshape(target.shape) + self.inside[self.classes[ids], target]

    def score(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, batch: int = 256) -> np.ndarray:
        """Log probability of every id to score. Text ``t`` is ``flat[starts[t]:starts[t] + lengths[t] + 1]`` and begins with an id that is not scored."""
        out = np.zeros(int(lengths.sum()), np.float32)
        before = np.cumsum(lengths) - lengths
        text, first, _ = windows(lengths)
        places = np.arange(WINDOW)
        for context, alike in ((0, np.flatnonzero(first == 0)), (CONTEXT, np.flatnonzero(first))):
            for at in range(0, len(alike), batch):
                some = alike[at:at + batch]
                t = text[some]
                place = first[some][:, None] + places
                at_id = starts[t][:, None] + np.minimum(place, lengths[t][:, None] - 1)
                found = self.scores(flat[at_id], flat[at_id + 1], context)
                place = place[:, context:]
                keep = place < lengths[t][:, None]
                out[(before[t][:, None] + place)[keep]] = found[keep]
        return out


class Adam:
    """Steps of a model's weights; ids that a step has not met are left alone."""

    def __init__(self, model: Model):
        self.model, self.steps = model, 0
        self.first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.weights.items()}

    def step(self, windows: np.ndarray, rate: float) -> None:
        """One step over windows of ``WINDOW`` ids and the one behind them."""
        self.steps += 1
        first, second = self.first, self.second
        _, g = self.model.gradients(windows[:, :-1], self.model.classes[windows[:, 1:]].astype(np.int64))
        for name, weight in self.model.weights.items():
            used, total = summed(*g["ids"], len(weight)) if name == "ids" else (slice(None), g[name])
            slow = first[name][used] = 0.9 * first[name][used] + 0.1 * total
            square = second[name][used] = 0.98 * second[name][used] + 0.02 * total * total
            weight[used] -= (rate / (1 - 0.9 ** self.steps)) * slow / (np.sqrt(square / (1 - 0.98 ** self.steps)) + 1e-8)


def summed(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sum of each one's values."""
    order = np.argsort(rows.astype(np.uint16) if size <= 1 << 16 else rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def from_counts(counts: np.ndarray, classes: np.ndarray, pairs: np.ndarray, rng: np.random.Generator) -> Model:
    """A model with the tables of these counts of ids and of ids behind classes; its weights are not trained yet."""
    size = len(counts)
    one = counts + 0.01
    members = np.zeros(CLASSES)
    np.add.at(members, classes, one)
    general = one / members[classes]
    held = np.zeros((CLASSES, CLASSES))
    np.add.at(held.T, classes, pairs.T)
    weight = 8.0
    inside = np.log((pairs + weight * general[None, :]) / (held[:, classes] + weight)).astype(np.float32)
    model = Model(size, classes, inside, rng)
    model.weights["out_bias"][members == 0] = -50  # a class without ids takes no probability
    return model


def fitted(ids: np.ndarray, size: int, steps: int = STEPS, seed: int = 7) -> Model:
    """A model trained on one long run of ids."""
    rng = np.random.default_rng(seed)
    classes = neighbour_classes(ids, size, rng) if len(ids) > 1 else np.zeros(size, np.int16)
    pairs = np.zeros((CLASSES, size), np.float32)
    if len(ids) > 1:
        np.add.at(pairs, (classes[ids[:-1]], ids[1:]), 1)
    model = from_counts(np.bincount(ids, minlength=size), classes, pairs, rng)
    model.train(ids, steps, rng)
    return model
