"""A causal self-attention language model over subword ids, in numpy.

Embeddings feed one attention head with a learnt bias for each distance, and a
hidden layer over the context and the current token.  The next token comes from
a softmax in two steps, both of them given the context: one of ``FAN`` groups,
then one of the group's ``FAN`` classes; the corpus' subword counts give its
share of the class.  The ``SINGLES`` most frequent ids are classes of their own,
the others are clustered by their neighbours, and like classes share a group.

A text is cut into blocks of ``STEP`` queries; each sees its own block up to
itself, and the whole block before.  So the context windows overlap, and each
token is scored once.  Blocks of many texts go through one gather and batched
products under the causal mask together.

A query meets a key, and a value the hidden layer, through products of two small
matrices that are multiplied once a step (``merged``), so tokens go by their
embeddings alone.  Training and scoring share this pass (``hidden``), in
runs of ``TOGETHER`` windows whose arrays stay in a core's cache and are used again.

Training goes through all windows of all texts it is given, and takes the loss at
every position of a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import prod

import numpy as np

BEGIN, END = 1, 2
DIM, HIDDEN, STEP, FAN = 16, 32, 16, 32
SINGLES, NEAR = 512, 32
N_CLASSES = FAN * FAN
BATCH, RATE, EMBED_RATE, SEED = 256, 1e-2, 0.1, 5
SPAN = 2 * STEP
TOGETHER = 256  # windows that are trained on or scored in one go
_i, _j = np.arange(STEP)[:, None], np.arange(STEP)[None, :]
#: Distances from query i to key j of the own block, and of the block before; which keys of the own block a query sees.
OWN, BEFORE, SEEN = np.maximum(_i - _j, 0), _i + STEP - _j, _j <= _i


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, targets, first) of texts' ids, in blocks of STEP: begin and text, text and end (-1 behind it); which blocks start a text."""
    n = np.array([-(-(len(ids) + 1) // STEP) for ids in texts], np.int64)
    at = STEP * (np.cumsum(n) - n)
    tokens, targets = np.zeros(STEP * int(n.sum()), np.int64), np.full(STEP * int(n.sum()), -1, np.int64)
    tokens[at] = BEGIN
    for a, ids in zip(at.tolist(), texts):
        tokens[a + 1 : a + 1 + len(ids)] = ids
        targets[a : a + len(ids)] = ids
        targets[a + len(ids)] = END
    first = np.zeros(int(n.sum()), bool)
    first[at // STEP] = True
    return tokens.reshape(-1, STEP), targets.reshape(-1, STEP), first


def columns(counts: np.ndarray) -> np.ndarray:
    """Where each id counts as a neighbour: ids seen most alone, all others together."""
    order = np.argsort(-counts, kind="stable")
    top = order[:NEAR][counts[order[:NEAR]] > 0]
    column = np.full(len(counts), NEAR, np.int64)
    column[top] = np.arange(len(top))
    return column


def neighbours(texts: Iterable[np.ndarray], column: np.ndarray) -> np.ndarray:
    """(id, 2 (NEAR + 1)): how often each column stands before and behind an id in these texts."""
    wide = 2 * (NEAR + 1)
    near = np.zeros(len(column) * wide, np.int64)
    for part in batched(texts):
        ids = np.concatenate(part)
        inner = np.ones(len(ids), bool)  # false where a text ends
        inner[np.cumsum(np.array([len(x) for x in part if len(x)], np.int64)) - 1] = False
        left, right = ids[:-1][inner[:-1]], ids[1:][inner[:-1]]
        near += np.bincount(right * wide + column[left], minlength=len(near))
        near += np.bincount(left * wide + NEAR + 1 + column[right], minlength=len(near))
    return near.reshape(len(column), wide)


def batched(texts: Iterable[np.ndarray], most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The texts in lists of about this many ids; none of them is empty."""
    part, n = [], 0
    for ids in texts:
        part.append(ids)
        n += len(ids) + 1
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def classes(near: np.ndarray, counts: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The class of each id, group * FAN + place: frequent ids (and the end) alone, others that have neighbours clustered by them, the rest together."""
    near, size = near.astype(np.float32), len(counts)
    order = np.argsort(-counts, kind="stable")
    alone = np.concatenate([[END], order[(order != END) & (counts[order] > 0)]])[:SINGLES]
    leaf = np.full(size, N_CLASSES - 1, np.int64)
    leaf[alone] = np.arange(len(alone))
    total = near.sum(axis=1, keepdims=True)
    x = np.sqrt(near / np.maximum(total, 1))
    others = np.flatnonzero((total[:, 0] > 0) & (leaf == N_CLASSES - 1))
    if len(others):
        weight = np.sqrt(counts[others] + 1.0)
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(others, min(N_CLASSES - 1 - SINGLES, len(others)), replace=False, p=weight / weight.sum())]
        for _ in range(6):
            own = (x[others] @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
            mass = np.bincount(own, weights=weight, minlength=len(centres))
            sums = np.stack([np.bincount(own, weights=weight * x[others, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
            centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres).astype(np.float32)
        leaf[others] = SINGLES + own
    # Like classes share a group: median splits of the classes' mean neighbours.
    mean = np.stack([np.bincount(leaf, weights=x[:, d] * (counts + 0.5), minlength=N_CLASSES) for d in range(x.shape[1])], axis=1)
    mean /= np.bincount(leaf, weights=counts + 0.5, minlength=N_CLASSES)[:, None] + 1e-9
    parts = [np.arange(N_CLASSES)]
    while len(parts) < FAN:
        parts = [half for p in parts for half in np.split(p[np.argsort(mean[p, mean[p].var(axis=0).argmax()], kind="stable")], 2)]
    place = np.empty(N_CLASSES, np.int64)
    place[np.concatenate(parts)] = np.arange(N_CLASSES)
    return place[leaf]


def initial(counts: np.ndarray, class_of: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """The weights before any training: the softmax starts from the classes' shares."""
    rng = np.random.default_rng(seed)
    share = np.bincount(class_of, weights=counts + 0.5, minlength=N_CLASSES).reshape(FAN, FAN) + 1e-3

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    group, place = normal(HIDDEN + 1, FAN, scale=0.1), normal(FAN, HIDDEN + 1, FAN, scale=0.1)
    group[-1] = np.log(share.sum(axis=1) / share.sum())
    place[:, -1] = np.log(share / share.sum(axis=1, keepdims=True))
    return {
        "e": normal(len(counts), DIM, scale=0.3),
        "q": normal(DIM, DIM, scale=0.2),
        "k": normal(DIM, DIM, scale=0.2),
        "v": normal(DIM, DIM, scale=0.3),
        "d": np.zeros(SPAN, np.float32),
        "c": normal(DIM, HIDDEN, scale=0.2),
        "s": normal(DIM, HIDDEN, scale=0.2),
        "b": np.zeros(HIDDEN, np.float32),
        "group": group,
        "place": place,
    }


def _by_group(group: np.ndarray):
    """The order of tokens by group, and (group, start, end) of each run in it."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=FAN)).tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


class Room(dict):
    """Arrays by name that are used again: fresh ones cost more than much of what is computed in them."""

    def __call__(self, name: str, dtype, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self or self[name].size < size or self[name].dtype != dtype:
            self[name] = np.empty(size, dtype)
        return self[name][:size].reshape(shape)


def merged(w: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the weights make together: query to key; context, token and a one to the hidden layer and its one; bias of each query and key; group and place."""
    scale = np.float32(1 / np.sqrt(DIM))
    wide = np.zeros((2 * DIM + 1, HIDDEN + 1), w["e"].dtype)
    wide[:DIM, :HIDDEN], wide[DIM : 2 * DIM, :HIDDEN], wide[2 * DIM, :HIDDEN], wide[2 * DIM, HIDDEN] = w["v"] @ w["c"], w["s"], w["b"], 1
    bias = np.concatenate([w["d"][BEFORE], np.where(SEEN, w["d"][OWN], np.asarray(-1e9, w["d"].dtype))], axis=1)
    return w["q"] @ w["k"].T * scale, wide, bias, np.concatenate([np.broadcast_to(w["group"], w["place"].shape), w["place"]], axis=2)


def _exp(x: np.ndarray, most: float) -> np.ndarray:
    """In place; scores are small, so no shift is needed to keep the sums finite."""
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)
    return np.exp(x, out=x)


def hidden(e: np.ndarray, alone: np.ndarray, m: np.ndarray, wide: np.ndarray, bias: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
    """The hidden layer, with a one behind, of the windows behind the first of ``e`` (windows, STEP, DIM); then what its slopes need.

    Those that are ``alone`` do not see the window before.
    """
    n, kind = len(e) - 1, e.dtype
    keys = np.ndarray((n, SPAN, DIM), kind, e, strides=e.strides)  # overlapping: a window and the one before
    turned = room("turned", kind, n, DIM, SPAN)
    turned[:] = keys.transpose(0, 2, 1)
    query = np.matmul(e[1:].reshape(-1, DIM), m, out=room("query", kind, n * STEP, DIM)).reshape(n, STEP, DIM)
    a = np.matmul(query, turned, out=room("a", kind, n, STEP, SPAN))
    a += bias
    _exp(a, 60)
    a[alone, :, :STEP] = 0
    flat = a.reshape(-1, SPAN)
    flat *= (1 / (flat @ np.ones(SPAN, kind)))[:, None]
    x = room("x", kind, n, STEP, 2 * DIM + 1)
    np.matmul(a, keys, out=x[:, :, :DIM])
    x[:, :, DIM : 2 * DIM] = e[1:]
    x[:, :, 2 * DIM] = 1
    x = x.reshape(-1, 2 * DIM + 1)
    h = np.matmul(x, wide, out=room("h", kind, n * STEP, HIDDEN + 1))
    return np.maximum(h, 0, out=h), x, a, query, keys, turned


def logits(h: np.ndarray, targets: np.ndarray, class_of: np.ndarray, both: np.ndarray, room: Room):
    """(L, 2 FAN) of group and place of the L targets there are, by group; their rows of ``h`` and places in it, their classes, the runs of a group."""
    goal = targets.ravel()
    live = np.flatnonzero(goal >= 0)
    code = class_of.take(goal[live])
    order, runs = _by_group(code // FAN)
    live, code = live[order], code[order]
    hl = np.take(h, live, axis=0, out=room("hl", h.dtype, len(live), HIDDEN + 1), mode="clip")
    y = room("y", h.dtype, len(live), 2 * FAN)
    for g, i, j in runs:
        np.matmul(hl[i:j], both[g], out=y[i:j])
    return y, hl, live, code, runs


def _chosen(code: np.ndarray) -> np.ndarray:
    """Where each row of logits has its class' group, then its place."""
    at = np.arange(0, len(code) * 2 * FAN, 2 * FAN)
    return np.concatenate([at + code // FAN, at + (FAN + code % FAN)])


@dataclass
class Scorer:
    """A trained model."""

    w: dict[str, np.ndarray]
    class_of: np.ndarray
    log_share: np.ndarray  # log10 of each id's share of its class

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's ids and its end."""
        tokens, targets, first = windows(texts)
        text = np.cumsum(first) - 1
        out, room, made = np.zeros(len(texts)), Room(), merged(self.w)
        for at in range(0, len(tokens), TOGETHER):
            to = min(at + TOGETHER, len(tokens))
            found, live = self._log10(tokens, targets[at:to], first[at:to], at, made, room)
            low, of = text[at], np.repeat(text[at:to], STEP)[live]
            out[low : text[to - 1] + 1] += np.bincount(of - low, weights=found, minlength=text[to - 1] + 1 - low)
        return out

    def _log10(self, tokens: np.ndarray, targets: np.ndarray, first: np.ndarray, at: int, made: tuple, room: Room) -> tuple[np.ndarray, np.ndarray]:
        """Of the targets of the windows from ``at`` on, and where each is."""
        *made, both = made
        e = self.w["e"].take(tokens[np.maximum(np.arange(at - 1, at + len(first)), 0)], axis=0)  # the window before is needed for its keys
        h, *_ = hidden(e, first, *made, room)
        y, _, live, code, _ = logits(h, targets, self.class_of, both, room)
        chosen, y = _chosen(code), np.minimum(y, 80, out=y) if y.size and y.max() > 80 else y
        found = y.ravel()[chosen].reshape(2, -1).sum(axis=0)
        found -= np.log(np.exp(y, out=y).reshape(-1, FAN) @ np.ones(FAN, y.dtype)).reshape(-1, 2).sum(axis=1)
        return found / np.log(10) + self.log_share.take(targets.ravel()[live]), live

    @cached_property
    def table(self) -> np.ndarray:
        """(id, 3 DIM + 1 + HIDDEN): each id's query, key, value and a one, own part of the hidden layer."""
        e, scale = self.w["e"], np.float32(1 / np.sqrt(DIM))
        return np.concatenate([e @ self.w["q"] * scale, e @ self.w["k"], e @ self.w["v"], np.ones((len(e), 1), np.float32), e @ self.w["s"] + self.w["b"]], axis=1)

    @cached_property
    def own(self) -> np.ndarray:
        """Bias of each query and key of the block, -inf where masked."""
        return np.where(SEEN, self.w["d"][OWN], -np.inf).astype(np.float32)

    @cached_property
    def before(self) -> np.ndarray:
        """The same for keys of the block before."""
        return self.w["d"][BEFORE]

    context = property(lambda self: self.w["c"])
    group = property(lambda self: self.w["group"])
    place = property(lambda self: self.w["place"])


def scorer(w: dict[str, np.ndarray], class_of: np.ndarray, counts: np.ndarray) -> Scorer:
    smooth = counts + 0.5
    return Scorer({n: x.copy() for n, x in w.items()}, class_of, np.log10(smooth / np.bincount(class_of, weights=smooth, minlength=N_CLASSES)[class_of]))


class Trainer:
    """Goes through windows in batches and moves weights in place: Adam, and Adagrad by row for the embeddings.

    The arrays in ``w``, but e, become parts of one vector.
    """

    def __init__(self, w: dict[str, np.ndarray], class_of: np.ndarray):
        self.w, self.class_of, self.done = w, class_of, 0
        self.rest = [n for n in w if n != "e"]
        self.all, at = np.concatenate([w[n].ravel() for n in self.rest]), 0
        for n in self.rest:
            w[n], at = self.all[at : at + w[n].size].reshape(w[n].shape), at + w[n].size
        self.first, self.second = np.zeros_like(self.all), np.zeros_like(self.all)
        self.seen, self.room = np.full(len(w["e"]), 1e-8, np.float32), Room()

    def go(self, tokens: np.ndarray, targets: np.ndarray, first: np.ndarray, rng: np.random.Generator, rate_of) -> None:
        """Once through these windows, runs of neighbouring ones in random order; ``rate_of`` gives a step's share of the rate by its number."""
        for at in (rng.permutation(-(-len(tokens) // BATCH)) * BATCH).tolist():
            g, ids, ge = gradients(self.w, tokens[at : at + BATCH], targets[at : at + BATCH], first[at : at + BATCH], self.class_of, self.room)
            self.done += 1
            rate = rate_of(self.done)
            self.move(np.concatenate([g[n].ravel() for n in self.rest]), rate)
            self.seen[ids] += np.einsum("ij,ij->i", ge, ge) / DIM
            ge *= (EMBED_RATE * rate / np.sqrt(self.seen[ids]))[:, None]
            self.w["e"][ids] -= ge

    def move(self, g: np.ndarray, rate: float) -> None:
        """A step of Adam; ``g`` is used up."""
        by = g - self.first
        by *= 0.1
        self.first += by
        g *= g
        g -= self.second
        g *= 0.01
        self.second += g
        np.sqrt(self.second, out=g)
        g += 1e-8 * np.sqrt(1 - 0.99**self.done)
        np.divide(self.first, g, out=by)
        by *= RATE * rate * np.sqrt(1 - 0.99**self.done) / (1 - 0.9**self.done)
        self.all -= by


def fit(texts: list[np.ndarray], counts: np.ndarray, passes: int = 1, seed: int = SEED) -> Scorer:
    """Trains on texts given as ids, in one place; ``counts`` are the corpus' numbers of each id."""
    class_of = classes(neighbours(texts, columns(counts)), counts, seed)
    w, rng = initial(counts, class_of, seed), np.random.default_rng(seed)
    if texts:
        data = windows(texts)
        steps, trainer = passes * -(-len(data[0]) // BATCH), Trainer(w, class_of)
        for _ in range(passes):
            trainer.go(*data, rng, lambda done: 1 - 0.9 * done / steps)
    return scorer(w, class_of, counts)


def gradients(w: dict, tokens: np.ndarray, targets: np.ndarray, first: np.ndarray, class_of: np.ndarray, room: Room | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
    """The gradient of the mean cross-entropy at all positions of neighbouring windows: of all weights but e, then (ids, rows) of e.

    A window whose predecessor is not in the batch attends to its own block.
    """
    room, n, kind = Room() if room is None else room, len(tokens), w["e"].dtype
    m, wide, bias, both = merged(w)
    turned_both, turned_wide, turned_m = (np.ascontiguousarray(np.swapaxes(x, -1, -2)) for x in (both[:, :HIDDEN], wide[: 2 * DIM, :HIDDEN], m))
    share = np.asarray(1 / max(1, np.count_nonzero(targets >= 0)), kind)
    alone = first.copy()
    alone[0] = True
    e, de = room("e", kind, n + 1, STEP, DIM), room("de", kind, n + 1, STEP, DIM)
    e[0], de[:] = 0, 0  # in front of the first window
    np.take(w["e"], tokens, axis=0, out=e[1:], mode="clip")
    g_m, g_wide, g_bias, g_both = (np.zeros_like(x) for x in (m, wide[:, :HIDDEN], bias, both))
    for at in range(0, n, TOGETHER):
        to = min(at + TOGETHER, n)
        h, x, a, query, keys, turned = hidden(e[at : to + 1], alone[at:to], m, wide, bias, room)
        p, hl, live, code, runs = logits(h, targets[at:to], class_of, both, room)
        _exp(p, 60)
        flat = p.reshape(-1, FAN)
        flat *= (share / (flat @ np.ones(FAN, kind)))[:, None]
        p.reshape(-1)[_chosen(code)] -= share
        dl, part = room("dl", kind, len(hl) + 1, HIDDEN), room("part", kind, *both.shape)
        dl[-1], part[:] = 0, 0  # for positions without a target, and groups without one
        for g, i, j in runs:
            np.matmul(hl[i:j].T, p[i:j], out=part[g])
            np.matmul(p[i:j], turned_both[g], out=dl[i:j])
        g_both += part
        dl[:-1] *= hl[:, :HIDDEN] > 0
        row = np.full(len(h), len(live))
        row[live] = np.arange(len(live))
        dz = np.take(dl, row, axis=0, out=room("dz", kind, len(h), HIDDEN), mode="clip")
        g_wide += x.T @ dz
        dx = np.matmul(dz, turned_wide[:, :DIM], out=room("dx", kind, len(dz), DIM))
        # The mean slope of the keys, as a weighs them, is that of the context with its own.
        mean = np.einsum("ij,ij->i", dx, x[:, :DIM])
        dx = dx.reshape(query.shape)
        ds = np.matmul(dx, turned, out=room("ds", kind, *a.shape))
        ds -= mean.reshape(len(a), STEP, 1)
        ds *= a
        g_bias += (np.ones(len(ds), kind) @ ds.reshape(len(ds), -1)).reshape(bias.shape)
        dq = np.matmul(ds, keys, out=room("dq", kind, *query.shape)).reshape(-1, DIM)
        g_m += e[at + 1 : to + 1].reshape(-1, DIM).T @ dq
        dk = np.matmul(ds.transpose(0, 2, 1), query, out=room("dk", kind, len(a), SPAN, DIM))
        dk += np.matmul(a.transpose(0, 2, 1), dx, out=room("dv", kind, len(a), SPAN, DIM))
        own = de[at + 1 : to + 1]
        own += dk[:, STEP:]
        own += (dq @ turned_m).reshape(own.shape)
        own += (dz @ turned_wide[:, DIM:]).reshape(own.shape)
        de[at:to] += dk[:, :STEP]

    g_m *= np.float32(1 / np.sqrt(DIM))
    into = g_wide[:DIM]
    g = {"q": g_m @ w["k"], "k": g_m.T @ w["q"], "v": into @ w["c"].T, "c": w["v"].T @ into, "s": g_wide[DIM : 2 * DIM], "b": g_wide[2 * DIM]}
    g["d"] = np.bincount(np.concatenate([BEFORE, OWN], axis=1).ravel(), weights=g_bias.ravel(), minlength=SPAN).astype(kind)
    g["group"], g["place"] = g_both[:, :, :FAN].sum(axis=0), g_both[:, :, FAN:]
    order = np.argsort(tokens.ravel().astype(np.uint16), kind="stable")
    ids = tokens.ravel()[order]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return g, ids[start], np.add.reduceat(de[1:].reshape(-1, DIM).take(order, axis=0), start, axis=0)
