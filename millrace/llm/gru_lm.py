"""A gated recurrent language model with class-factored output, in numpy.

The frequent words stand in classes of neighbouring ranks, cut so that a class's share of the tokens
times its number of words stays at 1: frequent words meet small classes. Other words fall into classes
by their shape. Classes stand in groups that are cut by the same rule. The output is P(group | state)
times P(class | group, state), and times P(word | class, state) for frequent words; the share of a word
within a shape class is its corpus count, which the model does not see. Weights are fitted by truncated
backpropagation through windows of ``WINDOW`` tokens; the state goes on from window to window, so a
document is scored as one sequence.

States are rows, logits columns: a token's state is gathered in one piece, and softmaxes add up rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

STATE, EMBED = 32, 24
# Word logits a token that a class may add; class logits are few, as classes stand in groups.
CLASS_COST = 0.5
WINDOW = 32
# Steps of a window in which documents are only scored.
SCORE_WINDOW = 128
SCORE_LANES = 512
# Tokens whose logits are handled at once.
BLOCK = 1024
NAMES = ("embed", "wx", "wh", "b", "wg", "bg", "wc", "bc", "uw", "bw")
# Weights and biases of the logits: of groups, of classes in a group, of words in a class.
LEVELS = (("wg", "bg"), ("wc", "bc"), ("uw", "bw"))


def class_cuts(word_counts: np.ndarray, most: float = 1) -> np.ndarray:
    """Starts of the classes of words in this order, and their end: share times words is at most ``most``, or one word."""
    share = np.concatenate(([0.0], np.cumsum(word_counts + 0.5, dtype=np.float64)))
    share /= max(share[-1], 1.0)
    cuts, words = [0], len(word_counts)
    while cuts[-1] < words:
        low, high = cuts[-1] + 1, words  # the product grows with the end: halve
        while low < high:
            middle = (low + high + 1) // 2
            if (share[middle] - share[cuts[-1]]) * (middle - cuts[-1]) <= most:
                low = middle
            else:
                high = middle - 1
        cuts.append(low)
    return np.array(cuts, np.int64)


@dataclass
class Layout:
    """Numbers of frequent words and of shape classes; the first word is the end. Counts cut words into classes, classes into groups."""

    words: int
    shapes: int
    word_counts: np.ndarray | None = None
    shape_counts: np.ndarray | None = None
    cuts: np.ndarray = field(init=False)
    group_cuts: np.ndarray = field(init=False)

    def __post_init__(self):
        counts = np.ones(self.words) if self.word_counts is None else self.word_counts
        self.cuts = class_cuts(counts, CLASS_COST)
        sizes = np.diff(self.cuts)
        rest = np.arange(self.shapes) + self.word_classes
        self._class = np.concatenate((np.repeat(np.arange(self.word_classes), sizes), rest)).astype(np.uint16)
        of_words = np.add.reduceat(counts, self.cuts[:-1]) if self.words else np.zeros(0)
        self.group_cuts = class_cuts(np.concatenate((of_words, np.ones(self.shapes) if self.shape_counts is None else self.shape_counts)))

    @property
    def word_classes(self) -> int:
        return len(self.cuts) - 1

    @property
    def shapes_of(self) -> dict[str, tuple[int, ...]]:
        g, k = len(self.group_cuts) - 1, self.word_classes + self.shapes
        return {
            "embed": (self.words + self.shapes, EMBED), "wx": (EMBED, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,),
            "wg": (g, STATE), "bg": (g,), "wc": (k, STATE), "bc": (k,), "uw": (self.words, STATE), "bw": (self.words,),
        }

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return self._class[tokens]


def flatten(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in NAMES]).astype(np.float32)


def unflatten(flat: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in NAMES:
        shape = layout.shapes_of[name]
        size = int(np.prod(shape))
        out[name] = np.array(flat[at : at + size], np.float32).reshape(shape)
        at += size
    return out


def start_weights(layout: Layout, class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the biases are the corpus shares, so an untrained model is a unigram one."""
    rng = np.random.default_rng(seed)
    out = {n: (rng.standard_normal(s) * 0.7 / np.sqrt(s[0])).astype(np.float32) for n, s in layout.shapes_of.items()}
    out["embed"] = (rng.standard_normal(layout.shapes_of["embed"]) * 0.3).astype(np.float32)
    for name, _ in LEVELS:
        out[name] = (rng.standard_normal(layout.shapes_of[name]) * 0.14 / np.sqrt(STATE)).astype(np.float32)
    out["b"][:] = 0
    out["bg"] = np.log(np.add.reduceat(class_counts + 0.5, layout.group_cuts[:-1])).astype(np.float32)
    out["bc"] = np.log(class_counts + 0.5).astype(np.float32)
    out["bw"] = np.log(word_counts + 0.5).astype(np.float32)
    return out


class Rooms:
    """Arrays by name that windows share: memory that is mapped anew costs more than what is written there."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of -x, in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_gate(matrix: np.ndarray) -> np.ndarray:
    """Columns of z, r and the new value as three matrices."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), 3, STATE).transpose(1, 0, 2))


def _negated(by_gate: np.ndarray) -> np.ndarray:
    """z and r with the other sign, in place."""
    np.negative(by_gate[:2], out=by_gate[:2])
    return by_gate


def _gate(wh: np.ndarray, x: np.ndarray, h: np.ndarray, out: tuple[np.ndarray, ...]) -> np.ndarray:
    """One token of every lane; lanes are rows, ``wh`` and ``x`` by gate, those of z and r negated. Fills (z and r, the state's part of the new value, new value, state)."""
    zr, part, new, state = out
    gates = np.matmul(h, wh)
    _sigmoid(np.add(x[:2], gates[:2], out=zr))
    part[:] = gates[2]
    np.multiply(zr[1], part, out=new)
    new += x[2]
    np.tanh(new, out=new)
    np.subtract(h, new, out=state)
    state *= zr[0]
    state += new
    return state


def _inputs(w, rows: np.ndarray) -> np.ndarray:
    """The gates' part of embeddings, by gate, as ``_gate`` takes it."""
    out = np.matmul(rows, _negated(_by_gate(w["wx"])))
    out += _negated(w["b"].reshape(3, 1, STATE).copy())
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order; keys of 16 bits are sorted by their digits."""
    return np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")


def _with_bias(w) -> list[np.ndarray]:
    """Weights of each level's logits with the bias as their last column."""
    return [np.column_stack((w[u], w[b])) for u, b in LEVELS]


def _softmax(u: np.ndarray, states: np.ndarray, chosen: np.ndarray, careful: bool) -> tuple[np.ndarray, ...]:
    """Exponentials of logits, a column a state; each column's sum and the logit of its chosen row. Careful: of logits less the column's largest."""
    x = u @ states.T
    if careful:
        x -= x.max(axis=0)
    logits = x.reshape(-1)[chosen]
    np.exp(x, out=x)
    return x, np.ones(len(x), x.dtype) @ x, logits


def _plain(totals: np.ndarray) -> bool:
    """Whether all sums of exponentials are far from the ends of single precision."""
    return bool(totals.min(initial=1) > 1e-30 and totals.max(initial=1) < 1e30)


def by_classes(layout: Layout, targets: np.ndarray):
    """The order of targets by class, targets and classes in it, and where each class starts there."""
    classes = layout.class_of(targets)
    order = np.argsort(classes, kind="stable")
    classes = classes[order]
    return order, targets[order], classes, np.searchsorted(classes, np.arange(layout.word_classes + layout.shapes + 1))


def stretches(layout: Layout, wanted: np.ndarray, classes: np.ndarray, ends: np.ndarray):
    """(level, rows of its weights, stretch of tokens, place of each token's logit) of every softmax; tokens are in order of class."""
    groups = np.searchsorted(layout.group_cuts, classes, "right") - 1
    parts = [(0, 0, len(layout.group_cuts) - 1, 0, len(classes))]
    parts += [(1, a, b, ends[a], ends[b]) for a, b in zip(layout.group_cuts[:-1], layout.group_cuts[1:])]
    parts += [(2, a, b, *ends[c : c + 2]) for c, (a, b) in enumerate(zip(layout.cuts[:-1], layout.cuts[1:]))]
    columns = np.arange(min(BLOCK, len(classes)))
    numbers = groups, classes.astype(np.int64), wanted
    for level, low, high, start, stop in parts:
        if high - low > 1:  # a single row is certain
            rows = numbers[level]
            for at in range(start, stop, BLOCK):
                own = slice(at, min(at + BLOCK, stop))
                yield level, slice(low, high), own, (rows[own] - low) * (own.stop - at) + columns[: own.stop - at]


def log_probabilities(levels: list[np.ndarray], layout: Layout, states: np.ndarray, targets: np.ndarray, room: Rooms, careful: bool = False) -> np.ndarray:
    """Of each target after its state, whose last column is 1."""
    order, wanted, classes, ends = by_classes(layout, targets)
    by_class = np.take(states, order, axis=0, out=room("by_class", *states.shape), mode="clip")
    totals, logits = room("totals", len(LEVELS), len(order)), room("logits", len(LEVELS), len(order))
    totals.fill(1)
    logits.fill(0)
    with np.errstate(all="ignore"):
        for level, rows, own, cells in stretches(layout, wanted, classes, ends):
            _, totals[level, own], logits[level, own] = _softmax(levels[level][rows], by_class[own], cells, careful)
    if not careful and not _plain(totals):
        return log_probabilities(levels, layout, states, targets, room, careful=True)
    out = np.empty(len(order))
    out[order] = (logits - np.log(totals)).sum(axis=0, dtype=np.float64)
    return out


def _lanes(lengths: np.ndarray) -> list[list[int]]:
    """Documents dealt to lanes of about the same number of tokens, the longest lane first."""
    lanes = [(0, k, []) for k in range(min(SCORE_LANES, len(lengths)))]
    for i in np.argsort(-lengths, kind="stable"):
        tokens, k, held = heapq.heappop(lanes)
        held.append(int(i))
        heapq.heappush(lanes, (tokens + int(lengths[i]), k, held))
    return [held for _, _, held in sorted(lanes, key=lambda lane: (-lane[0], lane[1]))]


def score_documents(w, layout: Layout, documents: list[np.ndarray]) -> np.ndarray:
    """log10-probability of each token sequence, its end included; shapes count as classes only.

    Lanes of documents laid end to end run side by side, window by window; each document keeps its state
    from its first token to its last.
    """
    lengths = np.array([len(d) for d in documents], np.int64)
    if not lengths.sum():
        return np.zeros(len(documents))
    lanes = _lanes(lengths)
    order = np.array([i for held in lanes for i in held])
    stream, ends = np.concatenate([documents[i] for i in order]), np.cumsum(lengths[order])
    fresh = np.zeros(len(stream) + 1, bool)
    fresh[ends - lengths[order]] = True
    fresh = fresh[:-1]
    inputs = np.where(fresh, 0, np.concatenate(([0], stream[:-1])))
    sizes = np.array([lengths[held].sum() for held in lanes])
    begin = np.cumsum(sizes) - sizes
    kind, d, wh, levels = w["wh"].dtype, STATE, _negated(_by_gate(w["wh"])), _with_bias(w)
    table, logs, room = _inputs(w, w["embed"]), np.empty(len(stream)), Rooms(w["wh"].dtype)
    h = np.zeros((len(lanes), d), kind)
    for start in range(0, int(sizes[0]), SCORE_WINDOW):
        counts = np.searchsorted(-sizes, -(start + np.arange(min(SCORE_WINDOW, int(sizes[0]) - start))))
        at = np.concatenate([begin[:n] + (start + t) for t, n in enumerate(counts)])
        px = np.take(table, inputs[at], axis=1, out=room("px", 3, len(at), d), mode="clip")
        begins = np.flatnonzero(fresh[at])
        states = room("states", len(at), d + 1)
        states[:, d] = 1
        stop, many = 0, len(lanes)
        # states of a step and of the one before it take turns
        zr, part, new, turns = room("zr", 2 * many * d), room("part", many, d), room("new", many, d), room("turns", 2, many, d)
        for t, n in enumerate(counts):
            own = slice(stop, stop := stop + int(n))
            h = h[:n]
            h[begins[slice(*np.searchsorted(begins, (own.start, stop)))] - own.start] = 0
            h = _gate(wh, px[:, own], h, (zr[: 2 * n * d].reshape(2, n, d), part[:n], new[:n], turns[t % 2, :n]))
            states[own, :d] = h
        h = h.copy()
        logs[at] = log_probabilities(levels, layout, states, stream[at], room)
    out = np.zeros(len(documents))
    out[order] = np.bincount(np.repeat(np.arange(len(order)), lengths[order]), logs, minlength=len(order))
    return out / np.log(10)


class Trainer:
    """Adam over windows of documents laid end to end in lanes; ``weights`` change in place."""

    def __init__(self, weights: dict[str, np.ndarray], layout: Layout, rate: float = 0.004):
        self.w, self.layout, self.rate, self.step = weights, layout, rate, 0
        self.first = {n: np.zeros_like(v) for n, v in weights.items()}
        self.second = {n: np.zeros_like(v) for n, v in weights.items()}
        self.room = Rooms(weights["wh"].dtype)

    def fit(self, documents: list[np.ndarray], lanes: int = 96, passes: int = 1) -> int:
        """Train on whole documents; returns the number of tokens seen. States start anew with each."""
        seen = 0
        if not sum(map(len, documents)):
            return 0
        stream = np.concatenate(documents)
        fresh = np.zeros(len(stream), bool)
        fresh[np.cumsum([0, *map(len, documents)])[:-1][[len(d) > 0 for d in documents]]] = True
        lanes = max(1, min(lanes, len(stream) // WINDOW))
        length = -(-len(stream) // lanes)
        pad = lanes * length - len(stream)
        stream = np.concatenate((stream, np.zeros(pad, stream.dtype))).reshape(lanes, length)
        real = np.concatenate((np.ones(lanes * length - pad, bool), np.zeros(pad, bool))).reshape(lanes, length)
        fresh = np.concatenate((fresh, np.zeros(pad, bool))).reshape(lanes, length)
        fresh[:, 0] = True
        total = passes * -(-length // WINDOW)
        done = 0
        for _ in range(passes):
            h, last = np.zeros((lanes, STATE), np.float32), np.zeros(lanes, np.int64)
            for at in range(0, length, WINDOW):
                cut = slice(at, at + WINDOW)
                h, last = self._window(h, last, stream[:, cut].T, fresh[:, cut].T, real[:, cut].T, 1 - 0.9 * done / total)
                done += 1
                seen += int(real[:, cut].sum())
        return seen

    def _window(self, h, last, tokens, fresh, real, share):
        w, d, n = self.w, STATE, tokens.shape[1]
        steps = len(tokens)
        inputs = np.where(fresh, 0, np.concatenate((last[None], tokens[:-1]))).ravel()
        at = _order(inputs)
        first = np.diff(inputs[at], prepend=-1) > 0
        words, place = inputs[at[first]], np.empty(len(at), np.int64)
        place[at] = np.cumsum(first) - 1
        rows = w["embed"][words]
        kind, wh, room = rows.dtype, _by_gate(w["wh"]), self.room
        px = np.take(_inputs(w, rows), place, axis=1, out=room("px", 3, len(place), d), mode="clip").reshape(3, steps, n, d)
        x = np.take(rows, place, axis=0, out=room("x", len(place), EMBED), mode="clip").reshape(steps, n, EMBED)
        zr = room("zr", 2, steps, n, d)
        prior, hc, new, states = (room(name, steps, n, d) for name in ("prior", "hc", "new", "states"))
        starts, negated = [np.flatnonzero(row) for row in fresh], _negated(wh.copy())
        for t in range(steps):
            prior[t] = h
            prior[t, starts[t]] = 0
            h = _gate(negated, px[:, t], prior[t], (zr[:, t], hc[t], new[t], states[t]))
        h = h.copy()
        g, met, ds = self._outputs(states.reshape(-1, d), tokens.ravel(), real.ravel())
        ds = ds.reshape(steps, n, d)
        z, r = zr
        # by the state's part of the new value, z, r, the new value
        dgates, back = room("dgates", 4, n, d), np.ascontiguousarray(wh[[2, 0, 1]].transpose(0, 2, 1))
        to_x, ones, dx = np.ascontiguousarray(_by_gate(w["wx"]).transpose(0, 2, 1)), np.ones(n, kind), room("dx", steps, n, EMBED)
        dh, dwh, dwx, db = np.zeros((n, d), kind), np.zeros((3, d, d), kind), np.zeros((3, EMBED, d), kind), np.zeros((3, d), kind)
        down, dz, dr, dnew = dgates
        for t in range(steps - 1, -1, -1):
            dh += ds[t]
            by_z = np.subtract(1, z[t])
            np.square(new[t], out=dnew)
            np.subtract(1, dnew, out=dnew)
            dnew *= dh
            dnew *= by_z
            np.subtract(prior[t], new[t], out=dz)
            dz *= dh
            dz *= z[t]
            dz *= by_z
            np.multiply(dnew, r[t], out=down)
            np.subtract(1, r[t], out=dr)
            dr *= down
            dr *= hc[t]
            dh *= z[t]
            for part in np.matmul(dgates[:3], back):
                dh += part
            dh[starts[t]] = 0
            dwh += np.matmul(prior[t].T, dgates[:3])
            dwx += np.matmul(x[t].T, dgates[1:])
            db += np.matmul(ones, dgates[1:])
            np.add.reduce(np.matmul(dgates[1:], to_x), axis=0, out=dx[t])
        g["wh"], g["wx"], g["b"] = np.hstack([*dwh[1:], dwh[0]]), np.hstack(list(dwx)), db.ravel()
        cells = (place[:, None] * EMBED + np.arange(EMBED)).ravel()
        g["embed"] = np.bincount(cells, dx.ravel(), len(words) * EMBED).reshape(-1, EMBED).astype(kind)
        rows = {"embed": words}
        if not met:
            del g["uw"], g["bw"]
        elif sum(m.stop - m.start for m in met) < len(w["uw"]):
            rows["uw"] = rows["bw"] = np.concatenate([np.arange(m.start, m.stop) for m in met])
            g["uw"], g["bw"] = g["uw"][rows["uw"]], g["bw"][rows["bw"]]
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        self.step += 1
        for name, value in g.items():
            value *= kind.type(0.1 * min(1, 1 / max(norm, 1e-9)))
            self._adam(name, value, rows.get(name, slice(None)), kind.type(self.rate * share))
        return h, tokens[-1]

    def _outputs(self, states, targets, real, careful=False):
        """Gradients of the logits' weights, the classes of words that were met, and gradients of the states."""
        kind, levels = states.dtype, _with_bias(self.w)
        order, wanted, classes, ends = by_classes(self.layout, targets)
        by_class = self.room("by_class", len(order), STATE + 1)
        by_class[:, :STATE], by_class[:, STATE] = states[order], 1
        weight = (real[order] / max(1, real.sum())).astype(kind)
        g = [self.room(f"level {k}", *u.shape) for k, u in enumerate(levels)]
        for part in g:
            part.fill(0)
        totals = np.ones((len(LEVELS), len(order)), kind)
        met, ds = [], self.room("ds", *states.shape)
        ds.fill(0)
        with np.errstate(all="ignore"):
            for level, rows, own, cells in stretches(self.layout, wanted, classes, ends):
                u, h = levels[level][rows], by_class[own]
                p, total, _ = _softmax(u, h, cells, careful)
                p *= weight[own] / total
                p.reshape(-1)[cells] -= weight[own]
                g[level][rows] += p @ h
                ds[own] += p.T @ u[:, :STATE]
                totals[level, own] = total
                if level == 2 and (not met or met[-1] != rows):
                    met.append(rows)
        if not careful and not _plain(totals):
            return self._outputs(states, targets, real, careful=True)
        out = self.room("by_token", *states.shape)
        out[order] = ds
        return {name: part for (u, b), full in zip(LEVELS, g) for name, part in ((u, full[:, :STATE].copy()), (b, full[:, STATE].copy()))}, met, out

    def _adam(self, name, value, rows, rate):
        """A step of the rows that the window met, by a tenth of their gradients; the moments of other rows wait."""
        first, second = self.first[name][rows], self.second[name][rows]
        first *= 0.9
        first += value
        np.square(value, out=value)
        second *= 0.99
        second += value
        if not isinstance(rows, slice):
            self.first[name][rows], self.second[name][rows] = first, second
        root = np.sqrt(second, out=value)
        root *= rate.dtype.type(1 / np.sqrt(1 - 0.99**self.step))
        root += rate.dtype.type(1e-7)
        step = first / root
        step *= rate / rate.dtype.type(1 - 0.9**self.step)
        self.w[name][rows] -= step
