"""A small gated recurrent language model in numpy with a class-factored output.

Output words are sorted by frequency into classes of equal size, and classes into as many groups as a group has
classes; a word's probability is that of its group times its class's in the group times its own in the class, so a
step costs the groups, one group's classes and one class's words. Class 0 holds the end of a text and the tail, which
pads lanes. Further words, dealt to buckets, are words of the model themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

END, TAIL = 0, 1
#: Words of a class at least; large vocabularies have larger classes.
CLASS_SIZE = 32
#: Words of one pass through the output layer, whose logits stay in a core's own cache.
OUTPUT_ROWS = 2048
#: Numbers of a table that one step of training moves at once, in cache as well.
STEP_SIZE = 1 << 15
#: Texts that are scored side by side.
SCORE_LANES = 1024
#: Bound on weights and on what training adds to a bias: a logit stays where its exponential is a finite float.
WEIGHT_MOST = 4.0
LEVELS = ("groups", "classes", "words")
_NONE = -1e9


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


@dataclass
class Gru:
    """Parameters by name. Words 2, 3, ... are the output vocabulary, the most frequent first.

    LEVELS names the output layers: of groups (one table), of a group's classes (a table for each group), of a class's
    words (a table for each class). The last row of each table is a bias: states are followed by a 1."""

    p: dict[str, np.ndarray]
    spaces: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def space(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, the same memory in every call: large arrays made anew are mapped page by page."""
        n = int(np.prod(shape))
        if name not in self.spaces or self.spaces[name].size < n:
            self.spaces[name] = np.empty(n, np.float32)
        return self.spaces[name][:n].reshape(shape)

    @staticmethod
    def fresh(counts: np.ndarray, hidden: int, seed: int = 11) -> Gru:
        """counts: training counts of END, TAIL and each vocabulary word. Starts as the unigram model."""
        words = len(counts) - 2
        size = max(CLASS_SIZE, 1 << round(np.log2(max(words, 1)) / 2))
        group = int(np.ceil(np.sqrt(1 + -(-words // size))))
        table = np.full((group * group, size), _NONE)
        log = np.log(np.maximum(counts, 0.5))
        table[0, :2] = log[:2]
        table[1:].ravel()[:words] = log[2:]
        layers: dict[str, np.ndarray] = {}
        for name in reversed(LEVELS):
            top = table.max(axis=1, keepdims=True)
            mass = top + np.log(np.exp(table - top).sum(axis=1, keepdims=True))
            bias = np.where(table > _NONE / 2, table - mass, _NONE)
            layers[name] = np.concatenate([np.zeros((len(table), hidden, table.shape[1])), bias[:, None]], axis=1).astype(np.float32)
            table = np.maximum(mass, _NONE).reshape(-1, min(group, len(mass)))
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(hidden)).astype(np.float32)
        return Gru(
            {
                "embed": draw(words + 2, hidden),
                "wx": draw(hidden, 3 * hidden),
                "bx": np.zeros(3 * hidden, np.float32),
                "wh": draw(hidden, 3 * hidden),
            }
            | layers
        )

    @property
    def hidden(self) -> int:
        return self.p["wh"].shape[0]

    @property
    def class_size(self) -> int:
        return self.p["words"].shape[2]

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def filled(self, flat: np.ndarray) -> Gru:
        out, at = {}, 0
        for k, v in self.p.items():
            out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return Gru(out)

    def steps(self, x: np.ndarray, h: np.ndarray, inputs: np.ndarray, keep: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """States after each of the inputs x (time, lanes), from h; END empties a lane's state.

        inputs: each word's embedding times wx. keep takes what the way back needs. ends: where END stands, if x
        are not words."""
        H, wh = self.hidden, self.p["wh"]
        out = np.empty((*x.shape, H), np.float32)
        for t in range(len(x)):
            mask = (x[t] != END if ends is None else ~ends[t])[:, None].astype(np.float32)
            h = h * mask
            g, u = inputs[x[t]], h @ wh
            zr = g[:, : 2 * H] + u[:, : 2 * H]
            _sigmoid(zr)
            z, r, un = zr[:, :H], zr[:, H:], u[:, 2 * H :]
            n = r * un
            n += g[:, 2 * H :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep is not None:
                for k, part in enumerate((h, z, r, un, n)):
                    keep[k, t] = part
            h = out[t] = new
        return out

    def log_probability(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each word y after its state."""
        out, (order, way) = np.empty(len(y)), self.by_class(y)
        for a in range(0, len(y), OUTPUT_ROWS):
            at = slice(a, a + OUTPUT_ROWS)
            *_, out[order[at]] = self.output(states[order[at]], way[:, at])
        return out

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the words y by class, and in that order the way to each: its group, its class, its place in the
        group and its place in the class. Runs of it meet few classes, so passes through the output layer can be short."""
        of = np.where(y < 2, 0, (y - 2) // self.class_size + 1)
        order = np.argsort(of.astype(np.uint16 if self.p["words"].shape[0] < 1 << 16 else np.int64), kind="stable")
        of, y = of[order], y[order]
        group, inside = np.divmod(of, self.p["classes"].shape[2])
        return order, np.stack([group, of, inside, np.where(y < 2, y, (y - 2) % self.class_size)])

    @staticmethod
    def levels(way: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Each output layer with the tables and places in them on this way."""
        group, of, inside, place = way
        return list(zip(LEVELS, (np.zeros_like(group), group, of), (group, inside, place), strict=True))

    def output(self, states: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For words on this way, by class: the states followed by a 1, the exponentials of each layer's logits, their
        sums, and the words' log probabilities."""
        n = way.shape[1]
        s = self.space("states", n, self.hidden + 1)
        s[:, :-1], s[:, -1] = states, 1
        k, shares, sums, logs = np.arange(n), [], [], np.zeros(n)
        for name, table, place in self.levels(way):
            w = self.p[name]
            z = self.space("z" + name, n, w.shape[2])
            for c, i in self.runs(table):
                np.matmul(s[i], w[c], out=z[i])
            logs += z[k, place]
            np.exp(z, out=z)
            shares.append(z)
            sums.append(z @ np.ones(w.shape[2], np.float32))
            logs -= np.log(sums[-1])
        return s, shares, sums, logs

    @staticmethod
    def runs(of: np.ndarray) -> list[tuple[int, slice]]:
        """Each number that occurs and its run in the sorted numbers."""
        bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        return [(int(of[a]), slice(a, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def score(self, texts: list[np.ndarray], window: int = 64) -> np.ndarray:
        """Log probability of each whole text (its words, END last); states are carried from window to window."""
        inputs = self.p["embed"] @ self.p["wx"] + self.p["bx"]
        order = np.argsort([-len(t) for t in texts], kind="stable")
        out = np.zeros(len(texts))
        for a in range(0, len(texts), SCORE_LANES):
            lanes = order[a : a + SCORE_LANES]
            out[lanes] = self.side_by_side([texts[i] for i in lanes], inputs, window)
        return out

    def side_by_side(self, texts: list[np.ndarray], inputs: np.ndarray, window: int) -> np.ndarray:
        """As score, of texts the longest first."""
        size = np.array([len(t) for t in texts])
        out = np.zeros(len(texts))
        h = np.zeros((len(texts), self.hidden), np.float32)
        for at in range(0, int(size[0]), window):
            live = int(np.searchsorted(-size, -at, side="left"))  # longest first: those longer than at
            h = h[:live]
            width = min(window, int(size[0]) - at)
            x, y = np.full((width, live), TAIL), np.full((width, live), -1)
            for j in range(live):
                part = texts[j][at : at + width]
                y[: len(part), j] = part
                x[1 : len(part), j] = part[:-1]
                x[0, j] = texts[j][at - 1] if at else END
            states = self.steps(x, h, inputs)
            h = states[-1]
            real = y >= 0
            lane = np.broadcast_to(np.arange(live), y.shape)[real]
            out[:live] += np.bincount(lane, self.log_probability(states[real], y[real]), live)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
        """Gradients of the mean loss over one window, cut off at its start; the words whose embeddings those of embed
        are; the last state; the mean loss."""
        p, H, (steps, lanes) = self.p, self.hidden, x.shape
        used, own = np.unique(x, return_inverse=True)
        inputs, kept = p["embed"][used] @ p["wx"] + p["bx"], self.space("kept", 5, steps, lanes, H)
        own = own.reshape(x.shape)
        states = self.steps(own, h, inputs, kept, x == END)
        s, t = states.reshape(-1, H), y.reshape(-1)
        n = len(t)
        order, ways = self.by_class(t)
        g, loss = {name: np.zeros_like(p[name]) for name in LEVELS}, 0.0
        ds = self.space("ds", n, H)
        for a in range(0, n, OUTPUT_ROWS):
            rows, way = order[a : a + OUTPUT_ROWS], ways[:, a : a + OUTPUT_ROWS]
            s1, shares, sums, logs = self.output(s[rows], way)
            loss -= float(logs.sum())
            # What a logit is to change by is its share less 1 where it is right. Shares are left as exponentials;
            # their sums and n divide the few rows of states and of what goes back.
            k, back, within = np.arange(len(rows)), 0.0, self.space("within", len(rows), H)
            for (name, table, place), z, total in zip(self.levels(way), shares, sums, strict=True):
                z[k, place] -= total
                total = 1 / (total * n)[:, None]
                scaled = s1 * total
                for c, i in self.runs(table):
                    g[name][c] += scaled[i].T @ z[i]
                    np.matmul(z[i], p[name][c][:-1].T, out=within[i])
                within *= total
                back = back + within
            ds[rows] = back
        ds = ds.reshape(steps, lanes, H)
        # All that does not wait for a later step is worked out for all steps at once.
        h0, z, r, un, nn = kept
        to_n, to_z, to_r = (1 - z) * (1 - nn * nn), (h0 - nn) * z * (1 - z), un * r * (1 - r)
        alive, wht = (x != END)[:, :, None].astype(np.float32), np.ascontiguousarray(p["wh"].T)
        dx, du = self.space("dx", steps, lanes, 3 * H), self.space("du", steps, lanes, 3 * H)
        dh = np.zeros((lanes, H), np.float32)
        for j in range(steps - 1, -1, -1):
            dh += ds[j]
            dn = dx[j, :, 2 * H :] = dh * to_n[j]
            np.multiply(dh, to_z[j], out=du[j, :, :H])
            np.multiply(dn, to_r[j], out=du[j, :, H : 2 * H])
            np.multiply(dn, r[j], out=du[j, :, 2 * H :])
            dh *= z[j]
            dh += du[j] @ wht
            dh *= alive[j]
        dx[:, :, : 2 * H] = du[:, :, : 2 * H]
        g["wh"] = h0.reshape(-1, H).T @ du.reshape(-1, 3 * H)
        flat, own = dx.reshape(-1, 3 * H), own.reshape(-1)
        g["bx"] = flat.sum(axis=0)
        g["wx"] = p["embed"][x.reshape(-1)].T @ flat
        order = np.argsort(own.astype(np.uint16 if len(used) < 1 << 16 else np.int64), kind="stable")
        g["embed"] = np.add.reduceat((flat @ p["wx"].T)[order], np.searchsorted(own[order], np.arange(len(used))), axis=0)
        return g, used, states[-1], loss / n


class Trainer:
    """Truncated backpropagation over a stream of texts, dealt to parallel lanes, with Adam."""

    def __init__(self, model: Gru, window: int = 32, lanes: int = 256, windows: int = 4, rate: float = 0.014, clip: float = 1.0) -> None:
        self.model, self.window, self.lanes, self.windows, self.rate, self.clip = model, window, lanes, windows, rate, clip
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.step = 0
        self.words = 0
        self.held: list[np.ndarray] = []
        self.size = 0
        self.losses: list[float] = []

    def add(self, words: np.ndarray) -> None:
        self.held.append(words)
        self.size += len(words)
        if self.size >= self.window * self.lanes * self.windows:
            self.pass_over()

    def flush(self) -> None:
        """Trains on all that is held."""
        while self.size:
            self.pass_over()

    def pass_over(self) -> None:
        """Trains on what is held; lanes are runs of the stream of equal length, and what is left over stays held."""
        stream = np.concatenate(self.held)
        lanes = min(self.lanes, max(1, len(stream) // self.window))
        length = len(stream) // lanes
        rest = stream[lanes * length :]
        self.held, self.size = [rest], len(rest)
        y = stream[: lanes * length].reshape(lanes, length).T
        x = np.concatenate([np.full((1, lanes), END), y[:-1]])
        h = np.zeros((lanes, self.model.hidden), np.float32)
        for at in range(0, length, self.window):
            g, used, h, loss = self.model.gradients(x[at : at + self.window], y[at : at + self.window], h)
            self.losses.append(loss)
            self.update(g, used)
        self.words += lanes * length

    def update(self, g: dict[str, np.ndarray], used: np.ndarray) -> None:
        """One step of Adam; of embeddings, only those of the used words move."""
        self.step += 1
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
        scale = min(1.0, self.clip / max(norm, 1e-12))
        rate = self.rate * min(1.0, self.step / 10) / np.sqrt(1 + self.step / 200) / (1 - 0.9**self.step)
        unbias = np.sqrt(1 - 0.99**self.step)
        for k, x in g.items():
            if k == "embed":
                p, m, v = self.model.p[k][used], self.m[k][used], self.v[k][used]
            else:
                p, m, v = self.model.p[k], self.m[k], self.v[k]
            flat = [a.reshape(-1) for a in (x, p, m, v)]
            for a in range(0, x.size, STEP_SIZE):
                dx, dp, dm, dv = (b[a : a + STEP_SIZE] for b in flat)
                dm *= np.float32(0.9)
                dm += np.float32(0.1 * scale) * dx
                dv *= np.float32(0.99)
                np.multiply(dx, dx, out=dx)
                dx *= np.float32(0.01 * scale * scale)
                dv += dx
                np.sqrt(dv, out=dx)
                dx += np.float32(1e-8 * unbias)
                np.divide(dm, dx, out=dx)
                dx *= np.float32(rate * unbias)
                dp -= dx
            if k == "embed":
                self.model.p[k][used], self.m[k][used], self.v[k][used] = p, m, v
            if k in LEVELS:
                np.clip(p[..., :-1, :], -WEIGHT_MOST, WEIGHT_MOST, out=p[..., :-1, :])
                np.minimum(p[..., -1, :], WEIGHT_MOST, out=p[..., -1, :])
