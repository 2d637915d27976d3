"""A linear-chain conditional random field over sparse features, trained and decoded with numpy in batches.

A token is a row of *parts*; a part stands for a fixed set of string features (its
spelling, its neighbours, its place on the line), so equal parts are scored once
and a token's emission is the sum of a few cached rows.  Maximum conditional
likelihood with L2 by AdaGrad over padded mini-batches, exact forward-backward in
log space, Viterbi over whole batches.
"""

from __future__ import annotations

import io
import json
import random

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class CRF:
    """Weights ``emit[feature, label]`` and ``move[label, label]``; label 0 is outside and feature 0 is any unknown one."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.index, self.emit, self.move = index, emit, move

    def part(self, features: list[str]) -> np.ndarray:
        """Summed emission of a set of features."""
        get = self.index.get
        return self.emit[[get(f, 0) for f in features]].sum(axis=0) if features else np.zeros(self.emit.shape[1], dtype=self.emit.dtype)

    @classmethod
    def fit(cls, sequences: list[tuple[list[list[int]], list[int]]], parts: list[list[str]], n_labels: int, epochs: int = 12, batch: int = 64, rate: float = 0.2, l2: float = 1e-5, least: int = 3, seed: int = 1) -> CRF:
        """``sequences``: (part numbers of each token, label of each token); ``parts``: features by part number."""
        use = np.zeros(len(parts), dtype=np.int64)
        for rows, _ in sequences:
            for r in rows:
                use[r] += 1
        seen: dict[str, int] = {}
        for k, fs in enumerate(parts):
            for f in fs:
                seen[f] = seen.get(f, 0) + int(use[k])
        index = {x: i + 1 for i, x in enumerate(sorted(k for k, v in seen.items() if v >= least))}
        coded = [np.array([index[f] for f in fs if f in index], dtype=np.int64) for fs in parts]
        data = []
        for rows, y in sequences:
            if y:
                per = [np.concatenate([coded[k] for k in r]) for r in rows]
                data.append((np.concatenate(per), np.array([len(p) for p in per]), np.array(y)))
        n_feat = len(index) + 1
        emit, move = np.zeros((n_feat, n_labels)), np.zeros((n_labels, n_labels))
        g_emit, g_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
        rng = random.Random(seed)
        order = list(range(len(data)))
        for _ in range(epochs):
            rng.shuffle(order)
            order.sort(key=lambda i: len(data[i][2]) // 6)  # like lengths together, little padding
            starts = list(range(0, len(order), batch))
            rng.shuffle(starts)
            for s in starts:
                part = [data[i] for i in order[s : s + batch]]
                lens = np.array([len(y) for _, _, y in part])
                n, t = len(part), int(lens.max())
                ids, per = np.concatenate([x for x, _, _ in part]), np.concatenate([p for _, p, _ in part])
                where = np.repeat(np.arange(len(per)), per)
                flat = np.stack([np.bincount(where, emit[ids, c], len(per)) for c in range(n_labels)], axis=1)
                mask = np.arange(t)[None, :] < lens[:, None]
                score = np.zeros((n, t, n_labels))
                score[mask] = flat
                gold = np.zeros((n, t), dtype=np.int64)
                gold[mask] = np.concatenate([y for _, _, y in part])
                a = np.zeros_like(score)
                a[:, 0] = score[:, 0]
                for k in range(1, t):
                    nxt = _lse(a[:, k - 1][:, :, None] + move[None], 1) + score[:, k]
                    a[:, k] = np.where(mask[:, k][:, None], nxt, a[:, k - 1])
                b = np.zeros_like(score)
                for k in range(t - 2, -1, -1):
                    nxt = _lse(move[None] + (score[:, k + 1] + b[:, k + 1])[:, None, :], 2)
                    b[:, k] = np.where(mask[:, k + 1][:, None], nxt, 0.0)
                z = _lse(a[:, -1], 1)
                d = np.exp(a + b - z[:, None, None])
                np.put_along_axis(d, gold[:, :, None], np.take_along_axis(d, gold[:, :, None], 2) - 1, 2)
                dflat = d[mask]
                here = np.unique(ids)
                at = np.searchsorted(here, ids)
                d_emit = np.stack([np.bincount(at, dflat[where, c], len(here)) for c in range(n_labels)], axis=1) / n + l2 * emit[here]
                d_move = np.zeros_like(move)
                for k in range(1, t):
                    m = mask[:, k]
                    pair = np.exp(a[m, k - 1][:, :, None] + move[None] + (score[m, k] + b[m, k])[:, None, :] - z[m][:, None, None])
                    d_move += pair.sum(0)
                    np.add.at(d_move, (gold[m, k - 1], gold[m, k]), -1)
                d_move = d_move / n + l2 * move
                g_emit[here] += d_emit**2
                g_move += d_move**2
                emit[here] -= rate * d_emit / np.sqrt(g_emit[here])
                move -= rate * d_move / np.sqrt(g_move)
        emit[0] = 0
        return cls(index, emit.astype(np.float32), move)

    def pruned(self, least: float) -> CRF:
        """Without the features none of whose weights reaches ``least``."""
        keep = [(f, i) for f, i in self.index.items() if np.abs(self.emit[i]).max() >= least]
        emit = np.zeros((len(keep) + 1, self.emit.shape[1]), dtype=np.float32)
        for k, (_, i) in enumerate(keep):
            emit[k + 1] = self.emit[i]
        return CRF({f: k + 1 for k, (f, _) in enumerate(keep)}, emit, self.move)

    def dumps(self, about: dict) -> bytes:
        """Weights and their recipe as one compressed archive."""
        out = io.BytesIO()
        names = sorted(self.index, key=self.index.__getitem__)
        np.savez_compressed(out, emit=self.emit.astype(np.float16), move=self.move, names=np.frombuffer("\x00".join(names).encode(), dtype=np.uint8), about=np.frombuffer(json.dumps(about).encode(), dtype=np.uint8))
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> tuple[CRF, dict]:
        z = np.load(io.BytesIO(raw))
        names = z["names"].tobytes().decode().split("\x00")
        return cls({f: i + 1 for i, f in enumerate(names)}, z["emit"].astype(np.float32), z["move"]), json.loads(z["about"].tobytes().decode())

    def decode(self, scores: np.ndarray, lens: list[int], group: int = 256) -> list[np.ndarray]:
        """The most probable labels of several sequences whose emission rows lie end to end; like lengths are decoded together."""
        starts = np.concatenate([[0], np.cumsum(lens)])
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(lens)
        order = sorted((i for i in range(len(lens)) if lens[i]), key=lens.__getitem__)
        move = self.move[None]
        for s in range(0, len(order), group):
            part = order[s : s + group]
            n, t = len(part), lens[part[-1]]
            size = np.array([lens[i] for i in part])
            grid = np.zeros((n, t, scores.shape[1]))
            for k, i in enumerate(part):
                grid[k, : lens[i]] = scores[starts[i] : starts[i + 1]]
            best, back = grid[:, 0], np.zeros(grid.shape, dtype=np.int8)
            for k in range(1, t):
                step = best[:, :, None] + move
                back[:, k] = step.argmax(1)
                best = np.where((k < size)[:, None], step.max(1) + grid[:, k], best)
            at = best.argmax(1)
            labels = np.zeros((n, t), dtype=np.int64)
            rows = np.arange(n)
            for k in range(t - 1, -1, -1):
                labels[:, k] = at
                at = np.where((k < size) & (k > 0), back[rows, k, at], at)
            for k, i in enumerate(part):
                out[i] = labels[k, : lens[i]]
        return out
