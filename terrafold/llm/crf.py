"""A linear-chain conditional random field in numpy: hashed features, log-likelihood training with AdaGrad, Viterbi over batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEG = -1e4
#: A lead of label 0, in log score, that is clear but proves nothing by itself; see `certain`.
CUT_MARGIN = 6.0


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray  # labels x labels, from row to column
    start: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights)


def allowed(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Penalties that keep I-x from following anything but B-x or I-x."""
    n = len(labels)
    t, s = np.zeros((n, n)), np.zeros(n)
    for j, b in enumerate(labels):
        if b.startswith("I-"):
            s[j] = NEG
            for i, a in enumerate(labels):
                if a not in (b, "B-" + b[2:]):
                    t[i, j] = NEG
    return t, s


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _pad(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each padded cell in the flat token array (-1 outside), and the mask."""
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    t = np.arange(lengths.max())
    mask = t[None, :] < lengths[:, None]
    return np.where(mask, begin[:, None] + t[None, :], -1), mask


def train(features: np.ndarray, gold: np.ndarray, lengths: np.ndarray, labels: list[str], buckets: int, epochs: int = 6, batch: int = 64, rate: float = 0.3, l2: float = 1e-5, seed: int = 0) -> Model:
    """features: tokens x types of bucket numbers; gold: label numbers; lengths: tokens of each sequence."""
    n = len(labels)
    pen_t, pen_s = allowed(labels)
    used, features = np.unique(features, return_inverse=True)
    features = features.reshape(len(gold), -1)
    w, gw = np.zeros((len(used), n)), np.full((len(used), n), 1e-2)
    tr, gt = np.zeros((n, n)), np.full((n, n), 1e-2)
    st, gs = np.zeros(n), np.full(n, 1e-2)
    rng = np.random.default_rng(seed)
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(lengths, kind="stable")
    batches = []
    for s in range(0, len(order), batch):
        ids = order[s : s + batch]
        rows = np.concatenate([np.arange(begin[i], begin[i] + lengths[i]) for i in ids])
        f = features[rows].ravel()
        by = np.argsort(f, kind="stable")
        fs = f[by]
        first = np.r_[0, np.nonzero(fs[1:] != fs[:-1])[0] + 1]
        batches.append((lengths[ids], rows, by // features.shape[1], first, fs[first]))
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            ln, rows, tok, first, feats = batches[b]
            where, mask = _pad(ln)
            emis = w[features[rows]].sum(1)
            e = np.where(mask[:, :, None], emis[where], 0.0)
            y = gold[rows][where]
            t_max = e.shape[1]
            tt, ss = tr + pen_t, st + pen_s
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = ss + e[:, 0]
            for t in range(1, t_max):
                a = _lse(alpha[:, t - 1, :, None] + tt[None], 1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
            logz = _lse(alpha[:, -1], 1)
            g_tr = np.zeros((n, n))
            for t in range(t_max - 2, -1, -1):
                nxt = e[:, t + 1] + beta[:, t + 1]
                bt = _lse(tt[None] + nxt[:, None, :], 2)
                live = mask[:, t + 1]
                beta[:, t] = np.where(live[:, None], bt, 0.0)
                pair = np.exp(alpha[live, t, :, None] + tt[None] + nxt[live, None, :] - logz[live, None, None])
                g_tr += pair.sum(0)
                np.add.at(g_tr, (y[live, t], y[live, t + 1]), -1.0)
            p = np.exp(alpha + beta - logz[:, None, None])
            g_st = p[:, 0].sum(0) - np.bincount(y[:, 0], minlength=n)
            g = p[mask]
            g[np.arange(len(g)), y[mask]] -= 1.0
            # p[mask] runs sequence by sequence, as rows does
            g_w = np.add.reduceat(g[tok], first, axis=0) / len(ln) + l2 * w[feats]
            gw[feats] += g_w**2
            w[feats] -= rate * g_w / np.sqrt(gw[feats])
            for par, acc, grad in ((tr, gt, g_tr / len(ln)), (st, gs, g_st / len(ln))):
                acc += grad**2
                par -= rate * grad / np.sqrt(acc)
    full = np.zeros((buckets, n), np.float32)
    full[used] = w
    return Model(labels, full, (tr + pen_t).astype(np.float32), (st + pen_s).astype(np.float32))


def outside(emissions: np.ndarray, margin: float) -> np.ndarray:
    """Tokens at which label 0 leads every other label by the margin."""
    return emissions[:, 0] - emissions[:, 1:].max(1) > margin


def certain(model: Model, emissions: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens that every best path gives label 0. last: the token ends its sequence.

    A path with another label j here is beaten by the one with 0 if 0 leads j by more than the transitions on both sides
    can favour j. Where the next label is I-x it becomes B-x, so that its lead over B-x and the transition after it count too.
    """
    tr, st, names = model.transitions.astype(float), model.start.astype(float), model.labels
    legal = np.array(allowed(names)[0]) == 0
    begins = np.array([not b.startswith("I-") for b in names])
    sure = np.ones(len(emissions), bool)
    for j in range(1, len(names)):
        before = (tr[:, j] - tr[:, 0])[legal[:, j]].max()
        if begins[j]:
            before = max(before, st[j] - st[0])
        need = np.full(len(emissions), before + max(0.0, (tr[j] - tr[0])[begins].max()))
        inner, outer = (names.index(f"{p}-{names[j][2:]}") if f"{p}-{names[j][2:]}" in names else None for p in "IB")
        if inner is not None:
            after = max(0.0, (tr[inner] - tr[outer])[legal[inner]].max()) if outer is not None else np.inf
            onward = before + (tr[j, inner] - tr[0, outer] if outer is not None else 0.0) + after
            lead = np.r_[emissions[1:, inner] - emissions[1:, outer if outer is not None else inner], np.zeros(min(1, len(emissions)))]
            need = np.where(last, need, np.maximum(need, onward + lead))
        sure &= emissions[:, 0] - emissions[:, j] > need + 1e-3
    return sure


def viterbi(model: Model, emissions: np.ndarray, lengths: np.ndarray, cells: int = 400_000, margin: float | None = None) -> np.ndarray:
    """Best label of each token.

    Where a token is certain to have label 0 the chain is cut; the pieces between are decoded exactly, in batches of
    similar length, at most `cells` padded tokens at once. With a margin it is cut where label 0 leads by it instead,
    which proves nothing; an infinite one cuts nothing.
    """
    n = len(emissions)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    new = np.r_[True, doc[1:] != doc[:-1]]
    sure = certain(model, emissions, np.r_[new[1:], True]) if margin is None else outside(emissions, margin)
    opens = ~sure & (new | np.r_[True, sure[:-1]])
    closes = ~sure & (np.r_[new[1:], True] | np.r_[sure[1:], True])
    begin, end = np.nonzero(opens)[0], np.nonzero(closes)[0] + 1
    first = np.where(new[begin][:, None], model.start[None], model.transitions[0][None])
    ends_doc = np.r_[new[1:], True][end - 1]
    final = np.where(ends_doc[:, None], np.float32(0), model.transitions[:, 0][None])
    size = end - begin
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        take = 1
        while at + take < len(order) and (take + 1) * size[order[at + take]] <= cells:
            take += 1
        ids = order[at : at + take]
        at += take
        ln, b0 = size[ids], begin[ids]
        t_max = int(ln.max())
        back = np.zeros((t_max, len(ids), len(model.labels)), np.int8)
        score = first[ids] + emissions[b0]
        for t in range(1, t_max):
            live = np.nonzero(ln > t)[0]
            cand = score[live][:, :, None] + model.transitions[None]
            k = cand.argmax(1)
            back[t, live] = k
            score[live] = np.take_along_axis(cand, k[:, None, :], 1)[:, 0, :] + emissions[b0[live] + t]
        cur = (score + final[ids]).argmax(1)
        for t in range(t_max - 1, -1, -1):
            live = np.nonzero(ln > t)[0]
            out[b0[live] + t] = cur[live]
            if t:
                cur[live] = back[t, live, cur[live]]
    return out
