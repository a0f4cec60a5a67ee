"""Filling fixed-capacity containers with whole items by Karmarkar-Karp multiway differencing.

Items larger than the capacity are cut into full pieces and a rest; nothing else is cut. The items of each capacity are
spread by hash over shards that fill about `windows` containers each, so a task's work is bounded however many items
there are, and each shard is partitioned into near-equal windows: of the partial partitions the two with the largest
differences are merged so that large windows meet small ones. While a window exceeds the capacity, the number of
windows rises and the shard is partitioned again.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = 256
MAX_CONTAINERS = 1000


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item (0..m-1) and the load of each window, by m-way largest differencing.

    The two partial partitions with the largest differences are merged, the largest windows of one on the smallest of the
    other, until one is left. Single items come in descending order, which allows two shortcuts that change no merge: items that
    meet only each other stand side by side, up to m of them at once; and a partition that meets one item after the
    other takes each in its smallest window, from a heap of windows. What is left to do window by window are merges of whole
    partitions, about n / m of them.
    """
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, np.int64), np.array([sizes.sum()] if m == 1 else [0] * m, np.int64)
    order = np.argsort(-sizes, kind="stable")
    s = sizes[order].astype(np.int64)
    ints = s.tolist()
    nxt, tail = [-1] * n, list(range(n))  # the items of a window, as a linked list from its first

    def link(a: int, b: int) -> int:
        """The list a with the list b behind it; -1 is an empty one."""
        if a < 0 or b < 0:
            return max(a, b)
        nxt[tail[a]], tail[a] = b, tail[b]
        return a

    def difference(v: np.ndarray) -> int:
        return int(v[0] - v[-1])

    # Partitions: m loads over their smallest, descending, and the first item of each window; the heap has them by difference.
    parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    at = tick = 0
    while at < n or len(parts) > 1:
        top = -parts[0][0] if parts else -1
        if at < n and ints[at] >= top:  # singles meet: they fill windows of a new partition, as long as no other partition is due
            k = min(n - at, m)
            if parts:
                k = max(1, min(k, int(np.searchsorted(-s[at : at + k], -top, side="right"))))
            v, first = np.zeros(m, np.int64), np.full(m, -1)
            v[:k], first[:k] = s[at : at + k], np.arange(at, at + k)
            at += k
            heapq.heappush(parts, (-difference(v), tick, v - v[-1], first))
            tick += 1
            continue
        _, _, v, first = heapq.heappop(parts)
        other = -parts[0][0] if parts else -1
        if at < n and ints[at] >= other:  # a partition meets one single after the other
            slots = list(zip(v[::-1].tolist(), range(m)))  # ascending: a heap already
            heads, most = first[::-1].tolist(), int(v[0])
            while at < n and ints[at] >= other and most - slots[0][0] >= ints[at]:
                low, k = slots[0]
                heads[k] = link(heads[k], at)
                heapq.heapreplace(slots, (low + ints[at], k))
                most = max(most, low + ints[at])
                at += 1
                if most - slots[0][0] < other:
                    break
            slots.sort(reverse=True)
            v, first = np.array([x for x, _ in slots]), np.array([heads[k] for _, k in slots])
        else:
            _, _, w, second = heapq.heappop(parts)
            v = v + w[::-1]
            first = np.array([link(a, b) for a, b in zip(first.tolist(), second[::-1].tolist())])
            o = np.argsort(-v, kind="stable")
            v, first = v[o], first[o]
        heapq.heappush(parts, (-difference(v), tick, v - v[-1], first))
        tick += 1
    window, load = np.zeros(n, np.int64), np.zeros(m, np.int64)
    for w, item in enumerate(parts[0][3].tolist()):
        while item >= 0:
            window[order[item]] = w
            load[w] += ints[item]
            item = nxt[item]
    return window, load


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item so that no window exceeds the capacity; the number of windows starts at its lower bound.

    Items as large as the capacity have windows of their own and take no part.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("an item exceeds the capacity")
    full = sizes == capacity
    out, rest = np.zeros(len(sizes), np.int64), sizes[~full]
    out[full] = np.arange(full.sum())
    if not len(rest):
        return out
    m = max(-(-int(rest.sum()) // capacity), int((2 * rest > capacity).sum()), 1)
    while True:
        window, load = differencing(rest, m)
        over = np.maximum(load - capacity, 0).sum()
        if not over:
            out[~full] = window + full.sum()
            return out
        m = min(len(rest), m + max(1, -(-int(over) // (2 * capacity))))


def packed(sizes: DataFrame, containers: list[tuple[str, int]], windows: int = WINDOWS) -> DataFrame:
    """container, capacity, window, doc_id, part, begin, n_tokens: the contents of every window.

    sizes: doc_id and n_tokens; items of 0 tokens (null and empty texts) are not packed. begin is the first token of the
    piece within its text, part its number from 0. A window is a number unique within its container. Containers without
    a positive capacity are left out.
    """
    usable = [(c, int(k)) for c, k in containers if k is not None and k > 0]
    if len(usable) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} container kinds")
    empty = "container string, capacity int, window long, doc_id long, part int, begin long, n_tokens long"
    s = sizes.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n_tokens")
    if not usable:
        return sizes.sparkSession.createDataFrame([], empty)
    total = s.agg(F.sum("n_tokens")).first()[0] or 0
    kinds = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).alias("capacity"), F.lit(max(1, -(-total // (windows * k)))).cast("long").alias("shards")) for c, k in usable])
    x = s.withColumn("_k", F.explode(kinds)).select("doc_id", "n_tokens", "_k.*")
    cut = F.floor((F.col("n_tokens") - 1) / F.col("capacity"))  # full pieces before the last
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), cut))).withColumn("begin", F.col("part") * F.col("capacity"))
    x = x.withColumn("n", F.least(F.col("capacity").cast("long"), F.col("n_tokens") - F.col("begin")))
    x = x.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "container"), F.col("shards")))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        w = pack(g.n.to_numpy(np.int64), int(g.capacity.iloc[0]))
        out = g[["container", "capacity"]].copy()
        out["window"] = int(g.shard.iloc[0]) * (1 << 32) + w
        out["doc_id"], out["part"], out["begin"], out["n_tokens"] = g.doc_id, g.part.astype("int32"), g.begin, g.n
        return out

    return x.select("container", "capacity", "shard", "doc_id", "part", "begin", "n").groupBy("container", "shard").applyInPandas(one, empty)


def fills(contents: DataFrame) -> DataFrame:
    """One row a window: how many pieces, how many tokens used, how many left."""
    f = contents.groupBy("container", "capacity", "window").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("used"))
    return f.withColumn("left_over", F.col("capacity") - F.col("used"))
