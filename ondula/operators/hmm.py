"""Gaussian hidden Markov models over long sessions.

A session is cut into blocks. Each block is reduced to one state-by-state
matrix (a product of transition and emission factors), a scan over
these matrices, as a tree, gives the message at every block border, and the blocks are
then solved independently. Results equal the unsplit recursion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.operators.attach import attach
from ondula.operators.joins import project_frames
from ondula.operators.matrix import moments
from ondula.session import cut

BLOCK = 4096
#: Blocks or groups of blocks that one step of a scan takes.
FAN = 64
RIDGE = 1e-6  # fixed: added to every covariance


def session_blocks(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """``recording, blk, t[], x[]`` of a dense t."""
    b = frames.groupBy("recording", F.floor(F.col("t") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("_c"))
    return b.select("recording", "blk", F.col("_c.t").alias("t"), F.flatten("_c.x").alias("x"))


@dataclass
class GaussianHMM:
    n_states: int
    stay: float = 0.9
    seed: int = 0
    means: np.ndarray | None = None
    covs: np.ndarray | None = None
    trans: np.ndarray | None = None
    start: np.ndarray | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    history: list[float] = field(default_factory=list)

    # ---------------------------------------------------------------- parameters

    def _init(self, mean: np.ndarray, cov: np.ndarray, seed: int) -> None:
        s, c = self.n_states, len(mean)
        rng = np.random.default_rng(seed)
        self.means = mean + rng.normal(size=(s, c)) * np.sqrt(np.diag(cov)) * 0.2
        self.covs = np.repeat((cov + RIDGE * np.eye(c))[None], s, axis=0)
        self.trans = np.full((s, s), (1 - self.stay) / (s - 1)) if s > 1 else np.ones((1, 1))
        if s > 1:
            np.fill_diagonal(self.trans, self.stay)
        self.start = np.full(s, 1 / s)
        self.history = []

    def _emission(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        covs = self.covs + RIDGE * np.eye(self.covs.shape[1])
        chol = np.linalg.cholesky(covs)
        return self.means, np.linalg.inv(covs), 2 * np.log(np.einsum("sii->si", chol)).sum(axis=1)

    def _kernel(self) -> "_Kernel":
        return _Kernel(*self._emission(), self.trans.copy(), self.start.copy())

    # ----------------------------------------------------------------------- fit

    def fit(self, frames: DataFrame, n_epochs: int = 20, n_init: int = 1, standardise: bool = True, block: int = BLOCK) -> list[float]:
        """Expectation-maximisation; with several starts each runs five epochs and the best goes on."""
        m = moments(frames)
        if standardise:
            self.shift, self.scale = m.mean, np.maximum(np.sqrt(np.diag(m.cov)), 1e-10)
            frames = self._standard(frames)
            mean, cov = np.zeros(len(m.mean)), m.cov / np.outer(self.scale, self.scale)
        else:
            mean, cov = m.mean, m.cov
        cov = cov * m.n / (m.n - 1)
        blocks = cut(_with_first(session_blocks(frames, block)))
        warm = min(5, n_epochs)
        best = None
        for i in range(n_init):
            self._init(mean, cov, self.seed + i)
            self._em(blocks, warm)
            if best is None or self.history[-1] > best[0]:
                best = (self.history[-1], self.means, self.covs, self.trans, self.start, list(self.history))
        _, self.means, self.covs, self.trans, self.start, self.history = best
        self._em(blocks, n_epochs - warm)
        return self.history

    def _standard(self, frames: DataFrame) -> DataFrame:
        if self.shift is None:
            return frames
        return project_frames(frames, np.diag(1 / self.scale), self.shift)

    def _em(self, blocks: DataFrame, n_epochs: int) -> None:
        s, c = self.means.shape
        deepest = _deepest(blocks)
        for _ in range(n_epochs):
            k = self._kernel()
            solved = _bordered(blocks, k, deepest)

            def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = None
                for pdf in pdfs:
                    for r in pdf.itertuples(index=False):
                        v = k.statistics(np.asarray(r.x, dtype=float).reshape(-1, c), np.asarray(r.left), np.asarray(r.right), r.blk == r.first, r.ll)
                        total = v if total is None else total + v
                if total is not None:
                    yield pd.DataFrame({"v": [total]})

            rows = solved.mapInPandas(sums, "v array<double>")
            got = rows.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
            v = np.zeros(len(got))
            v[got["i"]] = got["v"]
            parts = np.split(v, np.cumsum([s, s * c, s * c * c, s * s, s, 1]))
            g = np.maximum(parts[0], 1e-10)
            self.history.append(float(parts[5][0]))
            self.means = parts[1].reshape(s, c) / g[:, None]
            second = parts[2].reshape(s, c, c) / g[:, None, None]
            self.covs = second - np.einsum("si,sj->sij", self.means, self.means)
            xi = parts[3].reshape(s, s)
            self.trans = xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-10)
            self.start = parts[4] / parts[4].sum()

    # ----------------------------------------------------------------- inference

    def posterior(self, frames: DataFrame, block: int = BLOCK) -> DataFrame:
        """``recording, t, state, p``."""
        k = self._kernel()
        c = self.means.shape[1]

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for r in pdf.itertuples(index=False):
                    g = k.gamma(np.asarray(r.x, dtype=float).reshape(-1, c), np.asarray(r.left), np.asarray(r.right), r.blk == r.first)
                    t = np.asarray(r.t)
                    yield pd.DataFrame({"recording": r.recording, "t": np.repeat(t, g.shape[1]), "state": np.tile(np.arange(g.shape[1]), len(t)), "p": g.ravel()})

        return _bordered(session_blocks(self._standard(frames), block), k).mapInPandas(run, "recording string, t bigint, state int, p double")

    def decode(self, frames: DataFrame, block: int = BLOCK) -> DataFrame:
        """Most likely path ``recording, t, state``, chained over blocks like the sums."""
        k = self._kernel()
        c = self.means.shape[1]
        blocks = cut(session_blocks(self._standard(frames), block))

        def best(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                m = [k.max_plus(np.asarray(x, dtype=float).reshape(-1, c), b == f) for x, b, f in zip(pdf["x"], pdf["blk"], pdf["first"])]
                yield pd.DataFrame({"recording": pdf["recording"], "node": pdf["node"], "m": [v.ravel() for v in m]})

        def folded(ms: list[np.ndarray]) -> np.ndarray:
            out = ms[0]
            for m in ms[1:]:
                out = (out[:, :, None] + m[None]).max(axis=1)
            return out - out.max()

        def fold(pdf: pd.DataFrame) -> dict:
            return {"m": folded([np.asarray(m).reshape(s, s) for m in pdf["m"]]).ravel()}

        def spread(pdf: pd.DataFrame) -> pd.DataFrame:
            delta, starts = k.log_start if pdf["delta"][0] is None else np.asarray(pdf["delta"][0]), []
            for m in pdf["m"]:
                starts.append(delta)
                delta = (delta[:, None] + np.asarray(m).reshape(s, s)).max(axis=0)
                delta = delta - delta.max()
            return pdf[["recording", "node"]].assign(delta=starts)

        s = len(k.start)
        marked = _with_first(blocks)
        parts = marked.mapInPandas(best, "recording string, node bigint, m array<double>")
        deepest = _deepest(marked)
        starts = _scanned(parts, deepest, fold, "m array<double>", spread, "delta array<double>")
        ready = cut(attach(marked, starts, ["recording", "node"], ["node"]))

        def entry(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                out = [k.path(np.asarray(x, dtype=float).reshape(-1, c), np.asarray(d), b == f) for x, d, b, f in zip(pdf["x"], pdf["delta"], pdf["blk"], pdf["first"])]
                yield pd.DataFrame({"recording": pdf["recording"], "node": pdf["node"], "enter": [o[1] for o in out], "score": [o[2] for o in out]})

        def joined(pdf: pd.DataFrame) -> dict:
            state = np.arange(s)
            for e in pdf["enter"][::-1]:
                state = np.asarray(e)[state]
            return {"enter": state, "score": pdf["score"].iloc[-1]}

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            state = int(np.argmax(pdf["score"].iloc[-1])) if pd.isna(pdf["end"][0]) else int(pdf["end"][0])
            out = []
            for e in pdf["enter"][::-1]:
                out.append(state)
                state = int(e[state])
            return pdf[["recording", "node"]].assign(end=out[::-1])

        maps = ready.mapInPandas(entry, "recording string, node bigint, enter array<int>, score array<double>")
        last = _scanned(maps, deepest, joined, "enter array<int>, score array<double>", ends, "end int")

        def trace(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for r in pdf.itertuples(index=False):
                    back, _, _ = k.path(np.asarray(r.x, dtype=float).reshape(-1, c), np.asarray(r.delta), r.blk == r.first)
                    s, states = r.end, []
                    for row in back[::-1]:
                        states.append(s)
                        s = int(row[s])
                    yield pd.DataFrame({"recording": r.recording, "t": np.asarray(r.t), "state": np.array(states[::-1], dtype=np.int32)})

        return attach(ready, last, ["recording", "node"], ["node"]).mapInPandas(trace, "recording string, t bigint, state int")


class _Kernel:
    """Recursions of one block given the message at its borders."""

    def __init__(self, means: np.ndarray, prec: np.ndarray, log_det: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        self.means, self.prec, self.log_det, self.trans, self.start = means, prec, log_det, trans, start
        self.log_start, self.log_trans = np.log(start + 1e-30), np.log(trans + 1e-30)

    def log_b(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means[None]
        maha = np.einsum("tsi,sij,tsj->ts", d, self.prec, d)
        return -0.5 * (x.shape[1] * np.log(2 * np.pi) + self.log_det + maha)

    def _factors(self, x: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        lb = self.log_b(x)
        top = lb.max(axis=1)
        f = self.trans[None] * np.exp(lb - top[:, None])[:, None, :]
        if first:  # the first sample of a session has no transition before it
            f[0] = np.diag(np.exp(lb[0] - top[0]))
        return f, top

    def product(self, x: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
        """Scaled product of all factors of the block, pair by pair."""
        f, top = self._factors(x, first)
        scale = float(top.sum())
        while len(f) > 1:
            even, odd = (f[:-1], f[-1:]) if len(f) % 2 else (f, f[:0])
            f = np.concatenate([even[::2] @ even[1::2], odd])
            size = np.maximum(f.max(axis=(1, 2)), 1e-300)
            f = f / size[:, None, None]
            scale += float(np.log(size).sum())
        return f[0], scale

    def _messages(self, x: np.ndarray, left: np.ndarray, right: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, _ = self._factors(x, first)
        n, s = len(f), len(left)
        a, b = np.empty((n, s)), np.empty((n, s))
        v = left
        for t in range(n):
            v = v @ f[t]
            v = v / v.sum()
            a[t] = v
        v = right
        b[-1] = v
        for t in range(n - 1, 0, -1):
            v = f[t] @ v
            v = v / v.sum()
            b[t - 1] = v
        return f, a, b

    def gamma(self, x: np.ndarray, left: np.ndarray, right: np.ndarray, first: bool) -> np.ndarray:
        _, a, b = self._messages(x, left, right, first)
        g = a * b
        return g / g.sum(axis=1, keepdims=True)

    def statistics(self, x: np.ndarray, left: np.ndarray, right: np.ndarray, first: bool, ll: float) -> np.ndarray:
        f, a, b = self._messages(x, left, right, first)
        g = a * b
        g = g / g.sum(axis=1, keepdims=True)
        before = np.vstack([left, a[:-1]])
        xi = before[:, :, None] * f * b[:, None, :]
        xi = xi / xi.sum(axis=(1, 2), keepdims=True)
        if first:
            xi = xi[1:]
        init = g[0] if first else np.zeros(g.shape[1])
        return np.concatenate([g.sum(axis=0), (g.T @ x).ravel(), np.einsum("ts,ti,tj->sij", g, x, x, optimize=True).ravel(),
                               xi.sum(axis=0).ravel(), init, [ll if first else 0.0]])

    def max_plus(self, x: np.ndarray, first: bool) -> np.ndarray:
        lb = self.log_b(x)
        s = lb.shape[1]
        m = np.where(np.eye(s, dtype=bool), 0.0, -np.inf)
        for t in range(len(lb)):
            step = np.where(np.eye(s, dtype=bool), 0.0, -np.inf) if first and t == 0 else self.log_trans
            m = (m[:, :, None] + step[None]).max(axis=1) + lb[t]
        return m

    def path(self, x: np.ndarray, delta: np.ndarray, first: bool) -> tuple[np.ndarray, list[int], list[float]]:
        """Back pointers, for each end state the state before the block, and the end scores."""
        lb = self.log_b(x)
        s = lb.shape[1]
        back = np.empty((len(lb), s), dtype=np.int32)
        for t in range(len(lb)):
            if first and t == 0:
                back[t] = np.arange(s)
                delta = delta + lb[t]
            else:
                c = delta[:, None] + self.log_trans
                back[t] = np.argmax(c, axis=0)
                delta = c.max(axis=0) + lb[t]
        enter = np.arange(s)
        for row in back[::-1]:
            enter = row[enter]
        return back, enter.astype(int).tolist(), delta.tolist()


def _bordered(blocks: DataFrame, k: _Kernel, deepest: int | None = None) -> DataFrame:
    """Blocks with the forward message before them, the backward message behind them and the session likelihood."""
    c = k.means.shape[1]
    s = k.means.shape[0]

    def reduce(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = [k.product(np.asarray(x, dtype=float).reshape(-1, c), b == f) for x, b, f in zip(pdf["x"], pdf["blk"], pdf["first"])]
            yield pd.DataFrame({"recording": pdf["recording"], "node": pdf["node"], "m": [o[0].ravel() for o in out], "scale": [o[1] for o in out]})

    def fold(pdf: pd.DataFrame) -> dict:
        out, scale = np.eye(s), float(pdf["scale"].sum())
        for m in pdf["m"]:
            out = out @ np.asarray(m).reshape(s, s)
            size = max(out.max(), 1e-300)
            out, scale = out / size, scale + float(np.log(size))
        return {"m": out.ravel(), "scale": scale}

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        ms = [np.asarray(m).reshape(s, s) for m in pdf["m"]]
        top = pdf["left"][0] is None
        v, ll, left = k.start if top else np.asarray(pdf["left"][0]), 0.0, []
        for m, sc in zip(ms, pdf["scale"]):
            left.append(v)
            v = v @ m
            ll += float(np.log(v.sum())) + sc
            v = v / v.sum()
        v, right = np.ones(s) if top else np.asarray(pdf["right"][0]), []
        for m in ms[::-1]:
            right.append(v / v.sum())
            v = m @ v
            v = v / v.sum()
        return pdf[["recording", "node"]].assign(left=left, right=right[::-1], ll=ll if top else pdf["ll"][0])

    marked = blocks if "first" in blocks.columns else _with_first(blocks)
    parts = marked.mapInPandas(reduce, "recording string, node bigint, m array<double>, scale double")
    borders = _scanned(parts, _deepest(marked) if deepest is None else deepest, fold, "m array<double>, scale double", spread, "left array<double>, right array<double>, ll double")
    return attach(marked, borders, ["recording", "node"], ["node"])  # a small row per block is sent to the blocks, not the blocks to it


def _deepest(marked: DataFrame) -> int:
    return marked.agg(F.max("node")).first()[0] or 0


def _scanned(parts: DataFrame, deepest: int, fold: Callable[[pd.DataFrame], dict], payload: str, spread: Callable[[pd.DataFrame], pd.DataFrame], state: str) -> DataFrame:
    """A scan over ``recording, node, payload`` as a tree of ``FAN`` nodes: ``recording, node, state``.

    Upward, ``fold`` makes one payload of those of up to ``FAN`` neighbours, in order, until a recording has no more than that; downward, ``spread`` gives each of
    a group its state from that of the group (None at the top). So no task gets more than ``FAN`` rows of a recording at a time.
    """
    def folding(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        one = fold(pdf)
        return pd.DataFrame({"recording": [pdf["recording"][0]], "node": [pdf["parent"][0]], **{c: [v] for c, v in one.items()}})

    def spreading(pdf: pd.DataFrame) -> pd.DataFrame:
        return spread(pdf.sort_values("node", ignore_index=True))

    up = F.floor(F.col("node") / FAN).alias("parent")
    levels = [cut(parts) if deepest >= FAN else parts]
    while deepest >= FAN:
        levels.append(cut(levels[-1].select("*", up).groupBy("recording", "parent").applyInPandas(folding, f"recording string, node bigint, {payload}")))
        deepest //= FAN
    columns = [c.strip().split(" ", 1) for c in state.split(", ")]
    out = None
    for level in reversed(levels):
        group = level.select("*", up)
        if out is None:
            group = group.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns])
        else:
            group = group.join(out.withColumnRenamed("node", "parent"), ["recording", "parent"])
        out = group.groupBy("recording", "parent").applyInPandas(spreading, f"recording string, node bigint, {state}")
    return out


def _with_first(blocks: DataFrame) -> DataFrame:
    """The blocks with the number of their session's first block, and their own from there."""
    first = blocks.groupBy("recording").agg(F.min("blk").alias("first"))
    return attach(blocks, first, ["recording"], ["blk"]).withColumn("node", F.col("blk") - F.col("first"))
