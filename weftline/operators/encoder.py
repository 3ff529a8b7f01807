"""Inference with transformer encoders in numpy, batch by batch inside Arrow tasks.

Two forms: absolute positions with token types, as in BERT, and shared relative-position biases, as in MPNet.  Weights
are made from named tensors, in the public naming of such checkpoints (``files.read_safetensors`` reads them), or seeded
at random with the same parts.  An optional head maps the pooled vectors to another width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Affine(NamedTuple):
    """x @ weight + bias."""

    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


class Norm(NamedTuple):
    """Layer normalisation with gain and bias."""

    gain: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + eps) * self.gain + self.bias


class Layer(NamedTuple):
    query: Affine
    key: Affine
    value: Affine
    out: Affine
    after_attention: Norm
    up: Affine
    down: Affine
    after_feed: Norm


class Weights(NamedTuple):
    tokens: np.ndarray
    places: np.ndarray
    kinds: np.ndarray | None  # token types; the first is used
    start: Norm
    layers: list[Layer]
    heads: int
    relative: np.ndarray | None = None  # [bucket, head]: biases by relative position
    head: Affine | None = None
    exact_gelu: bool = False
    first_place: int = 0  # place of the first token: 2 where padding takes up the first two

    @staticmethod
    def random(vocab: int, width: int, layers: int, heads: int, longest: int = 512, seed: int = 0, out: int | None = None, buckets: int | None = None) -> Weights:
        rng = np.random.default_rng(seed)
        m = lambda *s: (rng.normal(size=s) * 0.02).astype(np.float32)
        lin = lambda a, b: Affine(m(a, b), m(b))
        nrm = lambda: Norm(1 + m(width), m(width))
        one = lambda: Layer(lin(width, width), lin(width, width), lin(width, width), lin(width, width), nrm(), lin(width, 4 * width), lin(4 * width, width), nrm())
        return Weights(m(vocab, width), m(longest + 2, width), None if buckets else m(2, width), nrm(), [one() for _ in range(layers)], heads, m(buckets, heads) if buckets else None, lin(width, out) if out else None, bool(buckets), 2 if buckets else 0)

    @staticmethod
    def from_tensors(t: Mapping[str, np.ndarray], heads: int, head: str | None = None) -> Weights:
        """Weights from tensors by name; ``head`` names a dense layer put after pooling.

        Both public namings are known: ``attention.self.query`` and ``attention.attn.q`` for the parts of a layer."""
        get = lambda n: np.asarray(t[n], np.float32)
        lin = lambda n: Affine(get(n + ".weight").T, get(n + ".bias"))
        nrm = lambda n: Norm(get(n + ".weight"), get(n + ".bias"))
        mpnet = "encoder.relative_attention_bias.weight" in t
        layers, i = [], 0
        while f"encoder.layer.{i}.intermediate.dense.weight" in t:
            p = f"encoder.layer.{i}."
            q, k, v, o = ("attention.attn.q", "attention.attn.k", "attention.attn.v", "attention.attn.o") if mpnet else ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense")
            layers.append(Layer(lin(p + q), lin(p + k), lin(p + v), lin(p + o), nrm(p + ("attention.LayerNorm" if mpnet else "attention.output.LayerNorm")), lin(p + "intermediate.dense"), lin(p + "output.dense"), nrm(p + "output.LayerNorm")))
            i += 1
        kinds = get("embeddings.token_type_embeddings.weight") if "embeddings.token_type_embeddings.weight" in t else None
        relative = get("encoder.relative_attention_bias.weight") if mpnet else None
        return Weights(get("embeddings.word_embeddings.weight"), get("embeddings.position_embeddings.weight"), kinds, nrm("embeddings.LayerNorm"), layers, heads, relative, lin(head) if head else None, mpnet, 2 if mpnet else 0)

    @property
    def width(self) -> int:
        return self.head.weight.shape[1] if self.head else self.tokens.shape[1]


def relative_buckets(length: int, buckets: int = 32, farthest: int = 128) -> np.ndarray:
    """[from, to]: the bucket of each relative position.  One half of the buckets is for what follows; of a half, one
    half are single distances, the others grow with the logarithm up to ``farthest`` and beyond."""
    half = buckets // 2
    single = half // 2
    step = np.arange(length) - np.arange(length)[:, None]
    far = np.abs(step)
    with np.errstate(divide="ignore"):
        grown = single + np.floor(np.log(far / single) / math.log(farthest / single) * (half - single))
    return (np.where(far < single, far, np.minimum(grown, half - 1)) + half * (step > 0)).astype(int)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1.5e-7, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    u = 1 / (1 + 0.3275911 * np.abs(x))
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray, exact: bool) -> np.ndarray:
    inner = _erf(x / math.sqrt(2)) if exact else np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3))
    return x * (1 + inner) / 2


def _attend(w: Weights, layer: Layer, x: np.ndarray, bias: np.ndarray) -> np.ndarray:
    parts = x.shape[:-1] + (w.heads, x.shape[-1] // w.heads)
    q, k, v = (f(x).reshape(parts) for f in (layer.query, layer.key, layer.value))
    score = np.einsum("nqhd,nkhd->nhqk", q, k, optimize=True) / math.sqrt(parts[-1]) + bias
    share = np.exp(score - score.max(-1, keepdims=True))
    share /= share.sum(-1, keepdims=True)
    return layer.out(np.einsum("nhqk,nkhd->nqhd", share, v, optimize=True).reshape(x.shape))


def forward(w: Weights, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the last layer's token vectors, through the head if there is one, unit length."""
    length = ids.shape[1]
    x = w.tokens[ids] + w.places[w.first_place : w.first_place + length]
    if w.kinds is not None:
        x = x + w.kinds[0]
    x = w.start(x)
    bias = np.where(mask, 0.0, -1e9)[:, None, None, :]
    if w.relative is not None:
        bias = bias + w.relative[relative_buckets(length, len(w.relative))].transpose(2, 0, 1)
    for layer in w.layers:
        x = layer.after_attention(x + _attend(w, layer, x, bias))
        x = layer.after_feed(x + layer.down(gelu(layer.up(x), w.exact_gelu)))
    pooled = np.einsum("nld,nl->nd", x, mask.astype(x.dtype)) / np.maximum(mask.sum(1, keepdims=True), 1)
    pooled = w.head(pooled) if w.head else pooled
    return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)


def encode_ids(df: DataFrame, keys: list[str], weights: Weights, budget: int = 8192) -> DataFrame:
    """(keys..., v) for rows with piece ids: rows are sorted by length and batched under a budget of padded tokens."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            off, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            size = np.diff(off)
            out = np.zeros((b.num_rows, shared.value.width), np.float32)
            for rows in _batches(size, budget):
                place = np.arange(max(int(size[rows].max()), 1))
                mask = place < size[rows][:, None]
                ids = np.where(mask, flat[np.minimum(off[rows][:, None] + place, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
                out[rows] = forward(shared.value, ids, mask)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(list(out), pa.list_(pa.float32()))], names=[*keys, "v"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", v array<float>"
    return df.select(*keys, "ids").mapInArrow(run, schema)


def _batches(size: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Rows in order of length, as many at once as the padded budget allows, one at least."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # the longest row of a batch is its last one
        fits = size[order[at:]] * np.arange(1, len(order) - at + 1) <= budget
        n = len(fits) if fits.all() else max(int(fits.argmin()), 1)
        yield order[at : at + n]
        at += n
