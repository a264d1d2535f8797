"""Sparse 3-D convolution: rulebooks by coordinate equi-joins, evaluation and gradients by group-by sums.

site: (row, b, a0, a1, a2, features ARRAY<FLOAT>). rule: (offset, in_row, out_row). weight: (offset, cin, cout, w).
Offsets number kernel places with the last axis fastest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metric as m
from ..plans.order import cut, global_order
from .gather import collect_features

COORDS = ["b", "a0", "a1", "a2"]


def triple(value: int | Sequence[int], least: int = 1) -> tuple[int, int, int]:
    out = tuple(value) if isinstance(value, (list, tuple)) else (value,) * 3
    if len(out) != 3 or any(isinstance(v, bool) or not isinstance(v, int) or v < least for v in out):
        raise ValueError(f"expected an integer of {least} or more, or three")
    return out


def validate_sites(sites: DataFrame, shape: Sequence[int], batch_size: int) -> DataFrame:
    """The sites, if coordinates are unique and within the batch size and shape; raises otherwise."""
    inside = (F.col("b") >= 0) & (F.col("b") < batch_size)
    for i, s in enumerate(triple(shape)):
        inside = inside & (F.col(f"a{i}") >= 0) & (F.col(f"a{i}") < s)
    if sites.where(~inside).limit(1).count():
        raise ValueError("site out of bounds")
    if sites.groupBy(*COORDS).count().where("count > 1").limit(1).count():
        raise ValueError("duplicate site")
    return sites


def _offsets(spark: SparkSession, kernel: tuple[int, int, int]) -> Column:
    places = [F.struct(F.lit(k).alias("offset"), *[F.lit(v).alias(f"k{i}") for i, v in enumerate(p)]) for k, p in enumerate(product(*map(range, kernel)))]
    return F.array(*places)


def subm_rulebook(sites: DataFrame, kernel=3, dilation=1) -> DataFrame:
    """(offset, in_row, out_row): inputs at out + (k - K // 2) * dilation; odd kernels only."""
    kernel, dilation = triple(kernel), triple(dilation)
    if any(k % 2 == 0 for k in kernel):
        raise ValueError("submanifold kernels are odd")
    asked = sites.select(F.col("row").alias("out_row"), *COORDS, F.explode(_offsets(sites.sparkSession, kernel)).alias("o"))
    asked = asked.select("out_row", "b", F.col("o.offset").alias("offset"), *[(F.col(f"a{i}") + (F.col(f"o.k{i}") - kernel[i] // 2) * dilation[i]).alias(f"a{i}") for i in range(3)])
    return asked.join(sites.select(F.col("row").alias("in_row"), *COORDS), COORDS).select("offset", "in_row", "out_row")


def output_shape(shape, kernel=3, stride=1, padding=0, dilation=1) -> tuple[int, int, int]:
    s, k, t, p, d = triple(shape), triple(kernel), triple(stride), triple(padding, 0), triple(dilation)
    out = tuple((s[i] + 2 * p[i] - d[i] * (k[i] - 1) - 1) // t[i] + 1 for i in range(3))
    if min(out) < 1:
        raise ValueError("the output is empty")
    return out


def conv_rulebook(sites: DataFrame, shape, kernel=3, stride=1, padding=0, dilation=1) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """(outputs (row, b, a0, a1, a2), rules, output shape): every output some input reaches, numbered in order of coordinates."""
    out_shape = output_shape(shape, kernel, stride, padding, dilation)
    kernel, stride, padding, dilation = triple(kernel), triple(stride), triple(padding, 0), triple(dilation)
    reach = sites.select(F.col("row").alias("in_row"), *COORDS, F.explode(_offsets(sites.sparkSession, kernel)).alias("o"))
    ok = F.lit(True)
    for i in range(3):
        num = F.col(f"a{i}") + padding[i] - F.col(f"o.k{i}") * dilation[i]
        ok = ok & (F.pmod(num, F.lit(stride[i])) == 0) & (num >= 0) & (num < out_shape[i] * stride[i])
    reach = reach.where(ok).select("in_row", "b", F.col("o.offset").alias("offset"), *[F.expr(f"cast((a{i} + {padding[i]} - o.k{i} * {dilation[i]}) div {stride[i]} as int)").alias(f"a{i}") for i in range(3)])
    outputs, _ = global_order(reach.select(*COORDS).distinct(), [F.col(c) for c in COORDS], "row")
    rules = reach.join(outputs.withColumnRenamed("row", "out_row"), COORDS).select("offset", "in_row", "out_row")
    return outputs.select("row", *COORDS), rules, out_shape


def inverse(rules: DataFrame) -> DataFrame:
    return rules.select("offset", F.col("out_row").alias("in_row"), F.col("in_row").alias("out_row"))


def channels_of(sites: DataFrame, row: str, column: str = "features") -> DataFrame:
    return sites.select(F.col("row").alias(row), F.posexplode(column).alias("c", "x"))


def evaluate(sites: DataFrame, rules: DataFrame, weights: DataFrame, outputs: DataFrame, out_channels: int, bias: Sequence[float] | None = None) -> DataFrame:
    """(row, features): bias plus the sum of x * w over the rules, in double precision; outputs without rules get the bias.

    Weights are a parameter of kernel * channels rows and join on (offset, cin).
    """
    x = channels_of(sites, "in_row").withColumnRenamed("c", "cin")
    terms = rules.join(x, "in_row").join(weights, ["offset", "cin"])
    y = terms.groupBy("out_row").agg(F.array(*[F.sum(F.when(F.col("cout") == c, F.col("x").cast("double") * F.col("w"))) for c in range(out_channels)]).alias("y"))
    base = F.array(*[F.lit(float(b)) for b in (bias or [0.0] * out_channels)])
    full = outputs.select("row").join(y.withColumnRenamed("out_row", "row"), "row", "left")
    value = F.zip_with(F.coalesce("y", F.array_repeat(F.lit(0.0), out_channels)), base, lambda a, b: (F.coalesce(a, F.lit(0.0)) + b).cast("float"))
    return full.select("row", value.alias("features"))


def gradients(sites: DataFrame, rules: DataFrame, weights: DataFrame, grad: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Input gradients (row, feat), weight gradients (offset, cin, cout, w) and bias gradients (cout, g) of grad (row, features)."""
    g = channels_of(grad, "out_row").toDF("out_row", "cout", "g")
    x = channels_of(sites, "in_row").toDF("in_row", "cin", "x")
    both = rules.join(g, "out_row")
    dx = both.join(weights, ["offset", "cout"]).withColumn("v", F.col("g").cast("double") * F.col("w"))
    dx = collect_features(dx.select(F.col("in_row").alias("row"), F.col("cin").alias("c"), "v"), ["row"], F.sum("v"))
    dw = both.join(x, "in_row").groupBy("offset", "cin", "cout").agg(F.sum(F.col("g").cast("double") * F.col("x")).cast("float").alias("w"))
    db = g.groupBy("cout").agg(F.sum(F.col("g").cast("double")).cast("float").alias("g"))
    return dx, dw, db


@dataclass(frozen=True)
class Mapping:
    """What an inverse convolution needs: the rules and the sites they came from."""

    sites: DataFrame
    rules: DataFrame
    outputs: DataFrame
    shape: tuple[int, int, int]
    out_shape: tuple[int, int, int]
    kernel: tuple[int, int, int]


@dataclass
class SparseConvTensor:
    """Sites with shape, batch size and the mappings that layers saved by key."""

    sites: DataFrame
    spatial_shape: tuple[int, int, int]
    batch_size: int
    mappings: dict[str, Mapping] = field(default_factory=dict)

    def replace_feature(self, features: DataFrame) -> SparseConvTensor:
        sites = self.sites.drop("features").join(features.select("row", "features"), "row")
        return SparseConvTensor(sites, self.spatial_shape, self.batch_size, self.mappings)

    def shadow_copy(self) -> SparseConvTensor:
        return SparseConvTensor(self.sites, self.spatial_shape, self.batch_size, self.mappings)

    def dense(self, channels: int) -> DataFrame:
        """(b, a0, a1, a2, features) of the whole grid, zeros at empty places."""
        spark = self.sites.sparkSession
        s = self.spatial_shape
        cells = spark.range(self.batch_size * s[0] * s[1] * s[2])
        grid = cells.selectExpr(f"cast(id div {s[0] * s[1] * s[2]} as int) b", f"cast((id div {s[1] * s[2]}) % {s[0]} as int) a0", f"cast((id div {s[2]}) % {s[1]} as int) a1", f"cast(id % {s[2]} as int) a2")
        return grid.join(self.sites.select(*COORDS, "features"), COORDS, "left").withColumn("features", F.coalesce("features", F.array_repeat(m.flit(0), channels)))


class Layer:
    """A convolution with weights (offset, cin, cout, w) and optional bias; call it on a tensor."""

    def __init__(self, weights: DataFrame, out_channels: int, kernel=3, stride=1, padding=0, dilation=1, bias: Sequence[float] | None = None, key: str | None = None):
        self.weights, self.out_channels, self.bias, self.key = weights, out_channels, bias, key
        self.kernel, self.stride, self.padding, self.dilation = triple(kernel), triple(stride), triple(padding, 0), triple(dilation)

    def _out(self, x: SparseConvTensor, sites: DataFrame, rules: DataFrame, outputs: DataFrame, shape) -> SparseConvTensor:
        y = evaluate(sites, rules, self.weights, outputs, self.out_channels, self.bias)
        return SparseConvTensor(outputs.select("row", *COORDS).join(y, "row"), shape, x.batch_size, x.mappings)


class SubMConv3d(Layer):
    """Outputs at the input sites. A saved key is reused by layers of equal kernel and dilation."""

    def __call__(self, x: SparseConvTensor) -> SparseConvTensor:
        if self.stride != (1, 1, 1):
            raise ValueError("submanifold convolutions have stride 1")
        saved = x.mappings.get(self.key) if self.key else None
        if saved and saved.kernel != self.kernel:
            raise ValueError("the key belongs to another kernel")
        rules = saved.rules if saved else cut(subm_rulebook(x.sites, self.kernel, self.dilation))
        if self.key and not saved:
            x.mappings[self.key] = Mapping(x.sites, rules, x.sites, x.spatial_shape, x.spatial_shape, self.kernel)
        return self._out(x, x.sites, rules, x.sites, x.spatial_shape)


class SparseConv3d(Layer):
    """Strided convolution; saves its mapping under its key for an inverse."""

    def __call__(self, x: SparseConvTensor) -> SparseConvTensor:
        outputs, rules, shape = conv_rulebook(x.sites, x.spatial_shape, self.kernel, self.stride, self.padding, self.dilation)
        outputs, rules = cut(outputs), cut(rules)
        if self.key:
            if self.key in x.mappings:
                raise ValueError("the key is taken")
            x.mappings[self.key] = Mapping(x.sites, rules, outputs, x.spatial_shape, shape, self.kernel)
        return self._out(x, x.sites, rules, outputs, shape)


class SparseInverseConv3d(Layer):
    """The saved mapping of its key run backwards: outputs at the original sites in their rows."""

    def __call__(self, x: SparseConvTensor) -> SparseConvTensor:
        if not self.key or self.key not in x.mappings:
            raise ValueError("no mapping is saved under the key")
        saved = x.mappings[self.key]
        if saved.out_shape != tuple(x.spatial_shape) or saved.kernel != self.kernel:
            raise ValueError("the tensor does not come from the saved mapping")
        return self._out(x, x.sites, inverse(saved.rules), saved.sites, saved.shape)


class SparseSequential:
    def __init__(self, *layers):
        self.layers = layers

    def __call__(self, x: SparseConvTensor) -> SparseConvTensor:
        for layer in self.layers:
            x = layer(x)
        return x
