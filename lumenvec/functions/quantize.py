"""8- and 16-bit scalar quantisation of weights, in single precision throughout."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"8bit": 8, "16bit": 16}


@dataclass(frozen=True)
class Quantizer:
    kind: str = "8bit"
    vmin: float = 0.0
    vmax: float = 1.0

    def __post_init__(self):
        if self.kind not in BITS:
            raise ValueError(f"unknown quantizer {self.kind}")
        if not (math.isfinite(self.vmin) and math.isfinite(self.vmax)) or self.vmax <= self.vmin:
            raise ValueError("vmin and vmax must be finite, vmax above vmin")

    @property
    def top(self) -> int:
        return (1 << BITS[self.kind]) - 1

    @property
    def bytes_per_value(self) -> int:
        return BITS[self.kind] // 8

    @property
    def column(self) -> str:
        """The narrowest column that holds every code: codes have no sign."""
        return "smallint" if self.kind == "8bit" else "int"

    def encode(self, weight: Column) -> Column:
        """The code; Spark's float / float is double, so the scale is worked out here in single precision."""
        scale = float(np.float32(self.top) / (np.float32(self.vmax) - np.float32(self.vmin)))
        x = (weight.cast("float") - F.lit(float(np.float32(self.vmin))).cast("float")) * F.lit(scale).cast("float")
        return F.round(F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(float(self.top)).cast("float"), x))).cast("int")

    def decode(self, code: Column) -> Column:
        return F.lit(self.vmin) + code.cast("double") * F.lit((self.vmax - self.vmin) / self.top)

    def decode_dot(self, score: Column, query: Quantizer) -> Column:
        """A sum of products of codes as a sum of products of weights; vmin plays no part."""
        return score.cast("double") * F.lit((self.vmax - self.vmin) * (query.vmax - query.vmin) / self.top**2)

    def for_query(self, vmin: float | None = None, vmax: float | None = None) -> Quantizer:
        """This kind over the query's own range."""
        return Quantizer(self.kind, self.vmin if vmin is None else vmin, self.vmax if vmax is None else vmax)
