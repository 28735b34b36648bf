"""Trading-cost models; each turns Columns of traded value into a Column of cost."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F


class CostModel(ABC):
    @abstractmethod
    def cost(self, value: Column, adv: Column | None = None, volatility: Column | None = None) -> Column:
        """Cost of trading ``value`` (its sign does not matter)."""

    @abstractmethod
    def describe(self) -> str: ...


class FixedCost(CostModel):
    """A commission in basis points."""

    label = "fixed"

    def __init__(self, bps: float):
        if bps < 0:
            raise ValueError("basis points must not be negative")
        self.bps = bps

    def cost(self, value: Column, adv: Column | None = None, volatility: Column | None = None) -> Column:
        return F.abs(value) * F.lit(self.bps / 1e4)

    def describe(self) -> str:
        return f"{self.label} {self.bps:g} bps"


class SpreadCost(FixedCost):
    """Half a bid-ask spread in basis points."""

    label = "spread"


class SqrtImpactCost(CostModel):
    """Square-root impact; nothing where the daily volume is not positive."""

    def __init__(self, eta: float = 0.1, volatility: float = 0.02, adv: float = 5e7):
        self.eta, self.volatility, self.adv = eta, volatility, adv

    def cost(self, value: Column, adv: Column | None = None, volatility: Column | None = None) -> Column:
        volume = F.lit(self.adv) if adv is None else adv
        sigma = F.lit(self.volatility) if volatility is None else volatility
        size = F.abs(value)
        return F.when(volume > 0, size * F.lit(self.eta) * sigma * F.sqrt(size / F.nullif(volume, F.lit(0.0)))).otherwise(0.0)

    def describe(self) -> str:
        return f"square-root impact eta={self.eta:g}"


class CompositeCost(CostModel):
    def __init__(self, models: list[CostModel]):
        if not models:
            raise ValueError("no cost models")
        self.models = models

    def cost(self, value: Column, adv: Column | None = None, volatility: Column | None = None) -> Column:
        total = self.models[0].cost(value, adv, volatility)
        for model in self.models[1:]:
            total = total + model.cost(value, adv, volatility)
        return total

    def describe(self) -> str:
        return " + ".join(m.describe() for m in self.models)
