"""Canonical table bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class MarketTables:
    orders: DataFrame
    customers: DataFrame
    items: DataFrame
    products: DataFrame
    translations: DataFrame
    sellers: DataFrame
    reviews: DataFrame
    # Reporting regions (the map layer's region list); here: all customer states.
    regions: DataFrame | None = None
    # Geolocation rows, if the inputs have them.
    geo: DataFrame | None = None
    # Lines of orders too large for one bucket, where the ingest set them apart; ``items`` holds them too,
    # ``bucketed_items`` the others.
    hot_items: DataFrame | None = None
    bucketed_items: DataFrame | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        named = {
            "orders": self.orders, "customers": self.customers, "items": self.items,
            "products": self.products, "translations": self.translations,
            "sellers": self.sellers, "reviews": self.reviews,
        }
        return named if self.geo is None else named | {"geo": self.geo}
