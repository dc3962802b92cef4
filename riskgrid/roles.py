"""Column roles: which columns of a table are key, label, features and group."""

from __future__ import annotations

from dataclasses import dataclass

# Documented covariate names of the study table.
CLIMATE_COVARIATES = tuple(f"Bio_{i:02d}" for i in range(1, 20))
OTHER_COVARIATES = (
    "VD",
    "Rice",
    "Pigs",
    "DG_000_014bt_dens",
    "Adjusted_Pop_Count_2015",
    "UR",
    "Elv",
)


@dataclass(frozen=True)
class Roles:
    """Roles of the columns of one pixel table."""

    key: tuple[str, ...] = ("x", "y")
    label: str = "FOI"
    climate: tuple[str, ...] = CLIMATE_COVARIATES
    other: tuple[str, ...] = OTHER_COVARIATES
    category: tuple[str, ...] = ("UR",)
    group: str = "grid_id"

    def features(self, kind: str = "full") -> tuple[str, ...]:
        """Feature names: ``full`` is every covariate, ``climate`` the climate ones only."""
        if kind == "full":
            return self.climate + self.other
        if kind == "climate":
            return self.climate
        raise ValueError(f"unknown feature set {kind!r}; use 'full' or 'climate'")


STUDY = Roles()
