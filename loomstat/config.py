"""Project settings. Every value here can be replaced through ``Settings(...)``."""

from __future__ import annotations

from dataclasses import dataclass

# The plant's own column names, limits and money figures.
PRIMARY_TARGET = "CONSUMO ESPECIFICO CLO2"
SECONDARY_TARGET = "Consumo Total ClO2"

LEAKAGE_COLUMNS = (
    "Consumo Total ClO2",
    "Consumo ClO2 Etapa D0 L1",
    "Consumo ClO2 Etapa D1 L1",
    "Consumo ClO2 Etapa D2 L1",
    "Consumo ClO2 L1",
    "Consumo ClO2 Etapa D0",
    "Consumo ClO2 Etapa D1",
    "Consumo ClO2 Etapa D2",
    "CONSUMO ESPECIFICO CLO2",
    "CUMPLE O  NO CUMPLE",
)

DISABLED_COLUMNS = (
    "Unnamed: 0",
    "Unnamed: 1",
    "CE05_IP21_547FI1019",
    "Flujo H2SO4 Etapa D0",
    "Agua de Lavado prensa preblanqueo",
    "CUMPLE O  NO CUMPLE",
)


@dataclass(frozen=True)
class Settings:
    """Knobs of a preparation / modelling run."""

    target: str = PRIMARY_TARGET
    secondary_target: str = SECONDARY_TARGET
    leakage: tuple[str, ...] = LEAKAGE_COLUMNS
    disabled: tuple[str, ...] = DISABLED_COLUMNS
    seed: int = 2022
    test_ratio: float = 0.20
    folds: int = 5
    std_tol: float = 1e-7
    max_features: int = 25
    tolerance: float = 0.0015
    design_limit: float = 17.5
    historical_mean: float = 19.10
    historical_max: float = 20.37
    annual_savings_usd: float = 1_600_000.0
    benefit_30pct_usd: float = 500_000.0
