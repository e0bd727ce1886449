"""Domain category and process stage of a variable, by its name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CategoryRule:
    """Names holding a needle get ``code``; ``stage`` overrides the stage rules."""

    code: str
    needles: tuple[str, ...]
    stage: str | None = None


@dataclass(frozen=True)
class StageRule:
    stage: str
    needles: tuple[str, ...]


# Labels and needles, tried in this order on the lower-cased name.
CATEGORY_LABELS = {
    "sin_medicion": "Variables sin medición (inhabilitadas o nulas)",
    "control_elementos": "Variables Control de Elementos (motores, válvulas, actuadores)",
    "valor_fijo": "Variables de valor fijo (constantes / varianza cero)",
    "criterio_experto": "Variables Criterio Experto (calidad de pulpa: Kappa, Brillo, pH)",
    "medicion_continua": "Variables con Medición Continua (temperaturas, flujos, presiones, consistencias)",
}
DEFAULT_CATEGORY = "medicion_continua"
DEFAULT_STAGE = "General"

CATEGORY_RULES = (
    CategoryRule("sin_medicion", ("ce05_ip21_547fi1019", "unnamed"), "Inhabilitado"),
    CategoryRule("valor_fijo", ("agua de lavado", "cumple"), "Auxiliar"),
    CategoryRule("control_elementos", ("torque", "motor", "lic", "nic", "wic", "control cs")),
    CategoryRule("criterio_experto", ("kappa", "brillo", "blancura", "ph")),
)
STAGE_RULES = (
    StageRule("Pre-Blanqueo", ("pre-blanq", "preblanq", "pre blanq")),
    StageRule("Etapa D0", (" d0", "_d0", "etapa d0", "etapa do")),
    StageRule("Etapa EOP", ("eop", "e0p", "op stage", "op-reactor")),
    StageRule("Etapa D1", (" d1", "_d1", "etapa d1")),
    StageRule("Etapa D2 y Almacenamiento", (" d2", "_d2", "etapa d2")),
    StageRule("Planta Química / Global", ("total", "l1", "concentracion")),
)


def holds_any(name: Column, needles: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(name, F.lit(x)) for x in needles])


def first_match(branches: Sequence[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for condition, value in reversed(branches):
        out = F.when(condition, value).otherwise(out)
    return out


def classify(
    variables: DataFrame,
    tags: DataFrame | None = None,
    category_rules: Sequence[CategoryRule] = CATEGORY_RULES,
    stage_rules: Sequence[StageRule] = STAGE_RULES,
) -> DataFrame:
    """``variables(variable)`` with tag, category and stage.

    ``tags(variable, tag)`` has one row per variable; a variable without one
    gets an empty tag.
    """
    name = F.lower("variable")
    by_name = first_match([(holds_any(name, r.needles), F.lit(r.stage)) for r in stage_rules], F.lit(DEFAULT_STAGE))
    code = first_match([(holds_any(name, r.needles), F.lit(r.code)) for r in category_rules], F.lit(DEFAULT_CATEGORY))
    stage = first_match(
        [(holds_any(name, r.needles), F.lit(r.stage) if r.stage else by_name) for r in category_rules], by_name
    )
    label = first_match([(F.col("Categoria_Cod") == k, F.lit(v)) for k, v in CATEGORY_LABELS.items()], F.lit(None))
    tagged = variables.join(tags, "variable", "left") if tags is not None else variables.withColumn("tag", F.lit(""))
    return tagged.select("variable", "tag", code.alias("Categoria_Cod"), stage.alias("Etapa")).select(
        F.col("variable").alias("Variable"),
        F.coalesce("tag", F.lit("")).alias("Tag"),
        label.alias("Categoria"),
        "Categoria_Cod",
        "Etapa",
    )


def category_counts(classified: DataFrame) -> DataFrame:
    """Variables per category, most frequent first."""
    return classified.groupBy("Categoria", "Categoria_Cod").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "Categoria_Cod"
    )
