"""The daily plan: messy inputs to cleaned leads, signals, scores and assignment.

A stage is built from earlier stages. Stages that several others read are written once to the
shared folder as Parquet and read back, so later plans start from a table: short lineage, column
pruning, and nothing to recompute when an executor is lost.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import chat
from leadloom.operators import assignment, catalogue, consolidate, entities, extraction, quality, scoring, standardize
from leadloom.operators.quality import CHATS_FILE, log_of, problem
from leadloom.sources.tables import ExtractionStore, materialize


def stage(builder: Callable[[Daily], DataFrame]) -> property:
    """A property that builds its table once and, when the plan materialises, writes it."""
    name = builder.__name__

    def get(self: Daily) -> DataFrame:
        if name not in self._stages:
            df = builder(self)
            self._stages[name] = materialize(df, name) if self.materialized else df
        return self._stages[name]

    prop = property(get, doc=builder.__doc__)
    BUILDERS[name] = builder
    return prop


def view(builder: Callable[[Daily], DataFrame]) -> property:
    """A property over written stages that is only a projection or filter of them: never written."""
    BUILDERS[builder.__name__] = builder
    return property(builder, doc=builder.__doc__)


BUILDERS: dict[str, Callable[[Daily], DataFrame]] = {}
AFTER_EXTRACTION = ("extraction", "unsupported", "checked", "placed", "signals", "signals_table", "scores", "assignment", "quality_log")


class Daily:
    """Stages over `inputs`: an object with leads(), catalogue(), advisors(), history(), chats() and messages()."""

    def __init__(self, inputs, window=fixed.WINDOW, days: int = fixed.LIST_DAYS, day: str | None = None,
                 materialized: bool = False) -> None:
        self.inputs, self.window, self.days, self.day = inputs, window, days, day
        self.materialized = materialized
        self._stages: dict[str, DataFrame] = {}
        self.extraction_counts: dict[str, int] = {}
        self.extractor = self.rules

    def with_extraction(self, store: ExtractionStore, primary: extraction.Extractor, batch: str, fallback: extraction.Extractor | None = None) -> Daily:
        """The same plan with chats extracted through a store: stages before the extraction are shared, the extraction
        and what follows it are built anew. `extraction_counts` says how much was computed."""
        other = copy.copy(self)
        found, other.extraction_counts = extraction.through_store(self.chats, self.messages, store, primary, fallback or self.rules, batch)
        other._stages = {k: v for k, v in self._stages.items() if k not in AFTER_EXTRACTION} | {"extraction": materialize(found, "extraction")}
        other.extractor = primary
        return other

    @property
    def rules(self) -> extraction.Extractor:
        return extraction.Extractor(fixed.RULES_NAME, fixed.RULES_VERSION, lambda chats, messages: extraction.rule_extraction(chats, messages, self.brands))

    def build(self, name: str) -> DataFrame:
        """The plan of one stage over its (possibly written) inputs."""
        return BUILDERS[name](self)

    @stage
    def measured(self) -> DataFrame:
        """Raw leads with every normalised value and the repeat mark; leads, log and profiles are projections."""
        return standardize.measure_all(self.inputs.leads(), self.window)

    @view
    def raw_leads(self) -> DataFrame:
        return self.measured.select(*fixed.REQUIRED["leads"], "orden_archivo")

    @view
    def clean_leads(self) -> DataFrame:
        return standardize.clean_leads(self.measured)

    @view
    def lead_log(self) -> DataFrame:
        return standardize.lead_log(self.measured)

    @cached_property
    def raw_catalogue(self) -> DataFrame:
        return self.inputs.catalogue()

    @stage
    def catalogue(self) -> DataFrame:
        return standardize.standardize_catalogue(self.raw_catalogue)

    @stage
    def availability(self) -> DataFrame:
        return catalogue.availability(self.raw_catalogue)

    @stage
    def advisors(self) -> DataFrame:
        return standardize.standardize_advisors(self.inputs.advisors())

    @stage
    def history(self) -> DataFrame:
        return standardize.standardize_history(self.inputs.history())

    @cached_property
    def brands(self) -> Column:
        """Mention pattern of the catalogue's brands."""
        return chat.brand_pattern(self.catalogue)

    @stage
    def matched(self) -> DataFrame:
        """Clean leads with the catalogue row, the rule and the availability."""
        return catalogue.assign_models(self.clean_leads, self.catalogue, self.availability)

    @property
    def model_log(self) -> DataFrame:
        return catalogue.model_log(self.matched)

    @stage
    def clients(self) -> DataFrame:
        return entities.clients(entities.with_client_key(self.clean_leads))

    @stage
    def leads(self) -> DataFrame:
        """Matched leads with client key and principal mark."""
        return entities.with_principal(entities.with_client_key(self.matched), self.clients)

    @view
    def keyed_leads(self) -> DataFrame:
        """Clean leads with client key and principal mark, for what needs no model. Its readers take few columns or
        few rows, so a written copy of all would cost more than the marks."""
        return entities.with_principal(entities.with_client_key(self.clean_leads), self.clients)

    @stage
    def collision_log(self) -> DataFrame:
        return entities.collisions(entities.with_client_key(self.clean_leads))

    @stage
    def chats(self) -> DataFrame:
        return standardize.with_start(self.inputs.chats(), self.window)

    @cached_property
    def messages(self) -> DataFrame:
        return self.inputs.messages()

    @stage
    def extraction(self) -> DataFrame:
        return extraction.rule_extraction(self.chats, self.messages, self.brands)

    @stage
    def unsupported(self) -> DataFrame:
        return extraction.unsupported(self.extraction, self.messages)

    @stage
    def checked(self) -> DataFrame:
        """Extractions after price validation, with `sin_respaldo` fields returned to unknown."""
        models = catalogue.match_texts(self.extraction, "modelo_texto", self.catalogue).select("modelo_texto", F.col("sku").alias("sku_extraido"))
        prices = self.catalogue.select(F.col("sku").alias("sku_extraido"), F.col("precio_lista").alias("precio_modelo"))
        missing = self.unsupported.groupBy("conversacion_id").agg(F.array_sort(F.collect_set("campo")).alias("sin_respaldo"))
        df = self.extraction.join(models, "modelo_texto", "left").join(prices, "sku_extraido", "left")
        df = extraction.validate(df, F.col("precio_modelo")).join(missing, "conversacion_id", "left")
        df = df.withColumn("sin_respaldo", F.coalesce("sin_respaldo", F.array().cast("array<string>")))
        return extraction.as_unknown(df, F.col("sin_respaldo"))

    @stage
    def placed(self) -> DataFrame:
        """Checked extractions on the principal lead of their client."""
        return consolidate.chats_on_principal(self.checked, self.chats, entities.with_client_key(self.clean_leads), self.clients)

    @stage
    def signals(self) -> DataFrame:
        return consolidate.consolidate(self.placed)

    @property
    def cutoff(self) -> DataFrame:
        return scoring.cutoff(self.clean_leads, self.day)

    @stage
    def scores(self) -> DataFrame:
        return scoring.score(self.leads, self.signals, self.catalogue.select("sku", "precio_lista"), self.cutoff, self.days)

    @stage
    def assignment(self) -> DataFrame:
        return assignment.assign(self.scores, self.advisors)

    @property
    def chat_log(self) -> DataFrame:
        """Problems of the extraction stage: corrected amounts and quotes without support."""
        tenants = self.clean_leads.select("lead_id", "empresa_id")
        owned = self.chats.select("conversacion_id", "lead_id").join(tenants, "lead_id", "left").select("conversacion_id", "empresa_id")
        fixes = self.checked.select("conversacion_id", "cuota_original", "correcciones").join(owned, "conversacion_id", "left")
        fix_log = fixes.withColumn("tipo", F.explode("correcciones"))
        quotes = self.unsupported.join(owned, "conversacion_id", "left")
        return quality.union_logs(
            log_of(fix_log, CHATS_FILE, F.col("conversacion_id"), F.col("empresa_id"), [
                problem(F.lit(True), "cuota_inicial_cop", F.col("tipo"), F.col("cuota_original"), "valor corregido por la validación")]),
            log_of(quotes, CHATS_FILE, F.col("conversacion_id"), F.col("empresa_id"), [
                problem(F.lit(True), F.concat(F.lit("evidencia."), F.col("campo")), "evidencia_sin_respaldo", F.col("fragmento"), "se toma como desconocido y no se cita")]),
        )

    @stage
    def quality_log(self) -> DataFrame:
        return quality.union_logs(
            self.lead_log, self.model_log, self.collision_log,
            standardize.check_chats(self.chats, self.clean_leads), self.chat_log,
        )
