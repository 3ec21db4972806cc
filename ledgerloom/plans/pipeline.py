"""The resolution pipeline over staged tables: every layer as a lazily built DataFrame.

Layers with several readers (names, universe, tiers, verdicts, suppliers: all of the size of the names, not of the lines)
are written once to the shared checkpoint folder and read from it, which keeps plans short and survives lost executors;
the others stay expressions, so that Catalyst prunes columns through them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import blank_to_null
from ledgerloom.operators import evidence, golden, reporting, row_roles, tiers
from ledgerloom.operators.components import cut
from ledgerloom.operators.skew import checked_join
from ledgerloom.plans.tables import table


class Pipeline:
    """Builds each layer from the tables of one folder.

    ``decide`` makes the two tables of recorded decisions (people's own, and delegated ones) of the candidates on offer;
    without it there are none, and no similar name is ever taken for a match.
    """

    def __init__(self, spark: SparkSession, folder: str, decide: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> None:
        self.spark, self.folder, self.decide = spark, folder, decide

    @cached_property
    def spend(self) -> DataFrame:
        """All staged lines with what each row is: totals, workbook sections and leftovers stay, but are no payments."""
        lines = table(self.spark, self.folder, "staging_spend").withColumn("expense_type_raw", blank_to_null(F.col("expense_type_src")))
        if "row_role" in lines.columns:
            return lines
        place = ["_source_file", "_row_num"]
        narrow = lines.select(*place, "supplier_name_raw", F.col("amount").cast("decimal(38,2)").alias("amount"), "expense_type_raw", F.coalesce("is_redacted", F.lit(False)).alias("is_redacted"))
        # rows other than payments are few: at most one a file, but for workbooks
        others = cut(row_roles.classify_rows(narrow).where("row_role <> 'transaction'").select(*place, F.col("row_role").alias("_role")))
        return checked_join(lines, others, place, "left").withColumn("row_role", F.coalesce("_role", F.lit("transaction"))).drop("_role")

    @cached_property
    def payments(self) -> DataFrame:
        return self.spend.where("row_role = 'transaction'")

    @cached_property
    def companies(self) -> DataFrame:
        return table(self.spark, self.folder, "staging_companies")

    @cached_property
    def contracts(self) -> DataFrame:
        return table(self.spark, self.folder, "staging_contracts")

    @cached_property
    def universe(self) -> DataFrame:
        return cut(tiers.company_universe(self.companies))

    @cached_property
    def names(self) -> DataFrame:
        return cut(tiers.name_universe(self.payments, self.contracts))

    @cached_property
    def t1(self) -> DataFrame:
        return cut(tiers.tier1(self.names, self.contracts, self.universe))

    @cached_property
    def t2(self) -> DataFrame:
        return cut(tiers.tier2(self.names, self.universe))

    @cached_property
    def t3(self) -> DataFrame:
        return cut(tiers.tier3(self.names, self.universe))

    @cached_property
    def t4_candidates(self) -> DataFrame:
        return cut(tiers.tier4_candidates(self.names, self.t2, self.t3, self.universe))

    @cached_property
    def t4(self) -> DataFrame:
        return cut(tiers.tier4_best(self.t4_candidates))

    @cached_property
    def previous_names(self) -> DataFrame:
        return evidence.previous_name_windows(table(self.spark, self.folder, "resolved_company_previous_names"), self.universe)

    @cached_property
    def previous_evidence(self) -> DataFrame:
        return cut(evidence.previous_name_evidence(self.payments, self.t4, self.t1, self.previous_names))

    @cached_property
    def award_evidence(self) -> DataFrame:
        return cut(evidence.other_buyer_evidence(self.t4, self.contracts))

    @cached_property
    def decision_tables(self) -> tuple[DataFrame, DataFrame]:
        if self.decide:
            return self.decide(self.t4)
        none = self.spark.createDataFrame([], golden.DECISION_SCHEMA)
        return none.drop("evidence_class"), none

    @cached_property
    def decisions(self) -> DataFrame:
        return cut(evidence.decisions_in_force(*self.decision_tables))

    @cached_property
    def matches(self) -> DataFrame:
        return cut(golden.assemble_matches(self.payments, self.t1, self.t2, self.t3, self.t4, self.decisions))

    @cached_property
    def golden(self) -> DataFrame:
        return cut(golden.golden_record(self.payments, self.matches, self.companies))

    @cached_property
    def resolved(self) -> DataFrame:
        return golden.resolve_spend(self.spend, self.matches)

    @cached_property
    def queue(self) -> DataFrame:
        return golden.review_queue(self.payments, self.matches, self.t1, self.companies, self.decisions, self.previous_evidence, self.award_evidence)

    @cached_property
    def suppliers(self) -> DataFrame:
        return cut(reporting.dim_supplier(self.golden, self.matches))

    @cached_property
    def facts(self) -> tuple[DataFrame, DataFrame]:
        return reporting.facts(self.resolved, self.suppliers, self.matches)

    @cached_property
    def files(self) -> DataFrame:
        return reporting.numbered(self.payments.groupBy("_source_file").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("transaction_rows")), "_source_file", "source_file_id")
