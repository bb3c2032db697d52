"""``QualityChecker``: the original application's object interface over Spark.

The method names are those of the original checker, so existing rule code
and rule JSON keep working.  The difference is that expectations are
*collected*, not executed one by one: ``get_results()`` compiles all of
them into one scan (``operators.rules.evaluate``), and every result is a
DataFrame.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from ..operators import profile as PR
from ..operators import rules as R
from ..operators import similarity as SM
from . import snapshot as SN
from ..sources import sinks as SK


class QualityChecker:
    def __init__(self, df: DataFrame, dataset_name: str = "Unknown Dataset",
                 critical_columns: list[str] | None = None):
        self.df = df
        self.dataset_name = dataset_name
        self.user_specified_critical_columns = list(critical_columns or [])
        self.rules: list[R.Rule] = []
        self.similarities: list[tuple[str, str, float]] = []

    # ---- dataset / critical columns --------------------------------------
    def set_dataset_name(self, dataset_name: str) -> None:
        self.dataset_name = dataset_name

    def get_dataset_name(self) -> str:
        return self.dataset_name

    def set_critical_columns(self, critical_columns: list[str] | None) -> None:
        self.user_specified_critical_columns = list(critical_columns or [])

    def get_critical_columns(self) -> list[str]:
        return list(self.user_specified_critical_columns)

    def add_critical_column(self, column_name: str) -> None:
        if column_name not in self.user_specified_critical_columns:
            self.user_specified_critical_columns.append(column_name)

    def remove_critical_column(self, column_name: str) -> None:
        if column_name in self.user_specified_critical_columns:
            self.user_specified_critical_columns.remove(column_name)

    # ---- expectations (collected; evaluated together) --------------------
    def add_rule(self, rule: R.Rule) -> "QualityChecker":
        self.rules.append(rule)
        return self

    def run_rules_from_json(self, rules) -> "QualityChecker":
        for r in R.rules_from_json(rules):
            self.add_rule(r)
        return self

    # ---- results ----------------------------------------------------------
    def get_results(self) -> DataFrame:
        """All rule results (S10) plus one row per similarity analysis (L6),
        in the order the checks were added.  The rules run in one scan."""
        parts = []
        if self.rules:
            parts.append(R.evaluate(self.df, self.rules).drop("details"))
        for j, (c1, c2, t) in enumerate(self.similarities):
            summ = SM.summary(self.df, c1, c2, t)
            parts.append(SM.as_rule_result(summ, seq=len(self.rules) + j, threshold=t))
        if not parts:
            return self.df.sparkSession.createDataFrame(
                [], "seq int, column string, rule string, total long, passed long, failed long, "
                    "success_rate double")
        return functools.reduce(DataFrame.unionByName, parts)

    def analyze_column_similarity_levenshtein(self, column1: str, column2: str,
                                              similarity_threshold: float = 0.8) -> DataFrame:
        """Returns the one-row summary and records the analysis."""
        self.similarities.append((column1, column2, similarity_threshold))
        return SM.summary(self.df, column1, column2, similarity_threshold)

    def get_similarity_summary_table(self, similarity_threshold: float = 0.8) -> DataFrame:
        """L7 (the threshold argument is accepted and unused, as originally)."""
        _ = similarity_threshold
        if not self.similarities:
            return self.get_results().limit(0)
        summaries = functools.reduce(DataFrame.unionByName, [
            SM.summary(self.df, a, b, t) for a, b, t in self.similarities])
        return SM.summary_table(self.get_results(), summaries)

    def get_detailed_similarity_comparisons(self, column1: str, column2: str,
                                            min_similarity: float = 0.0,
                                            max_similarity: float = 1.0,
                                            key: str | None = None) -> DataFrame:
        """Per-row comparisons within the similarity band (3 dp)."""
        threshold = next((t for a, b, t in self.similarities if (a, b) == (column1, column2)), 0.8)
        det = SM.comparisons(self.df, column1, column2, threshold, key=key, min_similarity=min_similarity)
        return SM.filter_band(det, min_similarity, max_similarity)

    def get_comprehensive_results(self, title: str = "Data Quality Report") -> DataFrame:
        """The nested one-row snapshot."""
        return SN.comprehensive_snapshot(self.df, self.get_results(), title=title,
                                         dataset_name=self.dataset_name,
                                         critical_columns=self.user_specified_critical_columns)

    def save_comprehensive_results(self, path: str, title: str = "Data Quality Report",
                                   include_field_summary: bool = True,
                                   field_path: str | None = None) -> tuple[str, str | None]:
        """S12 (+ S13): append the flat snapshot, and the field summary to
        ``<path>_field_details`` unless another folder is given."""
        prof = PR.profile(self.df)
        snap = SN.comprehensive_snapshot(self.df, self.get_results(), title=title,
                                         dataset_name=self.dataset_name,
                                         critical_columns=self.user_specified_critical_columns,
                                         prof=prof)
        SK.append_history(SN.flatten_snapshot(snap), path)
        fpath = None
        if include_field_summary:
            fpath = field_path or f"{path.rstrip('/')}_field_details"
            SK.append_field_history(SN.field_summary(self.df, title, self.dataset_name, prof=prof),
                                    fpath)
        return path, fpath

    def save_field_summary(self, path: str, title: str = "Data Quality Report") -> str:
        """Append one row per column."""
        SK.append_field_history(SN.field_summary(self.df, title, self.dataset_name), path)
        return path

    def generate_data_docs(self, title: str = "Data Quality Report",
                           dataset_name: str | None = None) -> dict[str, DataFrame]:
        """The report's tables (no HTML): see ``plans.report.report_tables``."""
        from .report import report_tables
        tables = report_tables(self.df, self.get_results(), self.user_specified_critical_columns)
        tables["metadata"] = self.df.sparkSession.createDataFrame(
            [(title, dataset_name or self.dataset_name)], "title string, dataset_name string")
        return tables

    def tracking_entry(self, dataset_version: str = "v1.0", detailed: bool = True) -> DataFrame:
        """This run as one history entry (append it with
        ``operators.history.append_entry`` or a parquet append)."""
        from ..operators.history import tracking_entry
        return tracking_entry(self.df, self.get_results(), self.dataset_name, dataset_version,
                              detailed=detailed)


def _add_expectations() -> None:
    """Every rule constructor becomes a checker method of the same name."""
    for name, ctor in R.REGISTRY.items():
        def method(self, *args, _ctor=ctor, **kwargs):
            return self.add_rule(_ctor(*args, **kwargs))
        method.__name__ = name
        method.__doc__ = f"Collect ``{name}``; evaluated by ``get_results``."
        setattr(QualityChecker, name, method)


_add_expectations()
