"""dqforge: data-quality checks, profiles and history as Spark jobs.

Packages:

* ``functions`` -- column expressions and small distributed helpers
  (predicates and null policies, regex dialect, bands, exact quantiles);
* ``operators`` -- rule compiler, row flags, duplicates, profile,
  approximate profile, scores, similarity, history;
* ``sources`` -- parquet tables, CSV/text inputs, sinks, generator;
* ``plans`` -- composed plans (scorecard, snapshot, report, checker, SQL
  demo) and the registered queries;
* ``streaming`` -- running scorecard and per-batch monitor.
"""

__version__ = "0.1.0"
