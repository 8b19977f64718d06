"""tessera: answer-metric analytics on Spark.

* ``tessera.functions`` -- Column expressions: hashed draws, the step data
  model and JSON codecs, token/sequence metrics and their registry.
* ``tessera.operators`` -- DataFrame operators: word grouping, prompt
  segments, prefix tables and ranking, reports, QA-set construction,
  sampling, prompts and scorers, perturbation, filters, training.
* ``tessera.sources`` -- parquet tables and the reference's file formats.
* ``tessera.plans`` -- fixtures built from the shared tables, the registered
  queries and their DuckDB oracle SQL.
* ``tessera.streaming`` -- the row-local metrics over a file stream.
"""

__version__ = "0.1.0"
