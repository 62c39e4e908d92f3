"""Daily value series to dated, confidence-gated direction signals, on Spark.

Everything is ``DataFrame -> DataFrame``:

* ``sources``    landed payloads, partitioned tables, run outputs
* ``functions``  column expressions (ids, labels, policies, calendar, numerics)
* ``operators``  features, quality, metrics, sweeps, models, serving, subscribers
* ``streaming``  incremental file streams (upsert, quota)
* ``plans``      the query registry used by ``__spark_entry__`` and ``bench.py``
"""

__version__ = "0.1.0"
