"""Web-session analytics and conversion scoring as Spark DataFrame jobs.

Subpackages:

* ``sources``   - the sharded session table (read, export from the test tables)
                  and the partitioned prediction sink.
* ``functions`` - reusable column expressions (defaults, rates, dates,
                  derived features, the stable hash sample).
* ``operators`` - exploration queries, descriptive reports, metric tables,
                  visitor history, feature sets, model evaluation.
* ``plans``     - multi-step jobs: model training / scoring, publishing,
                  and the catalogue of registered queries.
"""

__version__ = "0.1.0"
