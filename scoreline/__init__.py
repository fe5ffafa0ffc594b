"""scoreline: contest and market analytics expressed as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` with the column names
passed as arguments, so the same code serves any two-sided contest or any
per-entity time series.  Subpackages:

- ``sources``   declared schemas, loaders, fixture views, landing and payloads
- ``functions`` column expressions (odds arithmetic, cleaning, formatting)
- ``operators`` relational building blocks (pairing, windows, rollups, ratings, prices)
- ``plans``     multi-operator plans (feature frame, model, metrics, board)
- ``streaming`` Structured Streaming versions of the odds-snapshot operators
"""

from scoreline.session import get_spark  # noqa: F401
