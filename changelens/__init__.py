"""changelens: commit-history analytics as Spark DataFrame transforms.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for the helpers in :mod:`changelens.functions`).  Nothing is
collected to the driver; wide text is hashed early and attached last.
"""

__version__ = "0.1.0"
