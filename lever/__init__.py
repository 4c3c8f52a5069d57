"""lever — which columns of a time-bucketed measurement table move a target, and where.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built on Spark SQL.  Operators take an optional ``keys`` list
so one job handles every machine at once.
"""

from lever.schema import SeriesSchema

__all__ = ["SeriesSchema"]
