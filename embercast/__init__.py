"""embercast: daily environmental-hazard analytics as Spark DataFrame operators.

Every public operator takes a DataFrame (plus column names and parameters) and
returns a DataFrame, so jobs are plain ``df.transform(...)`` chains that Catalyst
optimises as one plan.
"""

__version__ = "0.1.0"
