"""wavecohort: cohort selection, irregular measurement series and risk scoring on Spark.

Every public operator takes DataFrames and returns a DataFrame (a lazy plan);
actions happen only in the few places that must fit a model or iterate.
"""

__version__ = "0.1.0"
