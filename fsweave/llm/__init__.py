"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps intermediate tables in the shared folder named by
``spark.checkpoint.dir`` and never relies on a machine-local path on executors.
"""
