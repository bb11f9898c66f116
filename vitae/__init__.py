"""vitae: resume and job matching as Spark jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame jobs), ``sources`` (readers, writers, derived views), ``plans``
(registered queries and their SQL equivalents), ``streaming``.
"""

__version__ = "0.1.0"
