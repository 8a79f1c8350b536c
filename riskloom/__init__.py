"""riskloom: Spark-native conduct-risk analytics over a long entity x category x period fact.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column``) function built from native Spark
expressions, so it composes with ``df.transform`` and is planned by Catalyst.
"""

from riskloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
