"""statlathe: Spark-native auditing of binary classifiers over short statements."""

__version__ = "0.1.0"
