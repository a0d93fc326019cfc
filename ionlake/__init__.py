"""Part of ionlake, a Spark-native library for targeted mass-spectrometry analytics."""
